"""Families under quotas: stages, shares and the refill, on small tables."""

import pytest

from sessionloom.operators.selection import select_families

SCHEMA = "family_id int, project string, date int, friction int, success int, complexity int"


def picked(spark, rows, limit):
    got = select_families(spark.createDataFrame(rows, SCHEMA), limit)
    return [r["family_id"] for r in got.orderBy("position").collect()]


def test_all_fit(spark):
    assert picked(spark, [(i, None, i % 3, 0, 0, 9 - i) for i in range(6)], 6) == [5, 2, 4, 1, 3, 0]


def test_share_and_refill(spark):
    # project a has the 40 latest rows, b two early ones: a's share is 4 of 10, b gives 2, recency fills up from a
    rows = [(i, "a", 100 + i, 0, 0, i) for i in range(40)] + [(90, "b", 1, 7, 0, 0), (91, "b", 2, 0, 0, 0)]
    assert picked(spark, rows, 10) == [39, 38, 37, 36, 91, 90, 35, 34, 33, 32]


def test_stages(spark):
    rows = [(i, str(i), i, 1000 if i == 3 else 0, int(i == 5), 1000 if i == 7 else 0) for i in range(60)]
    got = picked(spark, rows, 24)
    assert got[:8] == [59, 58, 57, 56, 55, 54, 53, 52] and got[8] == 3 and got[14] == 5 and got[18] == 7
    assert len(got) == len(set(got)) == 24


@pytest.mark.parametrize("limit", [0, 5])
def test_nothing(spark, limit):
    assert picked(spark, [], limit) == []
