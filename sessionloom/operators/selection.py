"""Selection of task families under quotas."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: At most so many families by recency, by friction and by success; the rest by complexity.
QUOTAS = (("recent", 8), ("friction", 6), ("success", 4))
#: Fixed value: share of the selection that one project may have, when there are several.
PROJECT_SHARE = 0.4


def select_families(families: DataFrame, limit: int) -> DataFrame:
    """position and family_id of the selected families, of families(family_id, project, date, friction, success, complexity).

    By recency, friction, success and complexity, in that order, a project has at most its share; what is
    then left to fill goes by recency. If all fit, all are taken by recency. Ties go to later dates, then
    to larger ids. Of each ranking, only the rows that the quotas can reach are gathered: `limit` of a
    project and limit * (limit + 1) in all, whatever the input. Null projects are one project; an empty
    table, or a limit below 1, gives no rows.
    """
    schema = f"position int, family_id {families.schema['family_id'].dataType.simpleString()}"
    if limit < 1:
        return families.sparkSession.createDataFrame([], schema)
    rows = families.select("family_id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), "date", "friction", "success", "complexity")
    n_rows, several = rows.agg(F.count("*"), F.min("project") < F.max("project")).first()
    last = [F.desc("date"), F.desc("family_id")]
    orders = {"recent": last, "friction": [F.desc("friction"), *last], "success": [F.desc("success"), *last], "complexity": [F.desc("complexity"), *last]}
    reach = None
    for order in orders.values():
        near = rows.withColumn("__k", F.row_number().over(Window.partitionBy("project").orderBy(*order))).filter(F.col("__k") <= limit)
        near = near.drop("__k").orderBy(*order).limit(limit * (limit + 1))
        reach = near if reach is None else reach.union(near)
    share = math.ceil(limit * PROJECT_SHARE) if several else limit

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        def ranked(by: str) -> list[tuple]:
            keys = ([] if by == "recent" else [by]) + ["date", "family_id"]
            return list(pdf.sort_values(keys, ascending=False)[["family_id", "project"]].itertuples(index=False, name=None))

        taken, held = {}, {}
        stages = [(by, quota, share) for by, quota in QUOTAS] + [("complexity", limit, share), ("recent", limit, limit)]
        for by, quota, cap in [("recent", limit, limit)] if n_rows <= limit else stages:
            left = min(quota, limit - len(taken))
            for family, project in ranked(by):
                if left and family not in taken and held.get(project, 0) < cap:
                    taken[family] = len(taken) + 1
                    held[project] = held.get(project, 0) + 1
                    left -= 1
        return pd.DataFrame({"position": pd.Series(list(taken.values()), dtype="int32"), "family_id": list(taken)})

    return reach.distinct().groupBy().applyInPandas(fold, schema)
