"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from sessionloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


#: Queries without SQL that find nothing in the smallest tables; tests on literals cover them.
NONE_FOUND = ("leak_scan",)


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in catalog.ORACLES:
        assert columns and (mine or name in NONE_FOUND)
        return
    got = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in got.description]
    theirs = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()], key=str)
    assert sorted(names) == columns
    assert mine == theirs


def test_usage_dedup_gives_each_step(spark):
    """Not a sum per user: the event that counts for each of a user's steps."""
    got = catalog.QUERIES["usage_dedup"](spark, DATA)
    steps = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "get_json_object(props, '$.k') AS k").distinct()
    assert got.columns == ["user_id", "k", "event_id", "cents"] and got.count() == steps.count() > steps.select("user_id").distinct().count()


def test_batching_covers_documents(spark):
    """Every document is in a batch, not the labelled ones alone."""
    got = catalog.QUERIES["batching"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    assert got.count() == docs.count() and got.select("doc_id").exceptAll(docs).isEmpty()


@pytest.mark.parametrize("name, source", [("tool_sessions", "events"), ("report_totals", "events"), ("conversation_sessions", "conversations")])
def test_fold_starts_from_stored_records(spark, name, source):
    """No part of the fold reads and decodes the lines again."""
    files = catalog.QUERIES[name](spark, DATA).inputFiles()
    assert files and not [f for f in files if f.endswith(f"{source}.parquet")]


def test_report_folds_messages_once(spark, monkeypatch):
    """The sessions of the document are folded from the stored messages."""
    from sessionloom.sessions import fold

    made, plain_messages = [], fold.messages
    monkeypatch.setattr(fold, "messages", lambda records: made.append(1) or plain_messages(records))
    assert catalog.QUERIES["report_document"](spark, DATA).first()["errors"] == 0 and len(made) == 1
