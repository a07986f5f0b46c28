"""Queries over orders, lineitem, customer, part: families, projects, selections, incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import classify
from sessionloom.operators import rollups, selection
from sessionloom.plans.registry import query, table
from sessionloom.sources import incremental


@query("SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def header_semi_prune(spark, d):
    kept = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'").select("o_orderkey")
    body = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return body.join(kept, "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.9) AS p90, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def nearest_rank_p90(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rollups.nearest_rank("l_quantity", 0.9).alias("p90"), F.median("l_quantity").alias("middle"))


L = "SELECT l_orderkey, l_quantity::BIGINT AS unc, round(l_discount * 100)::BIGINT AS rd, round(l_tax * 100)::BIGINT AS wr, l_linenumber::BIGINT AS outp FROM lineitem"


@query(f"SELECT l_orderkey, sum(unc + rd)::BIGINT AS input_tokens, sum(rd)::BIGINT AS cached_input_tokens, sum(outp)::BIGINT AS output_tokens, sum(unc + rd + wr + outp)::BIGINT AS total_tokens, greatest(sum(unc + rd) - sum(rd), 0)::BIGINT AS uncached_input_tokens FROM ({L}) GROUP BY 1")
def token_projection(spark, d):
    cols = [F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"), F.col("l_linenumber").cast("long")]
    t = rollups.token_projection(*cols)
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.sum(v).alias(k) for k, v in t.items()])
    return out.withColumn("uncached_input_tokens", F.greatest(F.col("input_tokens") - F.col("cached_input_tokens"), F.lit(0)))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def workflow_candidates(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top12_parts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(12)


@query("SELECT o_orderkey, 'file' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'snapshot' FROM orders WHERE o_orderkey % 2 <> 0")
def union_sources(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    return o.filter(even).withColumn("origin", F.lit("file")).unionByName(o.filter(~even).withColumn("origin", F.lit("snapshot")))


@query("SELECT o_orderkey, (2 * 1 + least(n, 50) + 4 * r)::BIGINT AS complexity FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def complexity_score(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    zero = F.lit(0)
    return n.select("o_orderkey", classify.complexity(F.lit(1), F.col("n"), F.col("r"), zero, zero).cast("long").alias("complexity"))


@query("SELECT c_custkey, 'customer-' || left(sha256(c_custkey::VARCHAR), 12) AS id FROM customer")
def stable_ids(spark, d):
    from sessionloom.functions import text

    return table(spark, d, "customer").select("c_custkey", text.stable_id(F.col("c_custkey"), "customer").alias("id"))


@query("SELECT p_partkey, string_split(p_type, ' ')[-1] AS tool FROM part")
def canonical_names(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.canonical_tool(F.replace("p_type", F.lit(" "), F.lit("__"))).alias("tool"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'hit' ELSE 'miss' END AS status, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_custkey) AS fingerprint FROM orders""")
def incremental_upsert(spark, d):
    """Orders before 1995 are known from an earlier refresh; the others are parsed anew."""
    o = incremental.with_fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_custkey"])
    known = o.filter("o_orderdate < timestamp_ntz'1995-01-01 00:00:00'").select("o_orderkey", "fingerprint")
    return incremental.refresh(o, known, "o_orderkey").select("o_orderkey", "status", "fingerprint")


@query()
def quota_selection(spark, d):
    """24 orders under the quotas of families. Project: customer; friction: returned lines; success: finished; complexity: price."""
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("family_id")).agg(F.count("*").alias("friction"))
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("family_id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("success"), F.round(F.col("o_totalprice") * 100).cast("long").alias("complexity"),
    )
    families = o.join(back, "family_id", "left").withColumn("friction", F.coalesce("friction", F.lit(0)))
    return selection.select_families(families, 24)
