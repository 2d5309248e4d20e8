"""Result files and manifests that Spark derives from the tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.plans.base import SQL_PAIRS, Catalog, pairs, read, rounded
from tidemark.sources import results, transfer
from tidemark.sources.scratch import scratch

C = Catalog()
QUERIES, SQL = C.queries, C.sql

TRANSFER = f"""WITH {SQL_PAIRS}, a AS (SELECT DISTINCT id, agent FROM rawpairs WHERE data_source = 'A'), b AS (SELECT DISTINCT id, agent FROM rawpairs WHERE data_source = 'N'), k AS (SELECT agent FROM a GROUP BY 1 HAVING count(*) >= 12),
 s AS (SELECT id, agent, 'train' AS side FROM a UNION ALL SELECT id, agent, 'test' FROM b WHERE agent IN (SELECT agent FROM k)), m AS (SELECT 'id' AS kind, id AS member, side FROM s UNION ALL SELECT 'agent', agent, side FROM s),
 g AS (SELECT kind, member, bool_or(side = 'train') AS tr, bool_or(side = 'test') AS te FROM m GROUP BY 1, 2)
SELECT 'A' AS source_train, 'N' AS source_test, 42::BIGINT AS seed, count(*) FILTER (kind = 'id' AND tr) AS n_train_ids, count(*) FILTER (kind = 'id' AND te) AS n_test_ids, count(*) FILTER (kind = 'id' AND tr AND te) AS n_id_overlap,
 count(*) FILTER (kind = 'agent' AND tr) AS n_train_agents, count(*) FILTER (kind = 'agent' AND te) AS n_test_agents, count(*) FILTER (kind = 'agent' AND tr AND te) AS n_agent_overlap, '12' AS min_pos FROM g"""


@C.add("K08_transfer_manifest", TRANSFER)
def k08(spark, d):
    path = scratch(spark, "transfer")
    transfer.save_transfer(splits.cross_source(pairs(spark, d, distinct=False), "A", "N", min_pos=12), path, "A", "N", 42, {"min_pos": "12"})
    _, manifest = transfer.load_transfer(spark, path)
    return manifest.select("source_train", "source_test", "seed", *transfer.COUNTS, F.col("metadata")["min_pos"].alias("min_pos"))


RESULT_FILES = """SELECT 'E1' AS experiment, 'E1_v2/summary.csv' AS source_file, count(*) AS n, round(avg(o_totalprice), 6) AS mrr FROM orders UNION ALL SELECT 'E2', 'E2/metrics.json', count(*), round(avg(p_size), 6) FROM part
UNION ALL SELECT 'E3', NULL, NULL, NULL UNION ALL SELECT 'E4', 'E4/metrics.json', NULL, round(avg(l_tax), 6) FROM lineitem UNION ALL SELECT 'E5', 'E5_v1/summary.csv', count(*), NULL FROM supplier"""


@C.add("S27_C17_result_files", RESULT_FILES)
def s27(spark, d):
    """Runs that left files of two versions, nested documents with numbers in quotes, none, values of other types, and tables without a column."""
    root = scratch(spark, "results")
    csv = lambda df, name: df.coalesce(1).write.csv(f"{root}/{name}/summary.csv", header=True)
    document = lambda df, name: df.coalesce(1).write.json(f"{root}/{name}/metrics.json")
    orders, part = read(spark, d, "orders"), read(spark, d, "part")
    csv(orders.agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mrr.mean")), "E1_v2")
    csv(orders.agg(F.min("o_orderkey").alias("n"), F.lit(0.0).alias("mrr.mean")), "E1_v1")
    document(part.agg(F.count("*").cast("string").alias("n"), F.struct(F.avg("p_size").alias("mean")).alias("mrr")), "E2")
    document(read(spark, d, "lineitem").agg(F.array(F.count("*")).alias("n"), F.struct(F.avg("l_tax").alias("mean")).alias("mrr")), "E4")
    csv(read(spark, d, "supplier").agg(F.count("*").alias("n")), "E5_v1")
    sources = {e: [f"{root}/{e}{v}/{f}" for v in ("_v2", "_v1", "") for f in ("summary.csv", "metrics.json")] for e in ("E1", "E2", "E3", "E4", "E5")}
    rows = results.results(spark, sources, {"n": ("n", "bigint"), "mrr": ("mrr.mean", "double")})
    return rounded(rows.select(F.col("source").alias("experiment"), F.regexp_extract("file", "[^/]+/[^/]+$", 0).alias("source_file"), "n", "mrr"))
