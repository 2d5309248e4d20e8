"""Jobs over files and streams that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import feature_job
from tidemark.plans.base import Catalog, read
from tidemark.plans.split_queries import D2, POINTS_SQL, points
from tidemark.sources import molecules
from tidemark.sources.scratch import scratch
from tidemark.streaming import staged

C = Catalog()
QUERIES, SQL = C.queries, C.sql


def molecule_files(spark, d) -> list[str]:
    """Two roots with a file for each vector's molecule. Of fifty molecules, one has a broken number, one no atoms, one a stub in
    the first root and its file in the second, and one is called failed by its metadata."""
    number = lambda c: F.format_string("%8.3f", F.col(c))
    line = F.concat(F.format_string("ATOM  %5d  C1  GLC A%4d    ", F.col("atom") + 1, F.col("seq")), number("x"), number("y"), F.when((F.col("mol") % 50 == 7) & (F.col("atom") == 4), F.lit("  1.2.3 ")).otherwise(number("z")), F.lit("  1.00  0.00"))
    text = points(spark, d).groupBy("mol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("atom", line.alias("line")))), lambda r: r["line"]), "\n").alias("content"))
    kind = F.col("mol") % 50
    files = text.select(F.col("mol").cast("string"), kind.alias("kind"), F.when(kind == 8, F.rpad(F.lit("HEADER "), 200, "x")).otherwise(F.col("content")).alias("content"))
    roots = [scratch(spark, "molecules") + f"/{name}" for name in ("first", "second")]
    molecules.register(spark)
    first = files.withColumn("meta", F.when(F.col("kind") == 10, F.lit('{"status": "failed"}')).when(F.col("kind") == 11, F.lit("{")))
    first = first.withColumn("content", F.when(F.col("kind") == 9, F.lit("stub")).otherwise(F.col("content")))
    for root, table in zip(roots, (first.select("mol", "content", "meta"), files.filter("kind in (9, 12)").select("mol", "content"))):
        table.write.format("molecules").mode("append").option("path", root).save()
    return roots


ATOMS = POINTS_SQL.replace("20 * embedding[3 * i + 1]::DOUBLE AS x", "round(20 * embedding[3 * i + 1]::DOUBLE, 3) AS x").replace("20 * embedding[3 * i + 2]::DOUBLE AS y", "round(20 * embedding[3 * i + 2]::DOUBLE, 3) AS y").replace("20 * embedding[3 * i + 3]::DOUBLE AS z", "round(20 * embedding[3 * i + 3]::DOUBLE, 3) AS z").replace("FROM embeddings,", "FROM (SELECT * FROM embeddings WHERE vec_id % 50 NOT IN (7, 8, 10)),")


@C.add("C03_structure_features", f"""WITH {ATOMS}, m AS (SELECT mol, count(*) AS n_atoms, count(DISTINCT res) AS n_residues, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM a GROUP BY 1), f AS (SELECT a.mol, sqrt(max({D2})) AS max_d FROM a JOIN a b ON a.mol = b.mol AND a.atom < b.atom GROUP BY 1),
 e AS (SELECT DISTINCT a.mol, a.res AS u, b.res AS v FROM a JOIN a b ON a.mol = b.mol AND a.res <> b.res WHERE {D2} < 4.0), dg AS (SELECT mol, u, count(*) AS d FROM e GROUP BY 1, 2), bt AS (SELECT m.mol, coalesce(count(*) FILTER (d >= 3), 0) AS branch, CASE WHEN count(d) = 0 THEN least(2, max(n_residues)) ELSE count(*) FILTER (d = 1) END AS terminal FROM m LEFT JOIN dg USING (mol) GROUP BY 1),
 c AS (SELECT a.mol, a.atom, count(*) AS n FROM a JOIN a b ON a.mol = b.mol AND a.atom <> b.atom WHERE {D2} < 16 AND {D2} > 0 GROUP BY 1, 2), x AS (SELECT a.mol, avg(coalesce(n, 0)) AS exposure FROM a LEFT JOIN c ON c.mol = a.mol AND c.atom = a.atom GROUP BY 1)
SELECT mol::VARCHAR AS mol, n_atoms, n_residues, round(rg, 3) AS radius_of_gyration, round(max_d, 3) AS max_pair_distance, round(rg / max_d, 4) AS compactness, branch AS branch_proxy, terminal AS terminal_proxy, round(exposure, 3) AS exposure_proxy, CASE WHEN mol % 50 = 9 THEN 'second' ELSE 'first' END AS source_dir, mol || '/structure_1.pdb' AS source_file FROM m JOIN f USING (mol) JOIN bt USING (mol) JOIN x USING (mol)""")
def c03(spark, d):
    return feature_job.feature_tables(spark, molecule_files(spark, d))["ssv"]


CONTACTS = f"""WITH {ATOMS}, cc AS (SELECT mol, res, seq, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1, 2, 3), ed AS (SELECT a.mol, a.res AS u, b.res AS v, abs(a.seq - b.seq) AS gap FROM cc a JOIN cc b ON a.mol = b.mol AND a.res < b.res WHERE {D2} < 20.25),
 dg AS (SELECT mol, node, count(*) AS deg FROM (SELECT mol, u AS node FROM ed UNION ALL SELECT mol, v FROM ed) GROUP BY 1, 2), mm AS (SELECT mol, avg(deg) AS mu, stddev_pop(deg) AS sd FROM dg GROUP BY 1), co AS (SELECT mol, sum((deg >= mu + 0.5 * sd)::INT) AS c, sum((deg <= mu - 0.5 * sd)::INT) AS p, max(sd) AS sd FROM dg JOIN mm USING (mol) GROUP BY 1),
 n AS (SELECT mol, count(DISTINCT res) AS n_res FROM a GROUP BY 1), e AS (SELECT mol, count(*) AS n_edges, avg((gap >= 3)::INT) AS lr, max(gap) AS mg FROM ed GROUP BY 1), dd AS (SELECT a.mol, sqrt({D2}) AS d FROM cc a JOIN cc b ON a.mol = b.mol AND a.res < b.res), dv AS (SELECT mol, stddev_pop(d) / avg(d) AS v FROM dd GROUP BY 1),
 pc AS (SELECT a.mol, a.res, count(*) AS n FROM a JOIN a b ON a.mol = b.mol AND a.res <> b.res WHERE {D2} < 16 GROUP BY 1, 2), nb AS (SELECT r.mol, avg(coalesce(n, 0)) AS mean, stddev_pop(coalesce(n, 0)) AS sd FROM (SELECT DISTINCT mol, res FROM a) r LEFT JOIN pc ON pc.mol = r.mol AND pc.res = r.res GROUP BY 1)
SELECT n.mol::VARCHAR AS mol, round(coalesce(n_edges, 0) / n_res, 4) AS contact_density, round(coalesce(lr, 0.0), 4) AS long_range_contact_fraction, round(coalesce(CASE WHEN co.sd = 0 OR c + p = 0 THEN 0.5 ELSE c / (c + p) END, 0.5), 4) AS core_periphery_ratio, coalesce(mg, 0) AS max_contact_distance_seq, n_res AS n_residues, coalesce(n_edges, 0) AS n_contacts,
 round(nb.mean, 3) AS mean_residue_neighbor_count, round(nb.sd, 3) AS sd_residue_neighbor_count, round(v, 4) AS torsion_diversity FROM n LEFT JOIN e USING (mol) LEFT JOIN co USING (mol) JOIN nb USING (mol) JOIN dv USING (mol)"""


@C.add("C03_contact_features", CONTACTS)
def c03_contacts(spark, d):
    """All but the spectral gap, which SQL does not have (N14 and the tests hold it)."""
    return feature_job.feature_tables(spark, molecule_files(spark, d))["gcv"].drop("graph_laplacian_spectral_gap", "source_dir", "source_file")


@C.add("C03_coverage_flags", "SELECT vec_id::VARCHAR AS mol, CASE WHEN vec_id % 50 IN (7, 8) THEN 'FAILED' ELSE 'OK' END AS status, CASE vec_id % 50 WHEN 7 THEN 'parse_error' WHEN 8 THEN 'feature_computation_error' ELSE '' END AS failure_reason, CASE WHEN vec_id % 50 = 9 THEN 'second' ELSE 'first' END AS source_dir FROM embeddings WHERE vec_id % 50 <> 10")
def c03_flags(spark, d):
    return feature_job.feature_tables(spark, molecule_files(spark, d))["coverage_flags"]


def delivered(spark, d, again: bool):
    """Documents as items of their source, one in ten without payload; again: every third id a second time, whole now."""
    docs = read(spark, d, "documents").filter(F.col("doc_id").isNotNull())
    if again:
        docs = docs.filter("doc_id % 3 = 0")
    lost = F.lit(False) if again else F.col("doc_id") % 10 == 9
    return docs.select(
        F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").cast("string").alias("source_item_id"), F.lit("text").alias("item_type"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(~lost, F.col("text")).alias("payload"), F.timestamp_seconds(F.lit(int(again))).alias("listed_at"),
    )


def two_deliveries(spark, d) -> str:
    """A staged run that is stopped after the first delivery and started again for the second one."""
    root = scratch(spark, "stage")
    sources = [r[0] for r in read(spark, d, "documents").select(F.coalesce("source", F.lit("none"))).distinct().collect()]
    for again in (False, True):
        delivered(spark, d, again).repartition(6).write.mode("append").json(f"{root}/incoming")
        staged.run_stage(spark, f"{root}/incoming", f"{root}/out", sources, lambda items: staged.stored(items, 200), files=4)
    return f"{root}/out"


STAGED = """WITH i AS (SELECT coalesce(source, 'none') AS source, doc_id::VARCHAR AS source_item_id, CASE WHEN again = 1 OR doc_id % 10 <> 9 THEN text END AS payload, again FROM documents, range(2) t(again) WHERE doc_id IS NOT NULL AND (again = 0 OR doc_id % 3 = 0)),
 s AS (SELECT *, coalesce(strlen(payload), 0) AS size, coalesce(strlen(payload), 0) >= 200 AS good FROM i),
 f AS (SELECT *, coalesce(bool_or(good) OVER (PARTITION BY source, source_item_id ORDER BY again ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS had FROM s)"""


@C.add("C01_staged_attempts", f"{STAGED} SELECT source, source_item_id, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN good THEN size ELSE 0 END AS bytes, CASE WHEN good THEN sha256(payload) END AS sha256, CASE WHEN payload IS NULL THEN 'not found' WHEN NOT good THEN size || ' bytes, fewer than 200' END AS error FROM f WHERE NOT had")
def c01(spark, d):
    """The log of a staged run (K03, F12): failed items are tried again, fetched ones are not."""
    return staged.attempts(spark, two_deliveries(spark, d)).select("source", "source_item_id", "status", "bytes", "sha256", "error")


@C.add("C01_staged_totals", f"{STAGED} SELECT source, count(*) FILTER (good AND NOT had) AS ok, count(*) FILTER (NOT good AND NOT had) AS failed, count(*) FILTER (had) AS skipped, coalesce(sum(size) FILTER (good AND NOT had), 0)::BIGINT AS bytes FROM f GROUP BY 1")
def c01_totals(spark, d):
    return staged.run_totals(spark, two_deliveries(spark, d))


@C.add("K06_checksum_file", f"{STAGED} SELECT source_item_id, sha256(payload) AS sha256 FROM f WHERE good AND NOT had")
def k06(spark, d):
    return staged.checksums(spark, two_deliveries(spark, d))
