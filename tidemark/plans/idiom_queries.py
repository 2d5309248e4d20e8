"""Remaining idioms: scans of nested records, filters, joins, formats, key variants and corrections by rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.functions.columns import falsy
from tidemark.operators import stats
from tidemark.plans.base import SQL_FEATURES, SQL_PAIRS, Catalog, features, pairs, read, rounded
from tidemark.plans.stats_queries import LONG_SQL, MWU, PVAL, tested

C = Catalog()
QUERIES, SQL = C.queries, C.sql


@C.add("S08_parquet_index", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def s08(spark, d):
    return read(spark, d, "events").filter("event_type = 'click'").select("event_id", "event_type")


@C.add("S09_S19_nested_bindings", "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 4 <> 0")
def s19(spark, d):
    bound = F.struct(F.struct(F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("value")).alias("id"), F.struct(F.col("event_type").alias("value")).alias("kind"), F.struct(F.get_json_object("props", "$.k").alias("value")).alias("k"))
    return read(spark, d, "events").select(bound.alias("b")).filter("b.id.value is not null").select(F.col("b.id.value").alias("event_id"), F.col("b.kind.value").alias("kind"), F.col("b.k.value").alias("k"))


@C.add("S20_manual_manifest", "SELECT coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END), ''), nullif(CASE WHEN page_id % 2 = 0 THEN 'u' || page_id ELSE '' END, '')) AS url, page_id FROM pages WHERE coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END), ''), nullif(CASE WHEN page_id % 2 = 0 THEN 'u' || page_id ELSE '' END, '')) IS NOT NULL")
def s20(spark, d):
    a = F.trim(F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url")))
    b = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("u"), F.col("page_id"))).otherwise("")
    return read(spark, d, "pages").select(falsy(a, b).alias("url"), "page_id").filter("url <> ''")


@C.add("F05_drop_missing", "SELECT count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_retailprice END AS v FROM part) WHERE v IS NOT NULL")
def f05(spark, d):
    v = F.when(F.col("p_size") % 6 == 0, float("nan")).when(F.col("p_size") % 12 == 0, None).otherwise(F.col("p_retailprice"))
    return rounded(read(spark, d, "part").select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).agg(F.count("*").alias("n"), F.avg("v").alias("mean")))


@C.add("F07_threshold_conjunction", f"WITH {LONG_SQL}, {MWU} SELECT agent, feature, round(2 * u / (n1 * n2) - 1, 6) AS delta FROM m WHERE abs((u - n1 * n2 / 2.0 - sign(u - n1 * n2 / 2.0) * 0.5) / sg) >= 0.5 AND abs(2 * u / (n1 * n2) - 1) >= 0.03")
def f07(spark, d):
    m = stats.mann_whitney(tested(spark, d), "value", "pos", ["agent", "feature"])
    return rounded(m.filter((F.abs("z") >= 0.5) & (F.abs("delta") >= 0.03)).select("agent", "feature", "delta"))


@C.add("F08_status_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def f08(spark, d):
    return read(spark, d, "events").filter(F.col("event_type").isin("click", "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@C.add("F11_skip_list", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (3, 5, 8, 13, 21)")
def f11(spark, d):
    return read(spark, d, "part").filter(~F.col("p_partkey").isin(3, 5, 8, 13, 21)).select(F.col("p_partkey").alias("id"))


@C.add("J04_left_dimension", f"WITH {SQL_PAIRS} SELECT p.id, p.agent, n_name, r_name FROM pairs p LEFT JOIN nation ON n_nationkey = agent LEFT JOIN region ON r_regionkey = n_regionkey")
def j04(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs(spark, d).join(n, F.col("agent") == F.col("n_nationkey"), "left").select("id", "agent", "n_name", "r_name")


@C.add("J05_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j05(spark, d):
    o = read(spark, d, "orders").filter("o_totalprice > 300000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@C.add("J06_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j06(spark, d):
    o = read(spark, d, "orders").filter("o_totalprice > 300000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@C.add("J12_paired_agents", f"WITH {SQL_PAIRS}, a AS (SELECT agent, count(*) AS na FROM rawpairs WHERE data_source = 'A' GROUP BY 1), b AS (SELECT agent, count(*) AS nb FROM rawpairs WHERE data_source = 'R' GROUP BY 1) SELECT agent, na, nb FROM a JOIN b USING (agent)")
def j12(spark, d):
    raw = pairs(spark, d, distinct=False)
    side = lambda s, n: raw.filter(F.col("data_source") == s).groupBy("agent").agg(F.count("*").alias(n))
    return side("A", "na").join(side("R", "nb"), "agent")


@C.add("J15_optional_patterns", "SELECT d.doc_id, l.quality, b.item_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j15(spark, d):
    x = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.join(read(spark, d, "benchmark").select("item_id"), F.col("doc_id") == F.col("item_id"), "left")


@C.add("G07_multi_aggregate", "SELECT p_type, round(avg(p_size), 6) AS size_mean, round(stddev_samp(p_size), 6) AS size_std, round(avg(p_retailprice), 6) AS price_mean, round(stddev_samp(p_retailprice), 6) AS price_std FROM part GROUP BY 1")
def g07(spark, d):
    made = [f(c).alias(f"{n}_{s}") for c, n in (("p_size", "size"), ("p_retailprice", "price")) for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return rounded(read(spark, d, "part").groupBy("p_type").agg(*made))


@C.add("G15_error_counter", "SELECT event_type AS error, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def g15(spark, d):
    return read(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(10)


@C.add("O01_sort", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def o01(spark, d):
    return read(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


COND = "WITH s AS (SELECT p_partkey AS id, 'Gal(b1-' || (p_size % 4) || ')[Neu(a2-3)]Glc NAc(b1-4)Man' || (CASE WHEN p_size % 2 = 0 THEN ' α' ELSE '' END) AS s FROM part)"


def condensed(spark, d):
    p = F.col("p_size")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Gal(b1-"), p % 4, F.lit(")[Neu(a2-3)]Glc NAc(b1-4)Man"), F.when(p % 2 == 0, " α").otherwise("")).alias("s"))


@C.add("X04_condensed_scaffold", f"{COND} SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '[ab]\\d+-\\d+', 'x-x', 'g'), '[αβ]', '', 'g'), '\\s+', '', 'g') AS scaffold FROM s")
def x04(spark, d):
    return condensed(spark, d).select("id", keys.plain_scaffold(F.col("s")).alias("scaffold"))


@C.add("X06_condensed_terminals", f"{COND} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(s, '[\\[\\]]'), lambda p: list_last(regexp_extract_all(p, '[A-Z][a-z]*'))), lambda p: p IS NOT NULL))), ',') AS terminals FROM s")
def x06(spark, d):
    return condensed(spark, d).select("id", keys.plain_terminals(F.col("s")).alias("terminals"))


@C.add("X08_condensed_linkages", f"{COND} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '[ab]\\d+-\\d+'))), ',') AS linkages FROM s")
def x08(spark, d):
    return condensed(spark, d).select("id", keys.plain_linkages(F.col("s")).alias("linkages"))


@C.add("X11_content_checksum", "SELECT page_id, sha256(html) AS sha FROM pages")
def x11(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


@C.add("X21_half_even", "SELECT p_partkey AS id, round_even(p_size / 4.0, 1)::DOUBLE AS r FROM part")
def x21(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.bround(F.col("p_size") / 4.0, 1).alias("r"))


@C.add("X29_X30_json_and_maps", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '=' || coalesce(json_extract_string(props, '$.k'), '') AS entry FROM events")
def x29(spark, d):
    k = F.from_json("props", "k string")["k"]
    m = F.map_from_arrays(F.array("event_type"), F.array(F.coalesce(k, F.lit(""))))
    return read(spark, d, "events").select("event_id", k.try_cast("bigint").alias("k"), F.concat_ws("=", F.map_keys(m)[0], F.map_values(m)[0]).alias("entry"))


@C.add("T06_T07_holm_flags", f"WITH {PVAL}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS k, count(*) OVER (PARTITION BY g) AS n FROM ps), f AS (SELECT g, p <= 0.2 / (n - k + 1) AS hit, min((p <= 0.2 / (n - k + 1))::INT) OVER (PARTITION BY g ORDER BY p, id ROWS UNBOUNDED PRECEDING) = 1 AS run FROM k) SELECT g, count(*) FILTER (hit) AS by_rank, count(*) FILTER (run) AS with_stop FROM f GROUP BY 1")
def t06(spark, d):
    x = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.round(((F.col("p_partkey") * 7919) % 1000 + 1) / 4000.0, 6).alias("p"))
    c = stats.corrections(x, "p", "id", alpha=0.2, groups=["g"])
    return c.groupBy("g").agg(F.count_if("holm_rank").alias("by_rank"), F.count_if("holm_step").alias("with_stop"))


@C.add("P08_null_to_zero_key", f"WITH {SQL_FEATURES} SELECT id, coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE floor(avg_qty) END, 0)::INT AS k FROM features")
def p08(spark, d):
    return features(spark, d).select("id", F.coalesce(F.when(F.col("p_size") % 4 != 0, F.col("avg_qty")), F.lit(0.0)).cast("int").alias("k"))
