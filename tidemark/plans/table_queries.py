"""Scans, projections, filters, joins, aggregates, set operations and audits (S, K, P, F, J, G, U, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import falsy, hash_uniform, human_size, ladder
from tidemark.operators import audit, stats
from tidemark.plans.base import FEATURES, SQL_FEATURES, SQL_PAIRS, Catalog, features, pairs, read, rounded

C = Catalog()
QUERIES, SQL = C.queries, C.sql

# ---- scans and projections


@C.add("S01_feature_scan", f"WITH {SQL_FEATURES} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM features")
def s01(spark, d):
    return rounded(features(spark, d).select("id", *FEATURES))


@C.add("S02_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def s02(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(*(f.name for f in li.schema if f.dataType.typeName() in ("long", "integer", "double", "float")))


@C.add("S03_positive_labels", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def s03(spark, d):
    return read(spark, d, "labels").filter("quality = 1").select("doc_id", "quality")


@C.add("S06_alias_coalesce", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(CASE WHEN event_id % 2 = 0 THEN props END, ''), '') AS source_item_id FROM events")
def s06(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("source_item_id"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("glytoucan_id"))
    return audit.canonical(e)


@C.add("S11_normalise_record", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS api_url, coalesce(CASE WHEN page_id % 2 = 0 THEN url END, 'page:' || page_id) AS url, len(CASE WHEN page_id % 3 = 0 THEN [url] ELSE [url, 'x'] END) AS synonyms FROM pages")
def s11(spark, d):
    api = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return read(spark, d, "pages").select("page_id", api.alias("api_url"), F.coalesce(api, F.concat(F.lit("page:"), F.col("page_id"))).alias("url"), F.size(F.when(F.col("page_id") % 3 == 0, F.array("url")).otherwise(F.array(F.col("url"), F.lit("x")))).cast("long").alias("synonyms"))


@C.add("S15_transient_errors", "SELECT event_id, CASE WHEN regexp_matches(event_type || ' ' || props, '5|[Cc]lick') THEN 'RETRY_LATER' ELSE 'FINAL' END AS tag FROM events")
def s15(spark, d):
    return read(spark, d, "events").select("event_id", F.when(F.concat_ws(" ", "event_type", "props").rlike("5|[Cc]lick"), "RETRY_LATER").otherwise("FINAL").alias("tag"))


@C.add("S18_union_distinct_count", "SELECT count(DISTINCT concat_ws('|', k, n)) AS n FROM (SELECT c_nationkey AS k, 'c' AS n FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier)")
def s18(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("n"))
    return c.unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("n"))).agg(F.countDistinct(F.concat_ws("|", "k", "n")).alias("n"))


@C.add("S22_first_source_wins", "SELECT k, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr) AS r FROM (SELECT c_nationkey AS k, 1 AS pr, 'customer' AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 2, 'supplier' FROM supplier)) WHERE r = 1")
def s22(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("pr"), F.lit("customer").alias("src"))
    both = c.unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(2).alias("pr"), F.lit("supplier").alias("src")))
    return both.groupBy("k").agg(F.min_by("src", "pr").alias("src"))


ROUTE = "CASE WHEN q.quality = 1 THEN 'already_ok' WHEN d.lang = 'en' AND d.n_chars > 3000 THEN 'existing' WHEN d.source IN ('src0', 'src1') THEN 'api' WHEN d.n_chars < 500 THEN 'library' WHEN d.lang = 'de' THEN 'generate' ELSE 'none' END"


@C.add("F10_acquisition_route", f"SELECT d.doc_id, {ROUTE} AS route FROM documents d LEFT JOIN labels q USING (doc_id)")
def f10(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    t = lambda c: F.coalesce(c, F.lit(False))
    return x.select("doc_id", audit.acquisition_route(t(F.col("quality") == 1), (F.col("lang") == "en") & (F.col("n_chars") > 3000), F.col("source").isin("src0", "src1"), F.col("n_chars") < 500, F.col("lang") == "de").alias("route"))


@C.add("K04_row_checksum", "SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type, props)) AS sha FROM events")
def k04(spark, d):
    return read(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type", "props"), 256).alias("sha"))


@C.add("K06_latest_per_path", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def k06(spark, d):
    return audit.latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@C.add("P09_unpivot", "SELECT p_partkey AS id, 'size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', round(p_retailprice, 6) FROM part")
def p09(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.round("p_retailprice", 6).alias("price"))
    return p.unpivot("id", ["size", "price"], "feature", "value")


@C.add("P10_pivot", "SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN n END) AS f, max(CASE WHEN l_linestatus = 'O' THEN n END) AS o FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def p10(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("n")).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@C.add("P12_relative_delta", "SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 6) AS delta, round((max(o_totalprice) - min(o_totalprice)) / nullif(min(o_totalprice), 0), 6) AS rel FROM orders GROUP BY 1")
def p12(spark, d):
    lo, hi = F.min("o_totalprice"), F.max("o_totalprice")
    return rounded(read(spark, d, "orders").groupBy("o_custkey").agg((hi - lo).alias("delta"), ((hi - lo) / F.nullif(lo, F.lit(0.0))).alias("rel")))


@C.add("P13_class_from_prefix", "SELECT o_orderpriority, CASE WHEN starts_with(o_orderpriority, '1') THEN 'top' WHEN starts_with(o_orderpriority, '5') THEN 'low' ELSE 'mid' END AS class, count(*) AS n FROM orders GROUP BY 1, 2")
def p13(spark, d):
    p = F.col("o_orderpriority")
    return read(spark, d, "orders").groupBy(p, F.when(p.startswith("1"), "top").when(p.startswith("5"), "low").otherwise("mid").alias("class")).agg(F.count("*").alias("n"))


@C.add("P14_map_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def p14(spark, d):
    n = read(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


SIZE = "CASE WHEN b < 1024 THEN printf('%.1f B', round(b, 1)) WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576.0, 1)) ELSE printf('%.1f GB', round(b / 1073741824.0, 1)) END"


@C.add("P16_human_size", f"SELECT doc_id, {SIZE} AS size FROM (SELECT doc_id, (n_chars * n_chars)::DOUBLE AS b FROM documents)")
def p16(spark, d):
    return read(spark, d, "documents").select("doc_id", human_size((F.col("n_chars") * F.col("n_chars")).cast("double")).alias("size"))


@C.add("P17_json_metadata", "SELECT event_id, left(coalesce(json_extract_string(props, '$.k'), 'none'), 200) AS k FROM events")
def p17(spark, d):
    return read(spark, d, "events").select("event_id", F.substring(F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")), 1, 200).alias("k"))


@C.add("P18_map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'default' END AS kind, 'all' AS scope FROM events")
def p18(spark, d):
    base = F.create_map(F.lit("kind"), F.lit("default"), F.lit("scope"), F.lit("all"))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    return read(spark, d, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["scope"].alias("scope"))


# ---- filters


@C.add("F01_range_predicate", "SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
def f01(spark, d):
    return read(spark, d, "lineitem").filter((F.col("l_quantity") < 24) & F.col("l_discount").between(0.05, 0.07)).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@C.add("F02_membership", f"WITH {SQL_PAIRS} SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM pairs)")
def f02(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id")).join(pairs(spark, d), "id", "left_semi")


@C.add("F03_background", f"WITH {SQL_PAIRS} SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE id = p_partkey)")
def f03(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id")).join(pairs(spark, d), "id", "left_anti")


@C.add("F04_minimum_support", f"WITH {SQL_PAIRS} SELECT agent, count(*) AS n FROM pairs GROUP BY agent HAVING count(*) >= 40")
def f04(spark, d):
    return pairs(spark, d).groupBy("agent").agg(F.count("*").alias("n")).filter("n >= 40")


@C.add("F06_band_fallback", "WITH s AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1), b AS (SELECT a.size, max(a.n) AS exact, sum(b.n)::BIGINT AS band FROM s a JOIN s b ON b.size BETWEEN a.size - 1 AND a.size + 1 GROUP BY 1) SELECT size, CASE WHEN exact >= 40 THEN exact ELSE band END AS used FROM b")
def f06(spark, d):
    s = read(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    o = s.withColumn("at", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).groupBy(F.col("at").alias("size")).agg(F.sum("n").alias("band"))
    return s.join(o, "size").select("size", F.when(F.col("n") >= 40, F.col("n")).otherwise(F.col("band")).alias("used"))


POLICY = "SELECT doc_id, FALSE AS metadata_only, mb <= 0.002 AS small_files, sum(mb) OVER (PARTITION BY source) <= 0.2 AS everything FROM (SELECT doc_id, source, n_chars / 1048576.0 AS mb FROM documents)"


@C.add("F09_download_policy", POLICY)
def f09(spark, d):
    x = read(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") / 1048576.0).alias("mb"))
    total = x.groupBy("source").agg(F.sum("mb").alias("total"))
    x = x.join(total, "source")
    p = lambda policy, limit: audit.download_policy(policy, F.col("mb"), F.col("total"), limit)
    return x.select("doc_id", p("metadata_only", 1).alias("metadata_only"), p("small_files_only", 0.002).alias("small_files"), p("all", 0.2).alias("everything"))


@C.add("F12_resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def f12(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").filter("quality = 1"), "doc_id", "left_anti")


@C.add("F13_structure_check", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_row' WHEN d.n_chars = 0 THEN 'missing_file' WHEN d.n_chars < 100 THEN 'too_small' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def f13(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("has").isNull(), "missing_row").when(F.col("n_chars") == 0, "missing_file").when(F.col("n_chars") < 100, "too_small").otherwise("ok").alias("status"))


# ---- joins


@C.add("J01_inner_join", f"WITH {SQL_FEATURES} SELECT id, p_brand, round(avg_qty, 6) AS avg_qty FROM features WHERE p_size > 40")
def j01(spark, d):
    return features(spark, d).filter("p_size > 40").select("id", "p_brand", F.round("avg_qty", 6).alias("avg_qty"))


@C.add("J02_join_with_suffixes", "SELECT a.p_partkey AS id, a.p_size AS size_a, b.p_size AS size_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def j02(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size_a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_size").alias("size_b")), "id")


@C.add("J03_left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)")
def j03(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")


@C.add("J07_range_self_join", "WITH s AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1) SELECT a.size, sum(b.n)::BIGINT AS n_band FROM s a JOIN s b ON abs(a.size - b.size) <= 1 GROUP BY 1")
def j07(spark, d):
    s = read(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    near = s.select(F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("n_band"))
    return near.join(s.select("size"), "size", "left_semi")


@C.add("J13_source_pairs", f"WITH {SQL_PAIRS}, g AS (SELECT data_source, count(DISTINCT id) AS ids FROM rawpairs GROUP BY 1) SELECT a.data_source AS train, b.data_source AS test, a.ids AS train_ids, b.ids AS test_ids FROM g a JOIN g b ON a.data_source <> b.data_source WHERE b.ids >= 10")
def j13(spark, d):
    g = pairs(spark, d, distinct=False).groupBy("data_source").agg(F.countDistinct("id").alias("ids"))
    a, b = g.select(F.col("data_source").alias("train"), F.col("ids").alias("train_ids")), g.select(F.col("data_source").alias("test"), F.col("ids").alias("test_ids"))
    return a.join(b, (F.col("train") != F.col("test")) & (F.col("test_ids") >= 10)).select("train", "test", "train_ids", "test_ids")


@C.add("J14_conditional_aggregate", "SELECT l_partkey, round(max(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS a, round(max(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS n, round(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS r FROM lineitem GROUP BY 1")
def j14(spark, d):
    top = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f.lower())
    return rounded(read(spark, d, "lineitem").groupBy("l_partkey").agg(top("A"), top("N"), top("R")))


# ---- aggregates


@C.add("G01_group_sizes", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def g01(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@C.add("G02_distinct_per_group", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def g02(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@C.add("G03_normalised_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def g03(spark, d):
    n = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("event_type", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@C.add("G04_mean_std_median", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, round(median(p_retailprice), 6) AS median FROM part GROUP BY 1")
def g04(spark, d):
    return rounded(read(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("std"), F.median("p_retailprice").alias("median")))


@C.add("G05_population_moments", "SELECT p_type, round(stddev_pop(p_retailprice), 6) AS std, round(var_pop(p_size), 6) AS var FROM part GROUP BY 1")
def g05(spark, d):
    return rounded(read(spark, d, "part").groupBy("p_type").agg(F.stddev_pop("p_retailprice").alias("std"), F.var_pop("p_size").alias("var")))


@C.add("G06_group_size_summary", "SELECT min(n) AS lo, round(median(n), 6) AS mid, round(avg(n), 6) AS mean, max(n) AS hi, round(stddev_samp(n), 6) AS std FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def g06(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rounded(n.agg(F.min("n").alias("lo"), F.median("n").alias("mid"), F.avg("n").alias("mean"), F.max("n").alias("hi"), F.stddev_samp("n").alias("std")))


@C.add("G08_binned_aggregate", "SELECT CASE WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS bin, count(*) AS customers, round(avg(total), 4) AS mean_total FROM (SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) GROUP BY 1")
def g08(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return n.groupBy(ladder(F.col("n"), [(2, "2"), (5, "3-5"), (10, "6-10")], ">10").alias("bin")).agg(F.count("*").alias("customers"), F.round(F.avg("total"), 4).alias("mean_total"))


@C.add("G09_quantile_bins", "WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT CASE WHEN p_retailprice <= a THEN 1 WHEN p_retailprice <= b THEN 2 WHEN p_retailprice <= c THEN 3 ELSE 4 END AS bin, count(*) AS n, round(min(p_retailprice), 6) AS lo, round(max(p_retailprice), 6) AS hi FROM part, e GROUP BY 1")
def g09(spark, d):
    p = read(spark, d, "part").select("p_retailprice")
    edges = stats.quantiles(p, "p_retailprice", [0.25, 0.5, 0.75]).select(F.array_distinct(F.array("q0", "q1", "q2")).alias("e"))
    x = p.crossJoin(F.broadcast(edges)).withColumn("bin", (F.size(F.filter("e", lambda q: q < F.col("p_retailprice"))) + 1).cast("int"))
    return rounded(x.groupBy("bin").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))


@C.add("G10_describe", "SELECT round(min(o_totalprice), 6) AS lo, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS mid, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS hi FROM orders")
def g10(spark, d):
    o = read(spark, d, "orders").select("o_totalprice")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    inner = stats.quantiles(o, "o_totalprice", [0.25, 0.5, 0.75])
    return rounded(ends.crossJoin(F.broadcast(inner)).select("lo", F.col("q0").alias("q1"), F.col("q1").alias("mid"), F.col("q2").alias("q3"), "hi"))


STATUS = "CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'skipped' END"


@C.add("G13_index_summary", f"SELECT source, count(*) AS records, round(sum(value), 2) AS bytes, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM (SELECT 'u' || (user_id % 7) AS source, value, {STATUS} AS status FROM events) GROUP BY ROLLUP (source)")
def g13(spark, d):
    e = read(spark, d, "events")
    t = F.col("event_type")
    x = e.select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("source"), "value", F.when(t.isin("click", "view"), "ok").when(t == "error", "failed").otherwise("skipped").alias("status"))
    return rounded(audit.index_summary(x, "source", "status", "value"), 2)


@C.add("G14_top_errors", "SELECT e AS error, count(*) AS n FROM (SELECT CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END AS e FROM (SELECT coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, 'Unknown error') AS t FROM documents)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def g14(spark, d):
    x = read(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("t"))
    return audit.top_errors(x, "t", 5)


@C.add("G16_validation_rollup", "SELECT source, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS mismatch, count(*) FILTER (quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def g16(spark, d):
    x = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("mismatch"), F.count_if(F.col("quality").isNull()).alias("missing"))


@C.add("G17_annotation_density", f"WITH {SQL_PAIRS} SELECT data_source, count(*) AS n_pairs, count(DISTINCT id) AS n_ids, count(DISTINCT agent) AS n_agents, round(count(*) / count(DISTINCT id), 6) AS per_id, round(count(*) / count(DISTINCT agent), 6) AS per_agent FROM rawpairs GROUP BY 1")
def g17(spark, d):
    g = pairs(spark, d, distinct=False).groupBy("data_source").agg(F.count("*").alias("n_pairs"), F.countDistinct("id").alias("n_ids"), F.countDistinct("agent").alias("n_agents"))
    return g.select("*", F.round(F.col("n_pairs") / F.col("n_ids"), 6).alias("per_id"), F.round(F.col("n_pairs") / F.col("n_agents"), 6).alias("per_agent"))


@C.add("G18_source_characteristics", f"WITH {SQL_FEATURES}, {SQL_PAIRS} SELECT data_source, count(*) AS n, round(avg(p_retailprice), 6) AS price_mean, round(stddev_samp(p_retailprice), 6) AS price_std, round(avg(avg_qty), 6) AS qty_mean FROM (SELECT DISTINCT id, data_source FROM rawpairs) JOIN features USING (id) GROUP BY 1")
def g18(spark, d):
    x = pairs(spark, d, distinct=False).select("id", "data_source").distinct().join(features(spark, d), "id")
    return rounded(x.groupBy("data_source").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price_mean"), F.stddev_samp("p_retailprice").alias("price_std"), F.avg("avg_qty").alias("qty_mean")))


@C.add("G22_key_distribution", "WITH s AS (SELECT p_brand || '_' || p_size AS k, count(*) AS n FROM part GROUP BY 1) SELECT count(*) AS n_unique, round(avg(n), 6) AS mean_size, max(n) AS max_size, round(avg((n = 1)::INT), 6) AS singleton_share FROM s")
def g22(spark, d):
    s = read(spark, d, "part").groupBy(F.concat_ws("_", "p_brand", "p_size").alias("k")).agg(F.count("*").alias("n"))
    return rounded(s.agg(F.count("*").alias("n_unique"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"), F.avg((F.col("n") == 1).cast("int")).alias("singleton_share")))


GINI = """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, o_custkey) AS i, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM s)
SELECT count(*) AS groups, round(avg(n), 6) AS mean_size, max(n) AS largest, round(avg((n = 1)::INT), 6) AS singletons, round(sum(n * n) / pow(sum(n), 2), 6) AS hhi, round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini,
 round(sum(n) FILTER (k <= 1) / sum(n), 6) AS top1_share, round(sum(n) FILTER (k <= 5) / sum(n), 6) AS top5_share, round(sum(n) FILTER (k <= 10) / sum(n), 6) AS top10_share FROM r"""


@C.add("G23_G24_concentration", GINI)
def g23(spark, d):
    return rounded(stats.concentration(read(spark, d, "orders"), "o_custkey"))


@C.add("G25_token_coverage", "SELECT t, count(*) AS n FROM (SELECT unnest(string_split(props, ',')) AS t FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def g25(spark, d):
    return read(spark, d, "events").select(F.explode(F.split("props", ",")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(20)


@C.add("G26_joinability_funnel", "WITH x AS (SELECT quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)), f AS (SELECT count(*) AS a, count(*) FILTER (quality IS NOT NULL) AS b, count(*) FILTER (quality = 1) AS c, count(*) FILTER (quality = 1 AND toxic = 0) AS e, count(*) FILTER (quality = 1 AND toxic = 0 AND n_chars >= 500) AS g FROM x) SELECT step::INT AS step, stage, n, round(n / (SELECT a FROM f), 6) AS share FROM (SELECT 0 AS step, 'all' AS stage, a AS n FROM f UNION ALL SELECT 1, 'labelled', b FROM f UNION ALL SELECT 2, 'good', c FROM f UNION ALL SELECT 3, 'clean', e FROM f UNION ALL SELECT 4, 'long', g FROM f)")
def g26(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    good = F.col("quality") == 1
    clean = good & (F.col("toxic") == 0)
    return rounded(audit.funnel(x, [("all", F.lit(True)), ("labelled", F.col("quality").isNotNull()), ("good", good), ("clean", clean), ("long", clean & (F.col("n_chars") >= 500))]))


REASON = "CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars > 3000 THEN 'long' ELSE lang END"


@C.add("G27_failure_taxonomy", f"WITH x AS (SELECT doc_id, {REASON} AS reason FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS k FROM x) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 5) AS examples FROM r GROUP BY 1")
def g27(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return rounded(audit.taxonomy(x, F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") > 3000, "long").otherwise(F.col("lang")), "doc_id"))


@C.add("G28_grouping_sets", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def g28(spark, d):
    docs = read(spark, d, "documents").select("lang", "source")
    return docs.groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("n"))


@C.add("G32_improvement_summary", "WITH x AS (SELECT l_partkey, avg(l_discount) FILTER (l_returnflag = 'N') - avg(l_discount) FILTER (l_returnflag <> 'N') AS delta FROM lineitem GROUP BY 1) SELECT count(delta) AS n, round(avg(delta), 6) AS mean_delta, round(avg((delta > 0.005)::INT), 6) AS improved, round(avg((delta < -0.005)::INT), 6) AS degraded, round(avg((abs(delta) <= 0.005)::INT), 6) AS neutral FROM x WHERE delta IS NOT NULL")
def g32(spark, d):
    side = lambda c: F.avg(F.when(c, F.col("l_discount")))
    x = read(spark, d, "lineitem").groupBy("l_partkey").agg((side(F.col("l_returnflag") == "N") - side(F.col("l_returnflag") != "N")).alias("delta")).filter("delta is not null")
    share = lambda c: F.avg(c.cast("int"))
    return rounded(x.agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), share(F.col("delta") > 0.005).alias("improved"), share(F.col("delta") < -0.005).alias("degraded"), share(F.abs("delta") <= 0.005).alias("neutral")))


@C.add("G33_metric_table", "SELECT 'orders' AS source, 'count' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'orders', 'mean_price', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'part', 'count', count(*)::DOUBLE FROM part UNION ALL SELECT 'part', 'max_size', max(p_size)::DOUBLE FROM part")
def g33(spark, d):
    one = lambda df, s, **m: df.agg(*(c.cast("double").alias(k) for k, c in m.items())).unpivot([], list(m), "metric", "value").select(F.lit(s).alias("source"), "metric", "value")
    o = one(read(spark, d, "orders"), "orders", count=F.count("*"), mean_price=F.round(F.avg("o_totalprice"), 4))
    return o.unionByName(one(read(spark, d, "part"), "part", count=F.count("*"), max_size=F.max("p_size")))


@C.add("G34_G35_correlation_fit", "SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS r, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part GROUP BY 1")
def g34(spark, d):
    g = read(spark, d, "part").groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"), F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("intercept"))
    return g


@C.add("G36_first_per_group", "SELECT p_brand, round(max(p_retailprice), 6) AS top, min_by(p_type, p_partkey) AS first_type FROM part GROUP BY 1")
def g36(spark, d):
    return rounded(read(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("top"), F.min_by("p_type", "p_partkey").alias("first_type")))


# ---- order and sets


@C.add("O02_order_by_absolute", "SELECT c_custkey, round(c_acctbal, 6) AS bal FROM customer ORDER BY abs(c_acctbal - 4500), c_custkey LIMIT 15")
def o02(spark, d):
    return rounded(read(spark, d, "customer").orderBy(F.abs(F.col("c_acctbal") - 4500), "c_custkey").limit(15).select("c_custkey", F.col("c_acctbal").alias("bal")))


@C.add("O03_most_common", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def o03(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


_SETS = {"union": ("U01_union", "UNION"), "intersect": ("U02_intersection", "INTERSECT"), "subtract": ("U03_difference", "EXCEPT")}


def _set_query(op):
    def run(spark, d):
        a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).filter("k < 18")
        b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).filter("k > 6")
        return getattr(a, op)(b).distinct()

    return run


for _op, (_name, _word) in _SETS.items():
    C.add(_name, f"SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 18 {_word} SELECT s_nationkey FROM supplier WHERE s_nationkey > 6")(_set_query(_op))


@C.add("U04_concat_missing_columns", "SELECT n_nationkey AS k, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def u04(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.unionByName(read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), allowMissingColumns=True)


@C.add("U05_drop_duplicates", f"WITH {SQL_PAIRS} SELECT DISTINCT id, data_source FROM rawpairs")
def u05(spark, d):
    return pairs(spark, d, distinct=False).select("id", "data_source").distinct()


@C.add("U06_jaccard_of_sets", f"WITH {SQL_PAIRS}, s AS (SELECT DISTINCT data_source, id FROM rawpairs), n AS (SELECT data_source, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.data_source AS a, b.data_source AS b, count(*) AS c FROM s a JOIN s b ON a.id = b.id AND a.data_source < b.data_source GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM i JOIN n x ON x.data_source = a JOIN n y ON y.data_source = b")
def u06(spark, d):
    s = pairs(spark, d, distinct=False).select("data_source", "id").distinct()
    n = s.groupBy("data_source").agg(F.count("*").alias("n"))
    a, b = s.select(F.col("data_source").alias("a"), "id"), s.select(F.col("data_source").alias("b"), "id")
    i = a.join(b, "id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    x = i.join(n.select(F.col("data_source").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("data_source").alias("b"), F.col("n").alias("nb")), "b")
    return x.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@C.add("U07_leakage_check", f"WITH {SQL_PAIRS}, tr AS (SELECT DISTINCT id FROM pairs WHERE id % 4 <> 0), te AS (SELECT DISTINCT id FROM pairs WHERE id % 4 = 0) SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test, (SELECT count(*) FROM tr JOIN te USING (id)) AS shared, (SELECT count(*) FROM tr JOIN te USING (id)) = 0 AS valid")
def u07(spark, d):
    sides = pairs(spark, d).groupBy("id").agg(F.max((F.col("id") % 4 != 0).cast("int")).alias("tr"), F.max((F.col("id") % 4 == 0).cast("int")).alias("te"))
    shared = F.sum(F.col("tr") * F.col("te")).cast("long")
    return sides.agg(F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"), shared.alias("shared"), (shared == 0).alias("valid"))


# ---- scalar functions over records


@C.add("X18_error_classes", "SELECT event_id, CASE WHEN e LIKE '%timeout%' THEN 'timeout' WHEN e LIKE '%404%' THEN 'not_found' WHEN e LIKE '%403%' THEN 'forbidden' WHEN e LIKE '%connection%' THEN 'network' WHEN e LIKE '%parse%' THEN 'parse' WHEN e LIKE '%memory%' THEN 'resource' WHEN e LIKE '%unsupported%' THEN 'unsupported' ELSE 'unknown' END AS category FROM (SELECT event_id, lower(CASE event_id % 5 WHEN 0 THEN 'Timeout ' WHEN 1 THEN 'HTTP 404 ' WHEN 2 THEN 'Parse error ' ELSE '' END || event_type) AS e FROM events)")
def x18(spark, d):
    k = F.col("event_id") % 5
    text = F.concat(F.when(k == 0, "Timeout ").when(k == 1, "HTTP 404 ").when(k == 2, "Parse error ").otherwise(""), F.col("event_type"))
    return read(spark, d, "events").select("event_id", audit.classify(text).alias("category"))


@C.add("X20_sanitised_id", "SELECT doc_id, left(replace(left(text, 200), ' ', '_'), 100) AS item FROM documents")
def x20(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring(F.replace(F.substring("text", 1, 200), F.lit(" "), F.lit("_")), 1, 100).alias("item"))


@C.add("X22_percent_text", "SELECT event_type, printf('%.1f%%', 100.0 * count(*) / (SELECT count(*) FROM events)) AS pct FROM events GROUP BY 1")
def x22(spark, d):
    e = read(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("event_type", F.format_string("%.1f%%", 100.0 * F.col("n") / F.col("t")).alias("pct"))


@C.add("X23_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, year(ts)::INT AS y, dayofyear(ts)::INT AS doy FROM events")
def x23(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.year("ts").alias("y"), F.dayofyear("ts").alias("doy"))


@C.add("X26_class_prior", f"WITH {SQL_PAIRS}, n AS (SELECT agent, count(*) AS n FROM pairs GROUP BY 1) SELECT agent, f AS completeness, round(n / (SELECT count(*) FROM part) / f, 6) AS prior FROM n, (VALUES (1.0::DOUBLE), (0.8), (0.5), (0.2)) v(f)")
def x26(spark, d):
    n = pairs(spark, d).groupBy("agent").agg(F.count("*").alias("n")).crossJoin(F.broadcast(read(spark, d, "part").agg(F.count("*").alias("t"))))
    return n.select("agent", "n", "t", F.explode(F.array(*map(F.lit, (1.0, 0.8, 0.5, 0.2)))).alias("completeness")).select("agent", "completeness", F.round(F.col("n") / F.col("t") / F.col("completeness"), 6).alias("prior"))


# A user's events of one type are its attempts; each waits twice as long as the one before, at most a minute, and up to a tenth more.
ATTEMPT = "row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1"


@C.add("X28_backoff", f"WITH a AS (SELECT event_id, {ATTEMPT} AS attempt FROM events), b AS (SELECT *, least(pow(2.0, least(attempt, 40)), 60.0) AS base, ('0x' || substr(md5('28|' || event_id || '|' || attempt), 1, 8))::BIGINT / 4294967296.0 AS u FROM a) SELECT event_id, attempt, round(base, 6) AS base, round(base * (1 + 0.1 * u), 6) AS delay FROM b")
def x28(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    a = read(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("attempt"))
    base = F.least(F.pow(F.lit(2.0), F.least("attempt", F.lit(40))), F.lit(60.0))
    return a.select("event_id", "attempt", F.round(base, 6).alias("base"), F.round(base * (1 + 0.1 * hash_uniform(28, "event_id", "attempt")), 6).alias("delay"))


@C.add("P15_falsy_default", "SELECT event_id, coalesce(nullif(props, ''), 'none') AS p FROM events")
def p15(spark, d):
    return read(spark, d, "events").select("event_id", F.nullif(falsy(F.col("props")), F.lit("")).alias("p")).withColumn("p", F.coalesce("p", F.lit("none")))
