"""Interaction audit of five text filters: survivors of every subset of filters by one SQL CUBE, steps of every order as pairs of subsets.

Null texts count as empty, null sources as the part ''. Rows without an id, or whose id has no label, are neither good nor toxic;
where an id has several labels, one that says 1 is enough. Filter E fails a row whose text a smaller id has, anywhere in the table;
rows without an id neither fail it nor make others fail. Repeated rows count each time. An empty table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table

FILTERS = "ABCDE"
COUNTS = ["n", "good", "toxic"]
EVERY = (1 << len(FILTERS)) - 1


def text_flags(text: F.Column) -> dict[str, F.Column]:
    """Failure conditions A to D of a text; words are runs without ASCII white space."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A..E, n, good, toxic): counts of rows by part and the filters that they fail.

    Texts end in the first map: a row is a digest, its id and its flags from there on, equal rows counted together. Copies of a
    text meet as partial counts and minima by (digest, part), never as rows of one group.
    """
    text = F.coalesce("text", F.lit(""))
    flags = text_flags(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *(f.alias(c) for c, f in flags.items()))
    each = rows.groupBy("digest", "id", "part", *flags).agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without an id have no label; in the join they would be one key.
    named = each.filter("id is not null").join(marks, "id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    each = named.unionByName(each.filter("id is null").withColumns({k: F.lit(False) for k in ("good", "toxic")}))
    keys = ["part", *flags, "good", "toxic"]
    groups = each.groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    passed = F.col("free") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("E"), passed.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passed).alias("n")))
    split = groups.withColumn("first", first).select(*keys, F.explode(both).alias("s")).select(*keys, "s.E", "s.n").filter("n > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", *FILTERS).agg(only("good").alias("good"), only("toxic").alias("toxic"), F.sum("n").alias("n"))


def survivors(found: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): rows that no filter of the subset (a bit mask) removes, zeros included.

    In the cube, a flag that is not grouped is null: a row whose grouped flags are all false counts what passes those filters.
    """
    cube = found.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("all_parts"))
    passing = cube.filter("all_parts = 0").filter(" and ".join(f"({c} is null or not {c})" for c in FILTERS))
    subset = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    parts = found.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(EVERY))))
    return parts.join(passing.select("part", subset.alias("subset"), *COUNTS), ["part", "subset"], "left").fillna(0, COUNTS)


def steps(spark: SparkSession) -> DataFrame:
    """The 600 steps (order, step, filter, subset before, subset after) of the 120 orders."""
    rows = []
    for order in permutations(FILTERS):
        done = 0
        for i, c in enumerate(order):
            bit = 1 << FILTERS.index(c)
            rows.append(("".join(order), i + 1, bit, done, done | bit))
            done |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step. Pairs of subsets (before and after the step) are joined by part."""
    spark = docs.sparkSession
    left = stage(survivors(cells(docs, labels)), "filter-survivors")  # 32 rows a part, read by six joins
    named = lambda at: left.select("part", F.col("subset").alias(at), *(F.col(c).alias(f"{at}_{c}") for c in COUNTS))
    walk = named("after").join(F.broadcast(steps(spark)), "after").join(named("before"), ["part", "before"])
    # Of each filter: what fails it at all, and what fails nothing else.
    alone = left.filter("subset = 0").select("part", F.col("n").alias("total")).join(left.select("part", F.col("subset").alias("bit"), F.col("n").alias("n_alone")), "part")
    others = left.select("part", (F.lit(EVERY) - F.col("subset")).alias("bit"), F.col("n").alias("n_others"))
    last = left.filter(F.col("subset") == EVERY).select("part", F.col("n").alias("n_all"))
    figures = alone.join(others, ["part", "bit"]).join(last, "part")
    x = walk.join(figures, ["part", "bit"]).withColumn("removed", F.col("before_n") - F.col("after_n"))
    return x.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("total") - F.col("n_alone") - F.col("removed")).alias("redundant"), (F.col("n_others") - F.col("n_all")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}

_ORDERS = ", ".join("('" + "".join(o) + "')" for o in permutations(FILTERS))
_FAILS = "CASE substr(filter_order, {}, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
# Filters are applied row by row in every order, without subsets.
SQL = {
    "op12_filter_audit": f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, len(words) < 50 AS a, 100 * list_unique(words) < 65 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, FALSE) AS e,
  coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM w LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
 o AS (SELECT * FROM (VALUES {_ORDERS}) v(filter_order)),
 x AS (SELECT part, filter_order, n, good, toxic, (a::INT + b::INT + c::INT + d::INT + e::INT) AS fails, [{', '.join(_FAILS.format(i) for i in range(1, 6))}] AS bad FROM g, o),
 y AS (SELECT *, unnest(generate_series(1, 5)) AS step FROM x),
 s AS (SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT list_contains(bad[:step], TRUE)), 0) AS kept, coalesce(sum(n) FILTER (bad[step] AND NOT list_contains(bad[:step - 1], TRUE)), 0) AS removed,
  coalesce(sum(n) FILTER (bad[step] AND list_contains(bad[:step - 1], TRUE)), 0) AS redundant, coalesce(sum(n) FILTER (bad[step] AND fails = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (bad[step] AND NOT list_contains(bad[:step - 1], TRUE)), 0) AS good_lost, coalesce(sum(toxic) FILTER (bad[step] AND NOT list_contains(bad[:step - 1], TRUE)), 0) AS toxic_lost FROM y GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM s"""
}
