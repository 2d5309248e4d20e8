"""Shared inputs of the queries: the roles that the driver's tables play, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries of one module with their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FEATURES = ["p_size", "p_retailprice", "n_lines", "avg_qty", "sd_qty", "avg_disc", "avg_tax", "avg_ship"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide features of parts: two from `part`, six aggregates of `lineitem`."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.avg("l_quantity").alias("avg_qty"), F.stddev_pop("l_quantity").alias("sd_qty"),
        F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"), F.avg("l_linenumber").alias("avg_ship"),
    )
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand", "p_type")
    return parts.join(lines, F.col("id") == F.col("l_partkey")).drop("l_partkey")


def pairs(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Positive pairs (id, agent, data_source) of parts and nations; with `distinct`, each (id, agent) once."""
    lines = read(spark, sf_dir, "lineitem").filter((F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 45))
    found = lines.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("id"), F.col("s_nationkey").alias("agent"), F.col("l_returnflag").alias("data_source"))
    return found.select("id", "agent").distinct() if distinct else found


SQL_FEATURES = """features AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice, p_brand, p_type, n_lines, avg_qty, sd_qty, avg_disc, avg_tax, avg_ship FROM part JOIN (
  SELECT l_partkey, count(*)::DOUBLE AS n_lines, avg(l_quantity) AS avg_qty, stddev_pop(l_quantity) AS sd_qty, avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax, avg(l_linenumber) AS avg_ship FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""
SQL_PAIRS = """rawpairs AS (SELECT l_partkey AS id, s_nationkey AS agent, l_returnflag AS data_source FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount >= 0.09 AND l_quantity >= 45),
 pairs AS (SELECT DISTINCT id, agent FROM rawpairs)"""


def sql_z(cols: list[str], source: str = "features", out: str = "z") -> str:
    """A common table of z-scores of `cols`."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS z_{c}" for c in cols)
    return f"{out} AS (SELECT {source}.*, {z} FROM {source}, (SELECT {stats} FROM {source}))"


SQL_METRICS = """SELECT {g}, count(*) AS n_pos, round(1.0 / min(rank), 6) AS mrr_best, round(avg(1.0 / rank), 6) AS mrr_mean, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 3)::INT), 6) AS recall_3, round(avg((rank <= 5)::INT), 6) AS recall_5,
 round(avg((rank <= 10)::INT), 6) AS recall_10, round(avg((rank <= 20)::INT), 6) AS recall_20, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank,
 CASE WHEN count(*) < max(n) THEN round(avg(tp_above / n_above), 6) END AS ap FROM ranked WHERE positive GROUP BY {g}"""


def sql_ranked(groups: str, source: str = "scored") -> str:
    """A common table `ranked` with rank, counts at or above each score, and group sizes."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY {groups} ORDER BY score DESC) AS n_above,
 sum(positive::INT) OVER (PARTITION BY {groups} ORDER BY score DESC) AS tp_above, count(*) OVER (PARTITION BY {groups}) AS n FROM {source})"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """`df` with all doubles rounded."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_mixed(value: str, out: str) -> str:
    """Columns that end with `out`: the finaliser of 32-bit murmur hashes, of an unsigned 64-bit `value` below 2**32."""
    step = lambda c, k, times: f"(xor({c}, {c} >> {k}) * {times}::UBIGINT) & 4294967295::UBIGINT"
    return f"{value} AS {out}0, {step(out + '0', 16, 0x85EBCA6B)} AS {out}1, {step(out + '1', 13, 0xC2B2AE35)} AS {out}2, xor({out}2, {out}2 >> 16) AS {out}"


def sql_bootstrap(groups: str, seed: int, stat: str, repeats: int = 1000, source: str = "x") -> str:
    """A common table `b` (groups, rep, m) of `repeats` bootstrap samples of `source` (groups, v, o), for groups of one block."""
    text = " || '|' || ".join(g.strip() for g in groups.split(","))
    return f"""bn AS (SELECT {groups}, v, row_number() OVER (PARTITION BY {groups} ORDER BY o % 256, o) - 1 AS slot, count(*) OVER (PARTITION BY {groups}) AS n FROM {source} WHERE v IS NOT NULL),
 bg AS (SELECT {groups}, n, ('0x' || substr(md5({text}), 1, 8))::UBIGINT AS key FROM bn WHERE slot = 0),
 bs AS (SELECT {groups}, n, rep, {sql_mixed(f"({seed * 100_000} + rep)::UBIGINT", "r")}, {sql_mixed("xor(key, r)", "a")}, {sql_mixed("(a + 2654435769::UBIGINT) & 4294967295::UBIGINT", "h")} FROM bg, range({repeats}) t(rep)),
 bd AS (SELECT {groups}, bs.rep, {sql_mixed("(a + i::UBIGINT) & 4294967295::UBIGINT", "c")}, {sql_mixed("xor(c, h)", "d")}, ((d * bs.n::UBIGINT) >> 32)::BIGINT AS slot FROM bs JOIN (SELECT {groups}, slot AS i FROM bn) USING ({groups})),
 b AS (SELECT {groups}, rep, {stat}(v) AS m FROM bd JOIN bn USING ({groups}, slot) GROUP BY {groups}, rep)"""


SQL_INTERVAL = "avg(m) AS mean, stddev_pop(m) AS std, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi"


def sql_tail(z: str) -> str:
    """Upper tail of the normal distribution in SQL: a power series below 3, a continued fraction beyond."""
    series, fraction = "1.0", f"(abs({z}) + 8)"
    for k in range(45, 0, -1):
        series = f"(1 + {z} * {z} / {2 * k + 1} * {series})"
    for k in range(60, 0, -1):
        fraction = f"(abs({z}) + {k} / {fraction})"
    density = f"exp(-{z} * {z} / 2) / sqrt(2 * pi())"
    return f"CASE WHEN abs({z}) < 3 THEN 0.5 - {density} * {z} * {series} WHEN {z} > 0 THEN {density} / {fraction} ELSE 1 - {density} / {fraction} END"
