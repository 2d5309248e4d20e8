"""Experiment pages of an array registry: which links are experiments, their ids, and what a page says of lectin, version and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import first_match, join_url

# Patterns in order of preference, tried without regard to case.
LINKS = (r"primscreen/\d+", r"experiment[_/]\d+", r"exp[_/]?\d+", r"request[_/]?\d+", r"cfg\d+", r"pa\d+")
IDS = (r"primscreen/(\d+)", r"experiment[_/](\d+)", r"exp[_/]?(\d+)", r"request[_/]?(\d+)", r"(cfg\d+)", r"(pa\d+)")
LECTINS = (r"lectin[:\s]+([A-Za-z0-9\-]+)", r"protein[:\s]+([A-Za-z0-9\-]+)", r"sample[:\s]+([A-Za-z0-9\-]+)")
VERSIONS = (r"array\s+v(?:ersion)?\s*([0-9.]+)", r"v([0-9.]+)\s+array", r"version\s*([0-9.]+)")
DATES = (r"(\d{1,2}/\d{1,2}/\d{2,4})", r"(\d{4}-\d{2}-\d{2})", r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})")

ROW, CELL, ITEM = r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", r"(?is)<li\b[^>]*>(.*?)</li>"
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
TARGET, TAG = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", r"(?s)<[^>]*>"


def any_case(patterns: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"(?i){p}" for p in patterns)


def is_experiment(href: Column, text: Column) -> Column:
    return F.concat_ws(" ", href, text).rlike("(?i)" + "|".join(LINKS))


def experiment_id(href: Column, text: Column) -> Column:
    """The first pattern's id, else `exp_` and the first number of link and text; null where there is none."""
    both = F.concat_ws(" ", href, text)
    return F.coalesce(first_match(both, *any_case(IDS)), F.concat(F.lit("exp_"), F.nullif(F.regexp_extract(both, r"\d+", 0), F.lit(""))))


def page_metadata(text: Column) -> dict[str, Column]:
    return {"lectin": first_match(text, *any_case(LECTINS)), "array_version": first_match(text, *any_case(VERSIONS)), "experiment_date": first_match(text, *any_case(DATES))}


def _first_anchor(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, ANCHOR, 0), F.lit(""))


def anchors(html: Column) -> dict[str, Column]:
    """Anchors in page order by layout: the first of each cell of table rows with two cells or more, the first of each list item, all."""
    cells = F.transform(F.regexp_extract_all(html, F.lit(ROW), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(CELL), F.lit(1)))
    table = F.transform(F.flatten(F.filter(cells, lambda c: F.size(c) >= 2)), _first_anchor)
    items = F.transform(F.regexp_extract_all(html, F.lit(ITEM), F.lit(1)), _first_anchor)
    return {"table": F.filter(table, lambda a: a.isNotNull()), "list": F.filter(items, lambda a: a.isNotNull()), "any": F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))}


def experiments(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, layout, id, url, name): experiments that a page links to, by the first layout that shows any; the first link of an id
    stands for it in tables and among loose links, lists keep all."""
    found = None
    for order, (layout, links) in enumerate(anchors(F.col(html)).items()):
        a = pages.select(key, F.col(url).alias("base"), F.lit(order).alias("o"), F.lit(layout).alias("layout"), F.posexplode(links).alias("at", "a"))
        found = a if found is None else found.unionByName(a)
    href, name = F.regexp_extract("a", TARGET, 1), F.trim(F.regexp_replace("a", TAG, ""))
    shown = found.withColumns({"href": href, "name": name}).filter(is_experiment(F.col("href"), F.col("name")))
    shown = shown.withColumn("id", experiment_id(F.col("href"), F.col("name"))).filter("id is not null")
    # A page's links are few: they meet by page, and the first layout's stay.
    best = shown.groupBy(key).agg(F.min("o").alias("o"))
    kept = shown.join(best, [key, "o"])
    place = F.when(F.col("layout") == "list", F.col("at")).otherwise(F.lit(-1))
    first = kept.groupBy(key, "layout", "id", place.alias("place")).agg(F.min(F.struct("at", "base", "href", "name")).alias("f"))
    return first.select(key, "layout", "id", join_url(F.col("f.base"), F.col("f.href")).alias("url"), "f.name")
