"""Each pattern of the array pages, in its order, and layouts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import array_pages

CASES = [
    ("/primscreen/12", "x", "12"), ("experiment_13", "x", "13"), ("Experiment/14", "x", "14"), ("exp15", "x", "15"), ("EXP/16", "x", "16"), ("request17", "x", "17"), ("request_18", "x", "18"),
    ("a/CFG19", "x", "CFG19"), ("a/pa20", "x", "pa20"), ("pa21", "primscreen/22", "22"), ("cfg23", "exp_24", "24"), ("other?n=25", "x", "exp_25"), ("other", "x", None),
]


def test_links_and_ids(spark):
    df = spark.createDataFrame(CASES, "href string, text string, want string")
    rows = df.select("want", "href", array_pages.is_experiment(F.col("href"), F.col("text")).alias("hit"), array_pages.experiment_id(F.col("href"), F.col("text")).alias("id")).collect()
    assert [r.id for r in rows] == [r.want for r in rows] and [r.hit for r in rows] == [not h.startswith("other") for h, _, _ in CASES]


@pytest.mark.parametrize("text, want", [
    ("Lectin: SNA-1, array version 5.1, 3/4/2009", ("SNA-1", "5.1", "3/4/2009")), ("sample ConA protein: PNA v4.2 array 2011-02-03", ("PNA", "4.2", "2011-02-03")),
    ("Sample\tW1 version 3 on Mar 5, 2012", ("W1", "3", "Mar 5, 2012")), ("December 1 2010 and 1/2/10", (None, None, "1/2/10")), ("", (None, None, None)),
])
def test_metadata(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in array_pages.page_metadata(F.col("t")).items())).first()
    assert tuple(r) == want


def test_layouts(spark):
    table = "<table><tr><th>Id</th><td><a href='/exp/1'>one</a><a href='/exp/9'>second of a cell</a></td></tr><tr><td>x</td><td><A HREF=\"exp/1\">again</A></td></tr><tr><td><a href='/exp/8'>lone cell</a></td></tr></table>"
    items = "<ul><li><a href='/exp/2'>two</a></li><li>plain</li><li><a href='/exp/2'>two again</a></li></ul>"
    pages = [(1, table + items), (2, items + "<a href='/exp/7'>loose</a>"), (3, "<p><a href='cfg3'><b>three</b></a> <a href='cfg3'>3</a> <a href='about'>no</a></p>"), (4, "<p>none</p>"), (5, None)]
    df = spark.createDataFrame([(i, f"http://h.org/d/p{i}.html?q", h) for i, h in pages], "page_id int, url string, html string")
    got = sorted((r.page_id, r.layout, r.id, r.url, r.name) for r in array_pages.experiments(df).collect())
    assert got == [
        (1, "table", "1", "http://h.org/exp/1", "one"), (2, "list", "2", "http://h.org/exp/2", "two"), (2, "list", "2", "http://h.org/exp/2", "two again"), (3, "any", "cfg3", "http://h.org/d/cfg3", "three"),
    ]
