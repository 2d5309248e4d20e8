import json

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import stats
from tidemark.sources import results, transfer

FIELDS = {"n": ("n", "bigint"), "mean": ("mrr.mean", "double"), "when": ("when", "string")}


def test_files_of_all_kinds(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    document = json.dumps({"n": 3, "mrr": {"mean": float("nan")}, "when": "now", "more": [1]}, indent=1)
    files = {
        "nan": put("a.json", document), "quoted": put("b.json", '{"n": "7", "mrr": {"mean": "0.5"}}'), "drift": put("c.json", '{"n": "many", "mrr": 3, "when": {"a": 1}}'),
        "broken": put("d.json", '{"n": 3, '), "empty": put("e.json", ""), "inf": put("f.json", '{"n": 1, "mrr": {"mean": -Infinity}}'),
        "csv": put("a.csv", 'when,"mrr.mean",n\n"a, ""b""\nc",0.25,4\nx,1,5\n'), "header": put("b.csv", "n,when\n"), "nothing": put("c.csv", ""), "other": put("d.csv", "N2,z\n1,2\n"),
    }
    gone = str(tmp_path / "gone.json")
    got = results.results(spark, {**{k: [gone, v] for k, v in files.items()}, "absent": [gone]}, FIELDS)
    assert got.dtypes == [("source", "string"), ("file", "string"), ("n", "bigint"), ("mean", "double"), ("when", "string")]
    rows = {r.source: (r.n, r["mean"], r.when) for r in got.collect()}
    nothing = (None, None, None)
    assert rows == {
        "nan": (3, None, "now"), "quoted": (7, 0.5, None), "drift": (None, None, '{"a":1}'), "broken": rows["broken"], "empty": nothing, "inf": (1, None, None),
        "csv": (4, 0.25, 'a, "b"\nc'), "header": nothing, "nothing": nothing, "other": nothing, "absent": nothing,
    }
    assert rows["broken"][1:] == (None, None)
    assert {r.source: r.file for r in got.collect()}["absent"] is None
    # The first of the files that exists counts.
    assert results.results(spark, {"x": [gone, files["csv"], files["quoted"]]}, FIELDS).first().n == 4
    with pytest.raises(ValueError):
        results.results(spark, {}, FIELDS)


def test_transfer_manifest_round_trip(spark, tmp_path):
    rows = [(1, 7, "train"), (1, 7, "train"), (2, 7, "train"), (1, 8, "test"), (3, 7, "test"), (None, 9, "test")]
    sides = spark.createDataFrame(rows, "id long, agent long, side string")
    path = str(tmp_path / "t")
    transfer.save_transfer(sides, path, "A", "N", 5, {"k": "v"})
    members, manifest = transfer.load_transfer(spark, path)
    assert {(m.kind, m.member, m.in_train, m.in_test) for m in members.collect()} == {("id", "1", True, True), ("id", "2", True, False), ("id", "3", False, True), ("agent", "7", True, True), ("agent", "8", False, True), ("agent", "9", False, True)}
    assert manifest.first().asDict() == {"source_train": "A", "source_test": "N", "seed": 5, "n_train_ids": 2, "n_test_ids": 2, "n_id_overlap": 1, "n_train_agents": 1, "n_test_agents": 3, "n_agent_overlap": 1, "metadata": {"k": "v"}}
    members.filter("member <> '3'").write.partitionBy("kind").parquet(str(tmp_path / "less"))
    (tmp_path / "t" / "members").rename(tmp_path / "was")
    (tmp_path / "less").rename(tmp_path / "t" / "members")
    with pytest.raises(PySparkException, match="members and counts differ"):
        transfer.load_transfer(spark, path)[1].collect()


def test_transfer_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, agent long, side string")
    transfer.save_transfer(empty, str(tmp_path / "t"), "A", "N")
    members, manifest = transfer.load_transfer(spark, str(tmp_path / "t"))
    assert members.count() == 0 and manifest.first().n_train_ids == 0 and manifest.first().metadata == {}


def test_placement_by_both_rules(spark):
    gains = {"main": [1.5] * 30, "less": [1.3] * 16 + [1.05] * 14, "small": [1.08] * 30, "few": [9.0] + [1.0] * 29, "same": [1.0] * 30}
    rows = [(k, 0.1 + i / 100, (0.1 + i / 100) * g) for k, v in gains.items() for i, g in enumerate(v)]
    rows += [("main", None, 1.0), ("main", 1.0, None), ("nought", 0.0, 0.5)]
    got = {r.k: r for r in stats.placement(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ["k"]).collect()}
    assert {k: r.decision for k, r in got.items()} == {"main": "MAIN_TEXT", "less": "SUPPLEMENTARY", "small": "BRIEF_MENTION", "few": "BRIEF_MENTION", "same": "BRIEF_MENTION", "nought": "BRIEF_MENTION"}
    assert got["main"].n == 30 and got["same"].p is None and got["nought"].relative_gain is None and round(got["less"].pct_improved, 6) == round(1600 / 30, 6)
