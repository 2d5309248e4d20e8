"""Readers and writers on small files, and windows on a stream."""

import json

from pyspark.sql import functions as F

from tidemark.sources import records
from tidemark.streaming import windows


def test_log_with_old_names_and_blank_lines(spark, tmp_path):
    f = tmp_path / "log.jsonl"
    f.write_text(json.dumps({"source": "s", "glytoucan_id": "G1", "file_size": "12", "status": "ok", "failure_reason": ""}) + "\n\n" + json.dumps({"source": "s", "source_item_id": "G2", "glytoucan_id": "X", "bytes": 7}) + "\n")
    r = {x.source_item_id: x for x in records.download_log(spark, str(f)).collect()}
    assert r["G1"].bytes == 12 and r["G1"].error == "" and r["G2"].bytes == 7 and "glytoucan_id" not in r["G1"].asDict()


def test_log_append(spark, tmp_path):
    df = spark.createDataFrame([("s", "G1", "ok")], "source string, source_item_id string, status string")
    for _ in range(2):
        records.append_log(df, str(tmp_path / "log"))
    assert records.download_log(spark, str(tmp_path / "log")).count() == 2


def test_manifest_round_trip_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("G1", 'two\nlines "quoted"', "x")], "source_item_id string, error string, a string")
    records.write_manifest(df, str(tmp_path / "m"), ["source_item_id"])
    got = records.manifest(spark, str(tmp_path / "m"))
    assert got.columns == ["source_item_id", "a", "error"] and got.first().error == 'two\nlines "quoted"'


def test_bindings(spark, tmp_path):
    f = tmp_path / "r.json"
    f.write_text(json.dumps({"results": {"bindings": [{"accession": {"value": "G1"}, "wurcs": {"value": "W"}}, {"accession": {"value": "G2"}}]}}))
    assert sorted((r.accession, r.wurcs) for r in records.bindings(spark, str(f), ["accession", "wurcs"]).collect()) == [("G1", "W"), ("G2", None)]


def test_molecule_columns(spark, tmp_path):
    line = "ATOM      1  C1  GLC A   7      11.104   6.134  -6.504  1.00  0.00           C"
    (tmp_path / "G1.pdb").write_text(f"HEADER x\n{line}\nTER\n")
    r = records.molecule_atoms(spark, str(tmp_path)).collect()
    assert [(x.mol, x.chain, x.res, x.seq, x.x, x.y, x.z) for x in r] == [("G1", "A", "A:7:GLC", 7, 11.104, 6.134, -6.504)]


def test_first_folder_wins(spark, tmp_path):
    for folder, size in (("a", 50), ("b", 200), ("c", 300)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "G1.pdb").write_bytes(b"x" * size)
    r = records.usable_files(spark, [str(tmp_path / f) for f in "abc"]).collect()
    assert [(x.id, x.length) for x in r] == [("G1", 200)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), e.schema), "1 hour")
    q = s.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("hours").select(cols).collect())) == sorted(map(tuple, windows.tumbling(e, "1 hour").select(cols).collect()))


def test_duplicate_arrivals_count_once(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.unionByName(e).repartition(2).write.parquet(str(tmp_path / "in"))
    s = windows.distinct_events(windows.event_stream(spark, str(tmp_path / "in"), e.schema), "10 minutes")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select(F.countDistinct("event_id")).first()[0]
