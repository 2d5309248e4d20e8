from tidemark.operators import splits
from tidemark.sources import manifests


def test_split_round_trip(spark, tmp_path):
    sides = splits.iid_split(spark.range(50).withColumnRenamed("id", "k"), "k", 0.2, 3)
    manifests.save_split(sides, "k", str(tmp_path / "s"), {"seed": "3", "type": "iid"})
    got, meta = manifests.load_split(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, got.select("k", "side").collect())) == sorted(map(tuple, sides.collect()))
    assert meta["counts"] == {"test": 10, "train": 40} and meta["metadata"] == {"seed": "3", "type": "iid"}
    assert manifests.validate_split(got, "k") == {"train": 40, "test": 10, "shared": 0, "valid": True}


def test_leak_and_empty_side(spark):
    leak = spark.createDataFrame([(1, "train"), (1, "test"), (2, "test")], "k long, side string")
    assert not manifests.validate_split(leak, "k")["valid"] and manifests.validate_split(leak, "k", may_overlap=True)["valid"]
    assert not manifests.validate_split(leak.filter("side = 'test'"), "k")["valid"]


def test_nested_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "k long, a array<int>")
    manifests.save_tables({"t": df}, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).first().a == "[1,2]"
    assert spark.read.parquet(str(tmp_path / "t.parquet")).first().a == [1, 2]
