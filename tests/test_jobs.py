"""Feature jobs over molecule files, staged runs that are killed, and bootstraps over several blocks."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, feature_job
from tidemark.sources import molecules
from tidemark.streaming import staged

LINE = "HETATM{:5d}  C1  {:3s} {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00"


def put(root, mol, rows=None, text=None, meta=None):
    (root / mol).mkdir(parents=True)
    text = "\n".join(LINE.format(i + 1, *r) for i, r in enumerate(rows)) if text is None else text
    (root / mol / "structure_1.pdb").write_text(text)
    if meta is not None:
        (root / mol / "meta.json").write_text(meta)


CHAIN = [("GLC", "A", k, 3.8 * k + a, 0.5 * a, 0.0) for k in range(5) for a in (0.0, 1.2, 2.4)]


@pytest.fixture
def roots(tmp_path):
    a, b = tmp_path / "first", tmp_path / "second"
    put(a, "G1", CHAIN)
    put(a, "G2", text="x" * 50)  # too small: the second root's stands
    put(b, "G2", CHAIN[:3])
    put(a, "G3", CHAIN, meta=json.dumps({"status": "failed"}))
    put(a, "G4", text="ATOM      1  C1  GLC A   1       1.0.0   0.000   0.000  1.00  0.00\n" * 3)
    put(a, "G5", text="HEADER " * 40)
    put(a, "G6", CHAIN, meta="not json")
    put(b, "G1", CHAIN[:3])  # shadowed by the first root's
    (a / "G7").mkdir()
    (a / "G8").mkdir()
    (a / "G8" / "structure_1.pdb").write_bytes(b"ATOM  \xff\xfe" * 30)
    return [str(a), str(b), str(tmp_path / "absent")]


def test_molecule_source(spark, roots):
    rows = molecules.read_molecules(spark, roots).collect()
    seen = {m: [r for r in rows if r.mol == m] for m in {r.mol for r in rows}}
    assert set(seen) == {"G1", "G2", "G4", "G5", "G6", "G8"}
    assert [len(seen[m]) for m in ("G1", "G2", "G6")] == [15, 3, 15] and {r.source_dir for r in seen["G2"]} == {"second"} and {r.source_dir for r in seen["G1"]} == {"first"}
    assert [seen[m][0].failure_reason for m in ("G4", "G5", "G8")] == ["parse_error", "feature_computation_error", "parse_error"]
    one = seen["G1"][3]
    assert (one.atom, one.chain, one.res, one.seq, one.x) == (3, "A", "A:1:GLC", 1, 3.8)


def test_partitions_follow_file_sizes(spark, roots):
    reader = molecules.MoleculeReader(roots, 100, 2000)
    parts = reader.partitions()
    assert len(parts) > 1 and sorted(m for p in parts for m, _ in p.molecules) == ["G1", "G2", "G3", "G4", "G5", "G6", "G8"]
    assert molecules.read_molecules(spark, roots, target=1).rdd.getNumPartitions() == 7
    assert molecules.read_molecules(spark, ["/no/such/folder"]).count() == 0


def test_feature_job(spark, roots, tmp_path):
    feature_job.run(spark, roots, str(tmp_path / "out"))
    back = {n: {r.mol: r for r in spark.read.csv(f"{tmp_path}/out/{n}", header=True, inferSchema=True).collect()} for n in ("ssv", "gcv", "coverage_flags")}
    assert {m: (r.status, r.failure_reason) for m, r in back["coverage_flags"].items()} == {"G1": ("OK", None), "G2": ("OK", None), "G6": ("OK", None), "G4": ("FAILED", "parse_error"), "G8": ("FAILED", "parse_error"), "G5": ("FAILED", "feature_computation_error")}
    x = np.array([r[3:] for r in CHAIN])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    g = back["ssv"]["G1"]
    assert (g.n_atoms, g.n_residues) == (15, 5) and g.radius_of_gyration == pytest.approx(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()), abs=6e-4) and g.max_pair_distance == pytest.approx(d.max(), abs=6e-4)
    assert g.exposure_proxy == pytest.approx(((d < 4) & (d > 0)).sum(1).mean(), abs=6e-4)
    res = np.repeat(np.arange(5), 3)
    bond = {(a, b) for a in range(5) for b in range(5) if a != b and d[res == a][:, res == b].min() < 2}
    degree = [sum(a == k for a, _ in bond) for k in range(5)]
    assert (g.branch_proxy, g.terminal_proxy) == (sum(v >= 3 for v in degree), sum(v == 1 for v in degree)) == (0, 2)
    c = x.reshape(5, 3, 3).mean(1)
    near = np.linalg.norm(c[:, None] - c[None], axis=2) < 4.5
    lap = np.diag(near.sum(1) - 1.0) - (near & ~np.eye(5, dtype=bool))
    h = back["gcv"]["G1"]
    assert h.n_contacts == 4 and h.contact_density == 0.8 and h.graph_laplacian_spectral_gap == pytest.approx(np.sort(np.linalg.eigvalsh(lap))[1], abs=6e-5) and h.max_contact_distance_seq == 1
    around = [(d[res == k][:, res != k] < 4).sum() for k in range(5)]
    assert h.mean_residue_neighbor_count == pytest.approx(np.mean(around), abs=6e-4) and h.sd_residue_neighbor_count == pytest.approx(np.std(around), abs=6e-4)
    one = back["gcv"]["G2"]
    assert (one.n_contacts, one.core_periphery_ratio, one.torsion_diversity, one.graph_laplacian_spectral_gap) == (0, 0.5, 0.0, 0.0)


def test_written_molecules_read_back(spark, tmp_path):
    molecules.register(spark)
    text = "\n".join(LINE.format(i + 1, *r) for i, r in enumerate(CHAIN))
    df = spark.createDataFrame([(f"G{i}", text, '{"status": "failed"}' if i == 3 else None) for i in range(5)], "mol string, content string, meta string")
    for _ in range(2):  # a task that runs again
        df.write.format("molecules").mode("append").option("path", str(tmp_path / "r")).save()
    assert molecules.read_molecules(spark, [str(tmp_path / "r")]).groupBy("mol").count().filter("count = 15").count() == 4


def listed(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(dict(zip(("source", "source_item_id", "payload", "listed_at"), r))) for r in rows))


def arrive(folder):
    for k in range(6):
        rows = [("a" if i % 2 else "b", f"I{i}", None if i % 7 == 3 and k < 4 else f"payload {i}", f"2024-01-0{k + 1}T00:00:00Z") for i in range(k * 4, k * 4 + 8)]
        listed(folder, f"{k}.json", [*rows, ("closed", f"C{k}", "x", None), ("other", "O", "x", None)])


class Killed(Exception):
    pass


def run(spark, folder, out, process=staged.stored):
    staged.run_stage(spark, str(folder), str(out), ["a", "b", "closed"], process, refused=["closed"], files=2)


def outcome(spark, out):
    rows = staged.attempts(spark, str(out)).drop("batch").collect()
    return sorted(map(str, rows)), sorted(map(str, staged.manifest(spark, str(out)).drop("batch").collect())), sorted(map(str, staged.run_totals(spark, str(out)).collect()))


@pytest.mark.parametrize("moment", ["process", "log", "manifest"])
def test_a_killed_run_leaves_the_rows_of_an_uninterrupted_one(spark, tmp_path, monkeypatch, moment):
    arrive(tmp_path / "in")
    run(spark, tmp_path / "in", tmp_path / "whole")
    want = outcome(spark, tmp_path / "whole")
    assert len(want[1]) == 26  # of 28 items, two never have a payload
    calls = []
    real = staged.run_batch

    def broken(items, batch, out, *rest):
        calls.append(batch)
        if moment == "process" and calls.count(1) == 1 and batch == 1:
            raise Killed("before anything is written")
        real(items, batch, out, *rest)
        if calls.count(1) == 1 and batch == 1:
            if moment == "manifest":  # killed before the manifest of the batch was written
                shutil.rmtree(f"{out}/manifest/batch=1", ignore_errors=True)
            if moment != "process":
                raise Killed("after the log, before the checkpoint")

    monkeypatch.setattr(staged, "run_batch", broken)
    with pytest.raises(Exception, match="Killed|before"):
        run(spark, tmp_path / "in", tmp_path / "out")
    run(spark, tmp_path / "in", tmp_path / "out")
    assert outcome(spark, tmp_path / "out") == want
    run(spark, tmp_path / "in", tmp_path / "out")  # nothing new has arrived
    assert outcome(spark, tmp_path / "out") == want
    totals = {r.source: r for r in staged.run_totals(spark, str(tmp_path / "out")).collect()}
    assert totals["closed"].skipped == 6 and totals["closed"].ok == 0 and "other" not in totals


def test_shares_of_blocks_are_multinomial():
    sizes = [10, 10, 10, 4]
    shares = np.array([[bootstrap.share_of(b, 4, 34, 9, 1, rep, 10) for b in range(4)] for rep in range(3000)])
    assert (shares.sum(1) == 34).all()
    assert np.allclose(shares.mean(0), sizes, atol=0.2)
    assert shares[:, 0].var() == pytest.approx(34 * (10 / 34) * (24 / 34), rel=0.1) and np.corrcoef(shares[:, 0], shares[:, 3])[0, 1] == pytest.approx(-np.sqrt(10 * 4 / (24 * 30)), abs=0.06)


@pytest.mark.parametrize("median", [False, True])
def test_bootstrap_over_blocks(spark, median):
    rng = np.random.default_rng(7)
    v = rng.exponential(size=300)
    df = spark.createDataFrame([("g", i * 5 - 40, float(x)) for i, x in enumerate(v)] + [("one", 3, 2.5), ("g", 9999, None)], "g string, o long, v double")
    blocks = bootstrap.bootstrap(df, "v", "o", 1500, 3, ["g"], median, size=64)
    whole = bootstrap.bootstrap(df, "v", "o", 1500, 3, ["g"], median)
    for drawn in (blocks, whole):
        rows = {r.g: r for r in bootstrap.interval(drawn, ["g"]).collect()}
        assert drawn.filter("g = 'g'").count() == 1500 and rows["one"].mean == 2.5 and rows["one"].std == 0
        real = np.array([(np.median if median else np.mean)(rng.choice(v, 300)) for _ in range(3000)])
        assert rows["g"].mean == pytest.approx(real.mean(), abs=0.01) and rows["g"].std == pytest.approx(real.std(), rel=0.12) and rows["g"].lo == pytest.approx(np.percentile(real, 2.5), abs=0.03)


def test_size_bands(spark):
    rows = [(i, s, float(i % 7)) for i, s in enumerate([1] * 6 + [2] * 2 + [3] * 5 + [9] * 2 + [20])]
    df = spark.createDataFrame(rows, "id long, size int, x double")
    got = {r.band: sorted(r.sizes) for r in bootstrap.size_bands(df, "size").groupBy("band").agg(F.collect_list("size").alias("sizes")).collect()}
    assert got == {1: [1], 2: [1, 2, 3], 3: [3], 9: [9], 20: [20]}
    bands, summary = bootstrap.band_bootstrap(df, "id", "size", ["x"], repeats=400)
    by = {r.band: r for r in bands.collect()}
    assert by[2].n == 13 and by[9].n == 2 and by[9].std == 0 and by[9].lo is None and by[2].lo < by[2].mean < by[2].hi
    s = summary.first()
    assert s.rows == 16 and s.mean_std == pytest.approx(sum(by[r[1]].std for r in rows) / 16) and s.cv == pytest.approx(s.mean_std / s.mean_value)
