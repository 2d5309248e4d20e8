"""Molecule files as a Spark data source: `spark.read.format("molecules")` and, one file a molecule, `df.write.format("molecules")`.

A root holds a folder for each molecule with `structure_1.pdb` and perhaps `meta.json`. Roots are named in order of priority: a
molecule comes from the first that has a file of at least `least` bytes whose metadata do not call it failed. Partitions are
planned by file sizes. A file that cannot be read or parsed, or holds no atoms, is one row with a reason, not an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FILE, META = "structure_1.pdb", "meta.json"
SCHEMA = "mol string, source_dir string, source_file string, atom int, chain string, res string, seq int, x double, y double, z double, failure_reason string"
FIELDS = pa.schema([("mol", pa.string()), ("source_dir", pa.string()), ("source_file", pa.string()), ("atom", pa.int32()), ("chain", pa.string()), ("res", pa.string()), ("seq", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("failure_reason", pa.string())])


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class Files(InputPartition):
    """Molecules of one task, each with its candidates (root number, has metadata) in order of priority."""

    molecules: list[tuple[str, list[tuple[int, bool]]]]


def atoms_of(text: str) -> list[tuple]:
    """(chain, res, seq, x, y, z) of the atom lines of a fixed-column file; a malformed number is a ValueError."""
    rows = []
    for line in text.splitlines():
        if line.startswith(("ATOM  ", "HETATM")):
            chain, seq, name = line[21:22].strip(), line[22:26].strip(), line[17:20].strip()
            rows.append((chain, f"{chain}:{seq}:{name}", int(seq), *(float(line[a : a + 8]) for a in (30, 38, 46))))
    return rows


class MoleculeReader(DataSourceReader):
    def __init__(self, roots: list[str], least: int, target: int) -> None:
        self.roots, self.least, self.target = roots, least, target

    def partitions(self) -> list[Files]:
        found: dict[str, tuple[int, list[tuple[int, bool]]]] = {}
        for i, root in enumerate(self.roots):
            system, base = open_root(root)
            here: dict[str, set[str]] = {}
            size: dict[str, int] = {}
            for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if f.type == fs.FileType.File and f.base_name in (FILE, META):
                    mol = f.path.rsplit("/", 2)[1]
                    here.setdefault(mol, set()).add(f.base_name)
                    if f.base_name == FILE:
                        size[mol] = f.size
            for mol, n in size.items():
                if n >= self.least:
                    known, places = found.setdefault(mol, (n, []))
                    places.append((i, META in here[mol]))
        parts, room = [], 0
        for mol in sorted(found):
            size_of, places = found[mol]
            if room < size_of or not parts:
                parts.append(Files([]))
                room = max(self.target, size_of)
            parts[-1].molecules.append((mol, places))
            room -= size_of
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        roots = [open_root(r) for r in self.roots]
        rows: list[tuple] = []
        for mol, places in partition.molecules:
            for i, has_meta in places:
                system, base = roots[i]
                if has_meta and self._failed(system, f"{base}/{mol}/{META}"):
                    continue
                head = (mol, self.roots[i].rstrip("/").rsplit("/", 1)[-1], f"{mol}/{FILE}")
                try:
                    with system.open_input_stream(f"{base}/{mol}/{FILE}") as f:
                        atoms = atoms_of(f.read().decode("ascii"))
                    reason = None if atoms else "feature_computation_error"
                except (OSError, ValueError):
                    atoms, reason = [], "parse_error"
                rows += [(*head, k, *a, None) for k, a in enumerate(atoms)] if atoms else [(*head, *[None] * 7, reason)]
                break
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), FIELDS)], schema=FIELDS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), FIELDS)], schema=FIELDS)

    @staticmethod
    def _failed(system: fs.FileSystem, path: str) -> bool:
        try:
            with system.open_input_stream(path) as f:
                return json.loads(f.read()).get("status") == "failed"
        except (OSError, ValueError, AttributeError):
            return False  # unreadable metadata decide nothing


class MoleculeWriter(DataSourceArrowWriter):
    """Rows (mol, content[, meta]): a file is written whole, so a task that runs again leaves the same files."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = open_root(self.root)
        for batch in iterator:
            for row in batch.to_pylist():
                system.create_dir(f"{base}/{row['mol']}", recursive=True)
                for name, content in ((FILE, row["content"]), (META, row.get("meta"))):
                    if content is not None:
                        with system.open_output_stream(f"{base}/{row['mol']}/{name}") as f:
                            f.write(content.encode())
        return WriterCommitMessage()


class MoleculeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "molecules"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MoleculeReader:
        return MoleculeReader(json.loads(self.options["roots"]), int(self.options.get("least", 100)), int(self.options.get("target", 16_000_000)))

    def writer(self, schema, overwrite: bool) -> MoleculeWriter:
        return MoleculeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MoleculeSource)


def read_molecules(spark: SparkSession, roots: list[str], least: int = 100, target: int = 16_000_000):
    """Atoms of all molecules below `roots`, the first root first."""
    register(spark)
    return spark.read.format("molecules").option("roots", json.dumps(roots)).option("least", least).option("target", target).load()
