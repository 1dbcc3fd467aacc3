"""Immutable segments: a folder of Parquet tables for documents and their indexes.

``documents`` (doc_id, json, v) is sorted by id.  Documents are parsed once for all index
tables; those are dealt out by ranges of path, value and document and sorted, so a search
opens the few files that hold its paths, and row-group statistics prune the rest.  The
document is in the ranges because a value may be that of most documents, and rows alike
in all that a range looks at are one task's.  A key filter
(``keys.bin``) tells the driver whether a segment can hold a path or term at all.
"""

from __future__ import annotations

import json
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptionError, StorageError
from ..operators import extract
from . import keys
from .files import SegmentInfo, replace_file

DOCUMENTS = "doc_id long, json string, v variant"
TABLES = {"documents": DOCUMENTS, "leaves": extract.LEAVES, "scopes": extract.SCOPES, "scoped_leaves": extract.SCOPED_LEAVES}
SORTED = {"leaves": ["path", "value_type", "value_num", "value_str", "doc_id"], "scopes": ["array_path", "doc_id"], "scoped_leaves": ["array_path", "relative_path", "value_type", "value_num", "value_str", "doc_id"]}
#: Metadata versions: 1 has neither file lists nor a key filter, so its segments may hold
#: any key.
META_VERSIONS = (1, 2)
NAME = re.compile(r"seg-\d{6,}(\.tmp)?")


#: Bytes of rows that one task sorts, without its row pointers; those of a row besides its
#: text; rows that are worth another task while cores are idle.
TASK_BYTES, ROW_BYTES, TASK_ROWS = 1 << 27, 128, 100_000


def _tasks(entries: DataFrame) -> dict[str, int]:
    """How many tasks each index table is dealt out to, so that what one sorts has a bound
    whatever the input: ranges that Spark sizes by their compressed bytes hold any number
    of short rows."""
    leaf, around = F.col("value_type").isNotNull(), F.size("scope_ids")
    text = F.octet_length("path") + F.coalesce(F.octet_length("value_str"), F.lit(0)) + F.lit(ROW_BYTES)
    of = {"leaves": (leaf, F.lit(1)), "scopes": (~leaf, F.lit(1)), "scoped_leaves": (leaf, around)}
    sums = entries.agg(*(F.coalesce(F.sum(F.when(which, times * x)), F.lit(0)).alias(f"{name}_{k}") for name, (which, times) in of.items() for k, x in (("rows", F.lit(1).cast("long")), ("bytes", text.cast("long"))))).first()
    cores = entries.sparkSession.sparkContext.defaultParallelism
    return {name: max(1, -(-sums[f"{name}_bytes"] // TASK_BYTES), min(cores, -(-sums[f"{name}_rows"] // TASK_ROWS))) for name in of}


def index_tables(entries: DataFrame, spread: bool = True):
    """(name, rows) of the index tables, in the order in which they are stored.
    ``spread``: dealt out by ranges, for more rows than one file should hold."""
    tasks = _tasks(entries) if spread else {}
    for name, order in SORTED.items():
        rows = extract.TABLES_OF[name](entries)
        yield name, (rows.repartitionByRange(tasks[name], *order) if spread else rows.coalesce(1)).sortWithinPartitions(*order)


class SegmentStore:
    def __init__(self, spark: SparkSession, folder: Path):
        self.spark, self.folder = spark, folder / "segments"
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, segment_id: int) -> Path:
        return self.folder / f"seg-{segment_id:06d}"

    def write(self, segment_id: int, level: int, docs: DataFrame, created: int, spread: bool = True) -> SegmentInfo:
        """Writes (doc_id, json) documents; refuses to overwrite; whole or not at all."""
        final = self.path(segment_id)
        if final.exists():
            raise StorageError(f"{final} exists")
        temp = final.with_name(final.name + ".tmp")
        shutil.rmtree(temp, ignore_errors=True)
        rows = docs.select("doc_id", "json") if spread else docs.select("doc_id", "json").coalesce(1)
        rows.sortWithinPartitions("doc_id").withColumn("v", F.parse_json("json")).write.parquet(f"file://{temp}/documents")
        stored = self.spark.read.schema(DOCUMENTS).parquet(f"file://{temp}/documents")
        extract.entries(stored).write.parquet(f"file://{temp}/entries")
        entries = self.spark.read.schema(extract.ENTRIES).parquet(f"file://{temp}/entries")
        tables = {"documents": stored}
        for name, table in index_tables(entries, spread):
            table.write.parquet(f"file://{temp}/{name}")
            tables[name] = self.spark.read.schema(TABLES[name]).parquet(f"file://{temp}/{name}")
        shutil.rmtree(temp / "entries")
        n, low, high = stored.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        counts = {name: n if name == "documents" else t.count() for name, t in tables.items()}
        held = keys.build(tables["leaves"], tables["scoped_leaves"], 2 * counts["leaves"] + 2 * counts["scoped_leaves"])
        held.write(temp / "keys.bin")
        info = SegmentInfo(segment_id, level, n, low or 0, high or 0, sum(p.stat().st_size for p in temp.rglob("*.parquet")), created)
        files = {name: {p.name: p.stat().st_size for p in sorted((temp / name).glob("*.parquet"))} for name in TABLES}
        meta = {"version": META_VERSIONS[-1], "segment_id": segment_id, "documents": n, "min_doc_id": info.min_doc_id, "max_doc_id": info.max_doc_id, "rows": counts, "files": files, "key_words": len(held.words)}
        replace_file(temp / "segment.meta.json", json.dumps(meta))
        temp.rename(final)
        return info

    def read(self, segment_id: int, name: str = "documents") -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"file://{self.path(segment_id)}/{name}")

    def meta(self, segment_id: int) -> dict:
        folder = self.path(segment_id)
        try:
            meta = json.loads((folder / "segment.meta.json").read_text())
        except (OSError, ValueError) as e:
            raise CorruptionError(f"{folder.name}: no readable metadata: {e}") from e
        if not isinstance(meta, dict) or meta.get("version") not in META_VERSIONS:
            raise CorruptionError(f"{folder.name}: no known metadata version")
        return meta

    def holds(self, segment_id: int):
        """The segment's key filter; one that is always true where it has none."""
        meta = self.meta(segment_id)
        if meta["version"] == 1:
            return lambda kind, *parts: True
        return keys.KeyFilter.read(self.path(segment_id) / "keys.bin", meta.get("key_words", 0))

    def validate(self, info: SegmentInfo) -> None:
        """Metadata, and every file's presence and size, without a Spark job."""
        folder, meta = self.path(info.segment_id), self.meta(info.segment_id)
        if (meta.get("segment_id"), meta.get("documents"), meta.get("min_doc_id"), meta.get("max_doc_id")) != (info.segment_id, info.documents, info.min_doc_id, info.max_doc_id):
            raise CorruptionError(f"{folder.name}: metadata and manifest disagree")
        for name in TABLES:
            if not (folder / name / "_SUCCESS").exists():
                raise CorruptionError(f"{folder.name}: {name} is missing or incomplete")
            there = {p.name: p.stat().st_size for p in (folder / name).glob("*.parquet")}
            if meta["version"] > 1 and there != meta.get("files", {}).get(name):
                raise CorruptionError(f"{folder.name}: {name} has other files than its metadata says")
        self.holds(info.segment_id)
        if len(set(info.deleted)) != len(info.deleted) or any(not info.min_doc_id <= k <= info.max_doc_id for k in info.deleted):
            raise CorruptionError(f"{folder.name}: a tombstone names no document")

    def verify(self, info: SegmentInfo) -> None:
        """Reads all tables: counts, ids, tombstones, scopes and the key filter."""
        self.validate(info)
        folder, meta = self.path(info.segment_id), self.meta(info.segment_id)
        tables = {name: self.read(info.segment_id, name) for name in TABLES}
        docs, scopes, scoped = tables["documents"], tables["scopes"], tables["scoped_leaves"]
        own = ["doc_id", "scope_id"]

        def refuse(rows: DataFrame, what: str) -> None:
            if not rows.limit(1).isEmpty():
                raise CorruptionError(f"{folder.name}: {what}")

        for name, n in meta.get("rows", {}).items():
            if tables[name].count() != n:
                raise CorruptionError(f"{folder.name}: {name} has not {n} rows")
        refuse(docs.groupBy("doc_id").count().where("count > 1"), "documents share an id")
        if docs.count() != info.documents:
            raise CorruptionError(f"{folder.name}: not {info.documents} documents")
        gone = self.spark.createDataFrame([(k,) for k in info.deleted], "doc_id long")
        refuse(gone.join(docs, "doc_id", "left_anti"), "a tombstone names no document")
        refuse(tables["leaves"].join(docs, "doc_id", "left_anti"), "the index names unknown documents")
        refuse(scopes.join(docs, "doc_id", "left_anti"), "scopes name unknown documents")
        refuse(scopes.groupBy(*own).count().where("count > 1"), "scopes share a number")
        refuse(scopes.where("parent_scope_id IS NOT NULL").select("doc_id", F.col("parent_scope_id").alias("scope_id")).join(scopes, own, "left_anti"), "a scope's parent is unknown")
        refuse(scoped.join(scopes, [*own, "array_path"], "left_anti"), "leaves name unknown scopes")
        if meta["version"] > 1:
            rows = 2 * (meta["rows"]["leaves"] + meta["rows"]["scoped_leaves"])
            if keys.build(tables["leaves"], scoped, rows).words != self.holds(info.segment_id).words:
                raise CorruptionError(f"{folder.name}: the key filter is not that of the index")

    def remove(self, segment_id: int) -> None:
        shutil.rmtree(self.path(segment_id), ignore_errors=True)

    def clean(self, active: set[int]) -> None:
        """Removes temporary and obsolete segment folders, and nothing else."""
        keep = {self.path(k).name for k in active}
        for p in self.folder.iterdir():
            if p.is_dir() and not p.is_symlink() and NAME.fullmatch(p.name) and p.name not in keep:
                shutil.rmtree(p, ignore_errors=True)
