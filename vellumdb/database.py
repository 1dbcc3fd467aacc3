"""The persistent document database.

Writes go to a checksummed log and a buffer; a flush turns the buffer into an immutable
Parquet segment and commits a new manifest.  Searches are DataFrames over the segments
of one snapshot, without deleted documents, and the buffer.  Updates give a document a
new id.  Compaction merges segments through Spark.
"""

from __future__ import annotations

import json
import shutil
import threading
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import BUFFER, evaluate, with_variant
from .errors import DatabaseClosedError, RecoveryError, StorageError, ValidationError
from .functions.documents import canonical_json, parse_document, to_doc_id
from .operators.compaction import TOP_LEVEL, CompactionPlan, choose
from .operators.extract import extract_entries, extract_scoped
from .operators.maintenance import Scheduler, Snapshots
from .options import DatabaseOptions
from .plans.index import Index, compile_index
from .plans.parser import parse_query
from .plans.prune import possible
from .results import PlanCache, SearchResult
from .sources.files import LOG_FORMAT, LOG_VERSION, FileLock, Log, Manifest, ManifestStore, SegmentInfo
from .sources.segments import TABLES, SegmentStore

#: Deleted ids of the segments up to which they are broadcast.
BROADCAST_DELETED = 1_000_000
#: Ids that a look-up names one by one; more are joined.
MOST_LITERALS = 1000
#: Documents of the buffer that one file may hold.
SMALL = 10_000
#: Points at which tests may inject failures.
FAILURE_POINTS = ("before-write", "after-write", "after-validate", "before-commit", "after-commit", "after-publish", "before-log-rotation", "before-cleanup")


class Database:
    def __init__(self, spark: SparkSession, path: str, options: DatabaseOptions, on_point: Callable[[str], None] | None = None):
        self.spark, self.folder, self.options = spark, Path(path), options
        self.on_point = on_point or (lambda point: None)
        self.mutex, self.closed = threading.RLock(), False
        self.lock = FileLock(self.folder)
        try:
            self.manifests = ManifestStore(self.folder)
            self.segments = SegmentStore(spark, self.folder)
            manifest = self.manifests.read()
            self.manifest = manifest or Manifest()
            if manifest is None:
                self.manifests.write(self.manifest)
            for info in self.manifest.segments:
                self.segments.validate(info)
            self.segments.clean({s.segment_id for s in self.manifest.segments})
            self.snapshots = Snapshots(self.segments.remove)
            self.filters: dict[int, object] = {}
            self.cache = PlanCache(options.posting_cache_max_entries if options.posting_cache else 0, lambda ids: ids.unpersist())
            self.buffer: dict[int, str] = {}
            self.sequence, self.next_doc_id = self.manifest.checkpoint, self.manifest.next_doc_id
            self.log = self._log()
            self._replay()
            self._clean_logs()
        except BaseException:
            self.lock.release()
            raise
        interval = options.check_interval_ms / 1000 if options.automatic_compaction else None
        self.scheduler = Scheduler(self._compact_once, interval)

    @classmethod
    def open(cls, spark: SparkSession, path: str, on_point: Callable[[str], None] | None = None, **options) -> Database:
        try:
            chosen = DatabaseOptions(**options)
        except TypeError as e:
            raise ValidationError(str(e)) from e
        if not isinstance(path, str) or not path.strip():
            raise ValidationError("path must not be empty")
        folder = Path(path)
        if not folder.exists():
            if not chosen.create_if_missing:
                raise StorageError(f"{path} does not exist")
            folder.mkdir(parents=True)
        return cls(spark, path, chosen, on_point)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- log

    def _log(self) -> Log:
        return Log(self.folder / f"log-{self.manifest.log_generation:06d}.jsonl", self.options.durability == "strict")

    def _clean_logs(self) -> None:
        for p in self.folder.glob("log-*.jsonl"):
            if p != self.log.path:
                p.unlink(missing_ok=True)

    def _append(self, record: dict) -> None:
        self.sequence += 1
        self.log.append({"sequence": self.sequence, **record})

    def _replay(self) -> None:
        records = self.log.replay(self.manifest.checkpoint)
        named = {r.get("doc_id" if r["type"] == "delete" else "old_doc_id") for r in records if r["type"] != "insert"}
        self._find({k for k in named if isinstance(k, int)})
        for r in records:
            if r["sequence"] != self.sequence + 1:
                raise RecoveryError(f"record {r['sequence']} follows {self.sequence}")
            self.sequence = r["sequence"]
            if r["type"] == "insert":
                self._buffer(r["doc_id"], r["document"])
            elif r["type"] == "delete":
                self._hide(r["doc_id"])
            elif r["type"] == "update":
                self._hide(r["old_doc_id"])
                self._buffer(r["new_doc_id"], r["document"])
            else:
                raise RecoveryError(f"unknown record type {r['type']!r}")

    # --- writes

    def _open(self) -> None:
        if self.closed:
            raise DatabaseClosedError("the database is closed")

    def _buffer(self, doc_id: int, document: dict) -> None:
        self.buffer[doc_id] = json.dumps(document, ensure_ascii=False)
        self.next_doc_id = max(self.next_doc_id, doc_id + 1)

    def _find(self, ids: set[int]) -> None:
        """Notes which ids segments hold, for those whose ids have gaps: one job for each
        such segment, however many ids."""
        for s in self.manifest.segments:
            asked = {k for k in ids if s.min_doc_id <= k <= s.max_doc_id} - s.known.keys()
            if asked and not s.dense:
                rows = self.segments.read(s.segment_id).select("doc_id")
                if len(asked) <= MOST_LITERALS:
                    rows = rows.where(F.col("doc_id").isin(sorted(asked)))
                else:
                    rows = rows.join(self.spark.createDataFrame([(k,) for k in asked], "doc_id long"), "doc_id", "left_semi")
                there = {r["doc_id"] for r in rows.collect()}  # ids of records of one log at most
                s.known.update({k: k in there for k in asked})

    def _home(self, doc_id: int) -> SegmentInfo | None:
        """The segment where an id is live.  Segments without gaps need no look-up."""
        for s in self.manifest.segments:
            if s.min_doc_id <= doc_id <= s.max_doc_id and doc_id not in s.hidden:
                if not s.dense:
                    self._find({doc_id})
                if s.dense or s.known[doc_id]:
                    return s
        return None

    def _visible(self, doc_id: int) -> bool:
        return doc_id in self.buffer or self._home(doc_id) is not None

    def _hide(self, doc_id: int) -> None:
        if self.buffer.pop(doc_id, None) is None and (s := self._home(doc_id)) is not None:
            s.hide(doc_id)
            self.cache.clear()

    def insert(self, document: dict) -> dict:
        return self.insert_many([document])[0]

    def insert_many(self, documents: Iterable[dict]) -> list[dict]:
        documents = [parse_document(d) for d in documents]
        out = []
        with self.mutex:
            self._open()
            for d in documents:
                doc_id = self.next_doc_id
                self._append({"type": "insert", "doc_id": doc_id, "document": d})
                self._buffer(doc_id, d)
                out.append({"doc_id": doc_id, "entry_count": len(extract_entries(d))})
                self._maybe_flush()
        return out

    def load(self, rows: DataFrame, column: str = "json", batch: tuple[str, int] | None = None) -> int:
        """Bulk load: JSON texts of a DataFrame become one new segment, without passing
        the driver; ids follow the order of the texts' partitions.  Returns how many.
        ``batch``: a source's name and batch number, committed with the documents; a batch
        that was loaded before is not loaded again."""
        with self.mutex:
            self._open()
            if batch is not None and batch[1] <= self.manifest.batches.get(batch[0], -1):
                return 0
            self.flush()
            stage = f"file://{self.folder}/staging"
            rows.select(F.col(column).alias("json"), F.monotonically_increasing_id().alias("place")).write.mode("overwrite").parquet(stage)
            texts = self.spark.read.schema("json string, place long").parquet(stage)
            by_part = texts.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
            first, starts = self.next_doc_id, []
            for r in by_part:  # one row for each task
                starts.append((r["part"], first))
                first += r["n"]
            if starts:
                base = self.spark.createDataFrame(starts, "part long, first long")
                docs = texts.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(base), "part")
                docs = docs.select((F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc_id"), "json")
                self._commit(with_variant(docs).select("doc_id", "json"), 0, [], first, batch=batch)
            elif batch is not None:
                self._commit(None, 0, [], self.next_doc_id, batch=batch)
            shutil.rmtree(self.folder / "staging", ignore_errors=True)
            return sum(r["n"] for r in by_part)

    def delete(self, doc_id: int) -> None:
        """Idempotent; an unknown id is no error."""
        to_doc_id(doc_id)
        with self.mutex:
            self._open()
            if self._visible(doc_id):
                self._append({"type": "delete", "doc_id": doc_id})
                self._hide(doc_id)

    def update(self, doc_id: int, document: dict) -> dict:
        to_doc_id(doc_id)
        parse_document(document)
        with self.mutex:
            self._open()
            if not self._visible(doc_id):
                raise ValidationError(f"document {doc_id} does not exist")
            new = self.next_doc_id
            self._append({"type": "update", "old_doc_id": doc_id, "new_doc_id": new, "document": document})
            self._hide(doc_id)
            self._buffer(new, document)
            self._maybe_flush()
        return {"doc_id": new, "entry_count": len(extract_entries(document))}

    def get(self, doc_id: int) -> dict | None:
        to_doc_id(doc_id)
        with self.mutex:
            self._open()
            if doc_id in self.buffer:
                return json.loads(self.buffer[doc_id])
            home = self._home(doc_id)
            if home is None:
                return None
            return json.loads(self.segments.read(home.segment_id).where(F.col("doc_id") == doc_id).select("json").first()["json"])

    # --- flush and compaction

    def _maybe_flush(self) -> None:
        if len(self.buffer) >= self.options.mem_segment_max_documents:
            self.flush()

    def flush(self) -> None:
        """The buffer becomes a segment; nothing happens if it is empty."""
        with self.mutex:
            self._open()
            if self.buffer:
                rows = self.spark.createDataFrame(sorted(self.buffer.items()), BUFFER)
                self._commit(rows, 0, [], self.next_doc_id, spread=len(self.buffer) > SMALL)

    def _commit(self, docs: DataFrame | None, level: int, replaced: list[int], next_doc_id: int, spread: bool = True, batch: tuple[str, int] | None = None) -> None:
        """Writes a segment (if there are documents), swaps the manifest, then rotates
        the log and retires what was replaced.  The swap is the commit."""
        self.on_point("before-write")
        written = None
        if docs is not None:
            written = self.segments.write(self.manifest.next_segment_id, level, docs, time.time_ns(), spread)
            self.on_point("after-write")
            self.segments.validate(written)
            self.on_point("after-validate")
        keep = [s for s in self.manifest.segments if s.segment_id not in replaced]
        flushes = not replaced
        new = Manifest(
            self.manifest.generation, next_doc_id, self.manifest.next_segment_id + (written is not None),
            self.sequence if flushes else self.manifest.checkpoint, self.manifest.log_generation + flushes, [*keep, *([written] if written and written.documents else [])],
            self.manifest.batches | (dict([batch]) if batch else {}),
        )
        self.on_point("before-commit")
        try:
            self.manifests.write(new)
        except BaseException:
            if written:
                self.segments.remove(written.segment_id)
            raise
        self.on_point("after-commit")
        self.manifest, self.next_doc_id = new, next_doc_id
        self.filters = {k: f for k, f in self.filters.items() if k not in replaced}
        self.cache.clear()
        self.on_point("after-publish")
        if flushes:
            self.buffer = {}
            self.on_point("before-log-rotation")
            self.log.remove()
            self.log = self._log()
        self.on_point("before-cleanup")
        self.snapshots.retire(replaced)

    def compact(self) -> None:
        """Flushes, then rewrites all live documents into one segment a level up."""
        with self.mutex:
            self._open()
            self.flush()
            if self.manifest.segments:
                level = min(TOP_LEVEL, 1 + max(s.level for s in self.manifest.segments))
                self._execute(CompactionPlan(tuple(s.segment_id for s in self.manifest.segments), level, "manual"))

    def _execute(self, plan: CompactionPlan) -> None:
        inputs = [s for s in self.manifest.segments if s.segment_id in plan.inputs]
        live = sum(s.live for s in inputs)
        docs = self._live(inputs).select("doc_id", "json").orderBy("doc_id") if live else None
        self._commit(docs, plan.output_level, list(plan.inputs), self.next_doc_id)

    def _compact_once(self) -> bool:
        o = self.options
        with self.mutex:
            if self.closed:
                return False
            plan = choose(self.manifest.segments, o.max_level_zero_segments, o.max_input_segments, o.stale_ratio_threshold, o.max_input_bytes)
            if plan is None:
                return False
            self._execute(plan)
            return True

    def run_maintenance(self) -> int:
        """Compacts until the policy asks for nothing more; returns the jobs done."""
        self._open()
        return self.scheduler.drain()

    wait_for_maintenance = run_maintenance

    # --- reads

    def _live(self, infos: list[SegmentInfo], name: str = "documents") -> DataFrame:
        """Rows of a table of several segments, without deleted documents."""
        out = None
        for s in infos:
            rows = self.segments.read(s.segment_id, name)
            if s.deleted:
                gone = self.spark.createDataFrame([(k,) for k in s.deleted], "doc_id long")
                rows = rows.join(F.broadcast(gone) if len(s.deleted) <= BROADCAST_DELETED else gone, "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], TABLES[name])

    def documents(self) -> DataFrame:
        """(doc_id, json, v) of all visible documents."""
        with self.mutex:
            self._open()
            return self._frame()

    def _frame(self, infos: list[SegmentInfo] | None = None) -> DataFrame:
        infos = self.manifest.segments if infos is None else infos
        rows = self._live(infos) if infos else None
        if self.buffer or rows is None:
            held = with_variant(self.spark.createDataFrame(sorted(self.buffer.items()), BUFFER))
            rows = held if rows is None else rows.unionByName(held)
        return rows

    def index(self, infos: list[SegmentInfo] | None = None) -> Index:
        """Index tables of all visible documents, or those of some segments, and the
        buffer's."""
        infos = self.manifest.segments if infos is None else infos
        held = Index.of(self.spark.createDataFrame(sorted(self.buffer.items()), BUFFER))
        if not infos:
            return held
        both = lambda name: self._live(infos, name).unionByName(getattr(held, name)) if self.buffer else self._live(infos, name)
        return Index(self._frame(infos).select("doc_id"), both("leaves"), both("scopes"), both("scoped_leaves"))

    def candidates(self, query: dict) -> list[SegmentInfo]:
        """The segments that may hold a match, by their key filters; no file of another
        one is opened for the search."""
        expression, out = parse_query(query), []
        for s in self.manifest.segments:
            if s.segment_id not in self.filters:
                self.filters[s.segment_id] = self.segments.holds(s.segment_id)
            if possible(expression, self.filters[s.segment_id]):
                out.append(s)
        return out

    def search(self, query: dict, plan: str = "scan") -> SearchResult:
        with self.mutex:
            self._open()
            infos = self.candidates(query)
            release = self.snapshots.acquire([s.segment_id for s in infos])

            docs = self._frame(infos)
            if plan == "index":
                # the matching ids stay with the executors, so a repeated search reads no index
                key = f"{self.sequence}:{canonical_json(query) if _plain(query) else id(query)}"
                make = lambda: compile_index(self.index(infos), parse_query(query)).persist()
                ids = self.cache.get(key, make) if self.cache.most else compile_index(self.index(infos), parse_query(query))
                found = docs.select("doc_id", "json").join(ids, "doc_id", "left_semi")
            else:
                found = evaluate(docs, query, plan)
            return SearchResult(found.select("doc_id", "json").orderBy("doc_id"), release)

    def verify(self) -> None:
        """Reads every table of every segment and checks that they agree."""
        with self.mutex:
            self._open()
            for s in self.manifest.segments:
                self.segments.verify(s)

    def stats(self) -> dict:
        with self.mutex:
            self._open()
            infos = self.manifest.segments
            held = [json.loads(x) for x in self.buffer.values()]
            entries = [e for d in held for e in extract_entries(d)]
            scoped = [extract_scoped(d) for d in held]
            out = {
                "path": str(self.folder), "state": "open", "generation": self.manifest.generation, "log_generation": self.manifest.log_generation,
                "sequence": self.sequence, "checkpoint": self.manifest.checkpoint, "durability": self.options.durability,
                "next_doc_id": self.next_doc_id, "next_segment_id": self.manifest.next_segment_id,
                "mem_documents": len(self.buffer), "mem_paths": len({e.path for e in entries}), "mem_terms": len({(e.path, e.value_type, str(e.value)) for e in entries}), "mem_entries": len(entries),
                "mem_scopes": sum(len(s) for s, _ in scoped), "mem_scoped_entries": sum(len(e) for _, e in scoped),
                "segments": len(infos), "segment_documents": sum(s.documents for s in infos), "live_segment_documents": sum(s.live for s in infos), "deleted_documents": sum(len(s.deleted) for s in infos),
                "live_documents": sum(s.live for s in infos) + len(self.buffer), "segment_bytes": sum(s.bytes for s in infos), "segment_counts_by_level": [sum(s.level == k for s in infos) for k in range(TOP_LEVEL + 1)],
                "cache_entries": len(self.cache.items), "cache_max_entries": self.cache.most, "cache_hits": self.cache.hits, "cache_misses": self.cache.misses,
                "maintenance_state": self.scheduler.state, "maintenance_completed": self.scheduler.completed, "maintenance_failure": str(self.scheduler.failure or ""),
                "segment_versions": sorted({self.segments.meta(s.segment_id)["version"] for s in infos}), "log_format": f"{LOG_FORMAT}/{LOG_VERSION}", "log_bytes": self.log.path.stat().st_size if self.log.path.exists() else 0,
                "mem_bytes": sum(len(x.encode()) for x in self.buffer.values()), "first_segment": min((s.segment_id for s in infos), default=0), "last_segment": max((s.segment_id for s in infos), default=0), "dense_segments": sum(s.dense for s in infos),
                "deleted_ratio": sum(len(s.deleted) for s in infos) / max(1, sum(s.documents for s in infos)), "open_key_filters": len(self.filters), "key_filter_bytes": sum(8 * len(f.words) for f in self.filters.values() if hasattr(f, "words")),
                "streams": dict(self.manifest.batches), "maintenance_running": self.scheduler.running, "maintenance_interval_ms": self.options.check_interval_ms if self.options.automatic_compaction else None,
                "held_snapshots": sum(1 for n in self.snapshots.held.values() if n > 0), "obsolete_segments": len(self.snapshots.obsolete), "automatic_compaction": self.options.automatic_compaction,
            }
            if infos:
                paths = self._live(infos, "leaves").agg(F.count_distinct("path").alias("paths"), F.count_distinct("path", "value_type", F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string"), F.lit(""))).alias("terms"), F.count("*").alias("entries")).first()
                scopes = self._live(infos, "scopes").agg(F.count("*")).first()[0]
                keys = self._live(infos, "scoped_leaves").agg(F.count_distinct("array_path", "relative_path").alias("keys"), F.count("*").alias("rows")).first()
                out |= {"segment_paths": paths["paths"], "segment_terms": paths["terms"], "segment_entries": paths["entries"], "segment_scopes": scopes, "segment_scoped_keys": keys["keys"], "segment_scoped_entries": keys["rows"]}
            else:
                out |= dict.fromkeys(("segment_paths", "segment_terms", "segment_entries", "segment_scopes", "segment_scoped_keys", "segment_scoped_entries"), 0)
            return out

    def abandon(self) -> None:
        """Lets go of files and the lock as a dying process does: nothing is flushed, and
        the log has what was not.  For tests of recovery."""
        with self.mutex:
            self.closed = True
            self.log.close()
            self.lock.release()
        self.scheduler.close()

    def close(self) -> None:
        """Flushes and unlocks; later calls fail.  Closing twice is no error."""
        with self.mutex:
            if self.closed:
                return
            try:
                self.flush()
            finally:
                self.closed = True
                self.cache.clear()
                self.log.close()
                self.lock.release()
        self.scheduler.close()


def _plain(query: object) -> bool:
    try:
        canonical_json(query)
    except (TypeError, ValueError):
        return False
    return True
