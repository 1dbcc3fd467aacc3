import json

import pytest
from pyspark.sql import functions as F

from vellumdb.database import FAILURE_POINTS, Database
from vellumdb.errors import CorruptionError, DatabaseClosedError, LockError, RecoveryError, StorageError, ValidationError
from vellumdb.operators import extract
from vellumdb.operators.compaction import choose
from vellumdb.operators.maintenance import Scheduler, Snapshots
from vellumdb.sources import segments
from vellumdb.sources.files import Log, Manifest, ManifestStore, SegmentInfo

HIT = {"path": "orders[]", "elemMatch": {"and": [{"id": {"eq": "A"}}, {"price": {"gt": 5}}]}}


def doc(name, price=10):
    return {"name": name, "orders": [{"id": "A", "price": price}, {"id": "B", "price": 1}]}


def opened(spark, tmp_path, **options):
    return Database.open(spark, str(tmp_path / "db"), create_if_missing=True, **options)


def test_lifecycle_gives_the_same_results_in_every_state(spark, tmp_path):
    db = opened(spark, tmp_path)
    assert [r["doc_id"] for r in db.insert_many([doc("a"), doc("b", 2), doc("c")])] == [1, 2, 3]

    def check(ids):
        for plan in ("scan", "index"):
            assert db.search(HIT, plan).ids() == ids
        assert db.search({"not": HIT}).ids() == sorted(set(db.documents().toPandas()["doc_id"]) - set(ids))

    check([1, 3])
    db.flush()
    check([1, 3])
    assert db.update(2, doc("b", 7))["doc_id"] == 4
    db.delete(1)
    db.delete(1)
    db.delete(99)
    check([3, 4])
    with pytest.raises(ValidationError):
        db.update(1, doc("x"))
    assert db.get(1) is None and db.get(4)["name"] == "b" and db.get(3)["name"] == "c"
    db.close()
    db.close()
    with pytest.raises(DatabaseClosedError):
        db.search(HIT)
    db = Database.open(spark, str(tmp_path / "db"))
    check([3, 4])
    late = db.search(HIT)
    db.compact()
    assert late.ids() == [3, 4]  # its segments are still there
    check([3, 4])
    late.close()
    stats = db.stats()
    assert (stats["segments"], stats["live_documents"], stats["deleted_documents"], stats["next_doc_id"], stats["segment_counts_by_level"][1]) == (1, 2, 0, 5, 1)
    assert (stats["segment_entries"], stats["segment_scopes"], stats["segment_paths"], stats["segment_scoped_keys"]) == (10, 4, 3, 2)
    for k in (3, 4):
        db.delete(k)
    db.compact()
    assert db.stats()["segments"] == 0
    check([])
    db.close()


def test_the_log_is_replayed_and_a_torn_line_removed(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.insert(doc("a"))
    db.insert(doc("b"))
    db.update(1, doc("c"))
    db.log.close()
    db.lock.release()  # as if the process had died
    path = db.log.path
    whole = path.read_bytes()
    path.write_bytes(whole + b'{"record": {"form')
    db = Database.open(spark, str(tmp_path / "db"))
    assert db.search(HIT).ids() == [2, 3]
    assert path.read_bytes() == whole
    db.insert(doc("d"))
    db.log.close()
    db.lock.release()
    path.write_bytes(path.read_bytes().replace(b'"name":"b"', b'"name":"x"'))
    with pytest.raises(RecoveryError):
        Database.open(spark, str(tmp_path / "db"))
    assert not (tmp_path / "db" / "LOCK").exists()


def test_options_and_lock(spark, tmp_path):
    with pytest.raises(StorageError):
        Database.open(spark, str(tmp_path / "none"))
    for bad in ({"durability": "maybe"}, {"mem_segment_max_documents": 0}, {"stale_ratio_threshold": 0}, {"unknown": 1}, {"max_level_zero_segments": 1}, {"posting_cache": 1}):
        with pytest.raises(ValidationError):
            Database.open(spark, str(tmp_path / "db"), create_if_missing=True, **bad)
    with pytest.raises(ValidationError):
        Database.open(spark, " ")
    with opened(spark, tmp_path, durability="relaxed") as db:
        with pytest.raises(LockError):
            Database.open(spark, str(tmp_path / "db"))
        assert db.search({"a": {"eq": 1}}).count == 0


def test_auto_flush_bulk_load_and_compaction(spark, tmp_path):
    with opened(spark, tmp_path, mem_segment_max_documents=2, max_level_zero_segments=2) as db:
        db.insert_many([doc("a"), doc("b"), doc("c")])
        assert len(db.manifest.segments) == 1
        rows = spark.createDataFrame([(json.dumps(doc(f"l{k}")),) for k in range(5)], "json string").repartition(2)
        assert db.load(rows) == 5
        assert sorted(db.search(HIT).ids()) == list(range(1, 9))
        assert db.insert(doc("z"))["doc_id"] == 9
        assert db.run_maintenance() >= 1
        assert db.search(HIT, plan="index").ids() == list(range(1, 10))
        assert max(s.level for s in db.manifest.segments) == 1
        again = db.search(HIT, plan="index")
        assert db.stats()["cache_hits"] == 1 and again.ids() == list(range(1, 10))
        assert "InMemoryTableScan" in again.dataframe._jdf.queryExecution().toString()
        db.delete(4)
        assert db.search(HIT, plan="index").ids() == [1, 2, 3, *range(5, 10)]


@pytest.mark.parametrize("point", ["after-write", "before-commit", "after-commit", "before-cleanup"])
def test_failures_around_the_commit_lose_nothing(spark, tmp_path, point):
    assert point in FAILURE_POINTS
    armed = []

    def fail(at):
        if armed and at == point:
            raise RuntimeError("injected")

    db = Database.open(spark, str(tmp_path / "db"), on_point=fail, create_if_missing=True)
    db.insert_many([doc("a"), doc("b")])
    db.flush()
    db.delete(1)
    armed.append(True)
    with pytest.raises(RuntimeError):
        db.compact()
    db.log.close()
    db.lock.release()
    with Database.open(spark, str(tmp_path / "db")) as db:
        assert db.search(HIT).ids() == [2]


def test_damage_is_found_on_open(spark, tmp_path):
    with opened(spark, tmp_path) as db:
        db.insert(doc("a"))
    segment = tmp_path / "db" / "segments" / "seg-000001"
    meta = segment / "segment.meta.json"
    good = meta.read_text()
    for bad in ("{", good.replace('"documents": 1', '"documents": 2'), good.replace('"version": 2', '"version": 9')):
        meta.write_text(bad)
        with pytest.raises(CorruptionError):
            Database.open(spark, str(tmp_path / "db"))
    meta.write_text(good)
    (segment / "leaves" / "_SUCCESS").unlink()
    with pytest.raises(CorruptionError):
        Database.open(spark, str(tmp_path / "db"))
    (segment / "leaves" / "_SUCCESS").touch()
    (tmp_path / "db" / "segments" / "seg-000009.tmp").mkdir()
    (tmp_path / "db" / "segments" / "keep").mkdir()
    Database.open(spark, str(tmp_path / "db")).close()
    assert sorted(p.name for p in (tmp_path / "db" / "segments").iterdir()) == ["keep", "seg-000001"]


def test_manifest_checksums(tmp_path):
    store = ManifestStore(tmp_path)
    assert store.read() is None
    store.write(m := Manifest(segments=[SegmentInfo(1, 0, 2, 1, 2, 10, 5, [1])]))
    assert store.read() == m
    path = tmp_path / "manifest-000001.json"
    path.write_text(path.read_text().replace('"next_doc_id": 1', '"next_doc_id": 7'))
    with pytest.raises(CorruptionError):
        store.read()
    (tmp_path / "CURRENT").write_text("../x")
    with pytest.raises(CorruptionError):
        store.read()


def test_log_numbers(tmp_path):
    log = Log(tmp_path / "log")
    for k in range(1, 4):
        log.append({"sequence": k, "type": "delete", "doc_id": k})
    assert [r["sequence"] for r in log.replay(1)] == [2, 3]


def segment(k, level=0, documents=10, deleted=0, size=1000):
    return SegmentInfo(k, level, documents, 1, documents, size, k, list(range(deleted)))


def test_compaction_policy():
    bounds = {"max_level_zero": 3, "max_inputs": 2, "stale_ratio": 0.3, "max_bytes": 5000}
    assert choose([segment(1), segment(2)], **bounds) is None
    plan = choose([segment(3), segment(2), segment(1)], **bounds)
    assert (plan.inputs, plan.output_level) == ((1, 2), 1)
    assert choose([segment(k, size=3000) for k in range(3)], **bounds) is None
    assert choose([segment(k, 2) for k in range(3)], **bounds).output_level == 3
    assert choose([segment(k, 8) for k in range(3)], **bounds).output_level == 8
    plan = choose([segment(1), segment(2, deleted=3)], **bounds)
    assert (plan.inputs, plan.output_level) == ((2,), 1)
    assert choose([segment(1, 4, deleted=5)], **bounds).output_level == 4
    assert choose([segment(1, deleted=5, size=9000)], **bounds) is None


def test_scheduler_and_snapshots():
    left = [3]

    def job():
        if left[0] < 0:
            raise RuntimeError("no")
        left[0] -= left[0] > 0
        return left[0] > 0

    s = Scheduler(job)
    assert s.drain() == 2 and s.state == "idle"
    left[0] = -1
    with pytest.raises(RuntimeError):
        s.run()
    assert s.state == "failed"
    s.close()
    assert s.run() is False
    gone = []
    snaps = Snapshots(gone.append)
    release = snaps.acquire([1, 2])
    snaps.retire([1, 3])
    assert gone == [3]
    release()
    release()
    assert gone == [3, 1]


def test_segments_that_cannot_match_are_not_opened(spark, tmp_path):
    with opened(spark, tmp_path) as db:
        for k in range(3):
            db.insert_many([{"name": f"n{k}", "only": {f"f{k}": k}, "xs": [{"k": k, "s": str(k)}]}])
            db.flush()
        segments = lambda q: [s.segment_id for s in db.candidates(q)]
        assert segments({"name": {"eq": "n1"}}) == [2]
        assert segments({"only.f2": {"gte": 0}}) == [3]
        assert segments({"path": "xs[]", "elemMatch": {"and": [{"k": {"eq": 0}}, {"s": {"eq": "0"}}]}}) == [1]
        assert segments({"name": {"neq": "n1"}}) == segments({"not": {"name": {"eq": "n1"}}}) == [1, 2, 3]
        none = {"name": {"eq": "nobody"}}
        for plan in ("scan", "index"):
            found = db.search(none, plan=plan)
            assert found.dataframe.inputFiles() == [] and found.ids() == []
            assert db.search({"name": {"eq": "n1"}}, plan=plan).ids() == [2]
        db.verify()
        # a segment of the first metadata version has no filter and may hold anything
        meta = tmp_path / "db" / "segments" / "seg-000002" / "segment.meta.json"
        old = json.loads(meta.read_text())
        meta.write_text(json.dumps({k: old[k] for k in ("segment_id", "documents", "min_doc_id", "max_doc_id")} | {"version": 1}))
        db.filters.clear()
        assert segments(none) == [2]


def test_damage_that_a_full_check_finds(spark, tmp_path):
    with opened(spark, tmp_path) as db:
        db.insert_many([doc("a"), doc("b")])
        db.flush()
        db.verify()
        folder = tmp_path / "db" / "segments" / "seg-000001"
        rows = db.segments.read(1, "scopes").collect()
        schema = db.segments.read(1, "scopes").schema
        spark.createDataFrame(rows[1:], schema).coalesce(1).write.mode("overwrite").parquet(str(folder / "scopes"))
        with pytest.raises(CorruptionError):
            db.verify()
        meta = json.loads((folder / "segment.meta.json").read_text())
        meta["files"]["scopes"] = {p.name: p.stat().st_size for p in (folder / "scopes").glob("*.parquet")}
        meta["rows"]["scopes"] -= 1
        (folder / "segment.meta.json").write_text(json.dumps(meta))
        with pytest.raises(CorruptionError, match="scope"):
            db.verify()


def test_ids_with_gaps(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.insert_many([doc(str(k)) for k in range(9)])
    db.flush()
    for k in (2, 5, 8):
        db.delete(k)
    db.compact()
    assert not db.manifest.segments[0].dense
    assert db.get(5) is None and db.get(6)["name"] == "5"
    db.delete(5)
    db.delete(4)
    assert db.update(7, doc("seven"))["doc_id"] == 10
    db.abandon()
    with Database.open(spark, str(tmp_path / "db")) as db:
        assert db.search(HIT).ids() == [1, 3, 6, 9, 10]


def test_a_batch_is_loaded_once_wherever_it_fails(spark, tmp_path):
    rows = spark.createDataFrame([(json.dumps(doc(f"b{k}")),) for k in range(4)], "json string")
    for n, point in enumerate(("after-write", "before-commit", "after-commit", "before-cleanup")):
        armed = [True]

        def fail(at, point=point, armed=armed):
            if armed[0] and at == point:
                raise RuntimeError("injected")

        path = str(tmp_path / point)
        db = Database.open(spark, path, on_point=fail, create_if_missing=True)
        with pytest.raises(RuntimeError):
            db.load(rows, batch=("stream", 0))
        db.abandon()
        with Database.open(spark, path) as db:
            assert db.load(rows, batch=("stream", 0)) == (4 if n < 2 else 0)
            assert db.load(rows, batch=("stream", 0)) == 0
            assert db.load(rows.limit(0), batch=("stream", 1)) == 0
            assert db.load(rows, batch=("other", 0)) == 4
            assert db.documents().count() == 8
            assert db.manifest.batches == {"stream": 1, "other": 0}


def test_streaming_ingest(spark, tmp_path):
    from vellumdb.streaming.ingest import ingest

    source = tmp_path / "in"
    spark.createDataFrame([(json.dumps(doc("a")),), (json.dumps(doc("b", 1)),)], "json string").coalesce(1).write.parquet(str(source))
    with opened(spark, tmp_path) as db:
        stream = spark.readStream.schema("json string").parquet(str(source))
        for _ in range(2):
            q = ingest(stream, db, str(tmp_path / "check"), availableNow=True)
            q.awaitTermination()
        assert db.search(HIT).ids() == [1]
        assert db.documents().count() == 2


def test_a_value_of_most_documents_is_dealt_out_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(segments, "TASK_BYTES", 100_000, raising=False)
    texts = F.when(F.col("id") % 100 == 0, '{"a":"y","l":[{"b":1}]}').otherwise('{"a":"x","l":[{"b":1}]}')
    docs = spark.range(1, 4001).select(F.col("id").alias("doc_id"), texts.alias("json"))
    for name, rows in segments.index_tables(extract.entries(docs).cache()):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == (8000 if name == "leaves" else 4000)
        assert max(sizes) < 0.5 * sum(sizes), (name, sizes)


def test_a_task_sorts_rows_up_to_a_bound(spark, monkeypatch):
    docs = spark.range(1, 1001).select(F.col("id").alias("doc_id"), F.to_json(F.struct("id", F.repeat(F.lit("x"), 1000).alias("text"))).alias("json"))
    monkeypatch.setattr(segments, "TASK_BYTES", 200_000, raising=False)
    tables = dict(segments.index_tables(extract.entries(docs)))
    assert tables["leaves"].rdd.getNumPartitions() >= 6  # 1000 texts of 1000 characters and as many numbers
    assert tables["scopes"].count() == tables["scoped_leaves"].count() == 0
