"""What the operators share: tables, shared scratch tables, words and their hashes.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; these are
exactly the separators of ``bytes.split()``, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker, which bounds its memory.
SLICE_BYTES = 4 << 20
#: Largest number of rows that any broadcast of 8-byte keys may have.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, removed when the JVM ends.

    A machine-local folder is used only where the setting is absent, as in tests.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("vellum.scratch.dir", "")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="vellum-")
            spark.conf.set("vellum.scratch.dir", base)
    path = f"{base.rstrip('/')}/vellum-llm/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a
    lost executor costs a re-read and no recomputation."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing will read again, and has Spark drop the
    shuffle files and broadcasts of finished jobs, which it else keeps until the driver
    happens to collect its garbage."""
    for t in tables:
        path = getattr(t, "_vellum_path", None)
        if path is not None:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever case is ignored."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose key is among the distinct ``ids``.  The ids are broadcast
    only after they were counted; beyond ``BROADCAST_ROWS`` both sides are shuffled."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if small else ids, key, "left_semi")


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; a single larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    if not len(texts):
        return
    yield from slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), most)


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased and nothing else."""
    return pc.ascii_lower(texts)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of some texts: (offsets of the texts, code of each word, word of each code).
    A null text has none."""
    offsets, codes, names = word_codes(texts)
    return offsets, codes, names.cast(pa.binary()).to_pylist()


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The same with the words in an Arrow array."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    offsets = np.asarray(split.offsets)
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return before[offsets - offsets[0]].astype(np.int64), np.asarray(coded.indices, dtype=np.int64), coded.dictionary


U64 = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_hashes(names: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in names), dtype=U64, count=len(names))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (positions ignore text borders)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=U64)
        for k in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[k : k + m]
            out ^= out >> U64(29)
        return mix(out)


def crc_text(ids: list) -> np.ndarray:
    """crc32 of the decimal text of each id; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids), dtype=np.int64, count=len(ids))


def crc_mod(column: str, n: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def spread_sample(rows: DataFrame, key: str, group: str | None, most: int) -> DataFrame:
    """At most ``most`` keys, evenly scattered, of each ``group``: the keys fall into
    ``most`` hash buckets and the smallest hash of each bucket is taken.  One aggregation
    with map-side combining; no sort and no window over a group."""
    h = F.xxhash64(F.col(key), F.lit(20240229))
    by = [F.pmod(h, F.lit(most)).alias("_bucket")] + ([F.col(group).alias("_group")] if group else [])
    return rows.groupBy(*by).agg(F.min(F.struct(h.alias("h"), F.col(key).alias(key))).alias("_m")).select(F.col(f"_m.{key}").alias(key)).distinct()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each SparkContext."""
    import atexit
    import pathlib
    import shutil
    import sys

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))  # bounds a worker's memory
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    top = __name__.partition(".")[0]
    root = pathlib.Path(sys.modules[top].__path__[0])
    d = tempfile.mkdtemp(prefix="vellum-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    shutil.copytree(root, pathlib.Path(d, "tree", top), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{d}/{top}", "zip", f"{d}/tree"))
    context._vellum_shipped = True


#: What a Python worker keeps from one task to the next, for one operator at a time.
KEPT: dict = {}


def kept(owner: str, make):
    """A value that later tasks of the same operator in this worker share; it goes when
    another operator's task comes."""
    if owner not in KEPT:
        KEPT[owner] = make()
    return KEPT[owner]


def keep_only(owner: str | None) -> None:
    if any(k != owner for k in KEPT):
        KEPT.clear()
        release_memory()


def release_memory() -> None:
    """Gives free memory back to the system, which a worker else holds while it waits."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(rows: DataFrame, function, schema, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers.  ``keeps``: the operator
    whose ``kept`` value its tasks share; that of any other is dropped."""
    ship(rows.sparkSession)

    def run(batches):
        keep_only(keeps)
        yield from function(batches)
        release_memory()

    return rows.mapInArrow(run, schema)
