"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

* Memtables: every scan task is one; it flushes its entries (digest, id, length) sorted
  by digest.  The files form ``RUNS`` runs of level 0.
* Compaction merges ``FANOUT`` runs into one of the next level, by digest, until one run
  is left; it adds up rows and keeps the best identifier: the longest original, then the
  smallest id.  Partial aggregation collapses a hot digest before every shuffle.
* Hits are rows whose digest another row has.  A blocked Bloom filter of the merged
  run's digests that several rows have lets only possible hits of the level-0 runs reach
  the exact join; all other rows are settled without a shuffle.
* Hits receive byte verification: a blocked Bloom filter of their ids lets only possible
  hits' texts leave the scan, an exact join removes the rest, and each normalised text is
  compared with that of the row that stays.  Rows that fail, their digests colliding, are
  grouped anew by the text itself, so the result does not rest on the hash.

Digests of more than ``HOT`` rows are joined by broadcast (there are ``BROADCAST_ROWS``
at most), and the text that stays is compared in as many parts as a group needs, so no
group meets in one task.  A filter of ids that is too large for one broadcast is sent in
parts, each a scan of its own; beyond ``PASSES`` of them shuffling the texts costs less.

``LsmIndex`` also serves batches that come one after another.

Defined cases: a null text counts as empty; all empty texts are equal; rows that repeat
both id and text are one document and give one row, while group_size counts every row;
rows of one id and several texts are several documents; a null id sorts after all
others; an empty table gives an empty result; other columns are not read, whatever their
names, and are kept by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from ._common import BROADCAST_ROWS, discard, fresh, shared_path, stored

#: The characters of [\x20\x09-\x0D], which equality ignores.
IGNORED = " \t\n\x0b\x0c\r"
#: Runs of level 0 that one insert makes.
RUNS = 16
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Rows of a digest from which its group is dealt out in parts.
HOT = 1000
#: Scans of the documents, each with its part of the filter of ids.
PASSES = 8


def filled(text):
    return F.coalesce(text, F.lit(""))


def normalised(text):
    return F.translate(filled(text), IGNORED, "")


def raw_hash(text):
    return F.xxhash64(filled(text))


def entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    best = F.struct((-F.length(filled(text))).cast("long").alias("less"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"))
    return docs.select(F.unhex(F.sha2(normalised(text), 256)).alias("digest"), best.alias("best"), raw_hash(text).alias("raw"))


def flush(rows: DataFrame, name: str) -> DataFrame:
    """Sorted runs on the shared disk, without a shuffle of their own."""
    path = shared_path(rows.sparkSession, name)
    rows.sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._vellum_path = path
    return out


class LsmIndex:
    """Digests to (rows, best identifier).  ``levels``: for each level its tables of runs
    (run, digest, n, best)."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text"):
        self.id_col, self.text_col, self.levels, self.batches = id_col, text_col, [[]], []

    def insert(self, docs: DataFrame) -> DataFrame:
        """Flushes a batch; returns its entries, one for each row."""
        rows = entries(docs, self.id_col, self.text_col).select(F.pmod(F.spark_partition_id(), F.lit(RUNS)).cast("int").alias("run"), "digest", "best", "raw")
        runs = flush(rows, "runs")
        self.batches.append(docs)
        self.levels[0].append(runs.select("run", "digest", F.lit(1).cast("long").alias("n"), "best"))
        while len(self.levels[0]) >= FANOUT:
            self.merge(0)
        return runs

    def merge(self, level: int) -> None:
        """Merges the runs of a level, ``FANOUT`` into one, and passes them on."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        merged = self.merged(old, F.floor(F.col("run") / FANOUT).cast("int"))
        self.levels[level + 1].append(flush(merged, f"level{level + 1}"))
        if level:
            discard(*old)
        if len(self.levels[level + 1]) >= FANOUT:
            self.merge(level + 1)

    @staticmethod
    def merged(tables: list[DataFrame], run) -> DataFrame:
        rows = tables[0]
        for x in tables[1:]:
            rows = rows.unionByName(x)
        return rows.groupBy(run.alias("run"), "digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))

    def compact(self) -> DataFrame:
        """Merges level after level until one run holds an entry for each digest."""
        runs, level = RUNS, 0
        while runs > 1:
            if level < len(self.levels) and self.levels[level]:
                self.merge(level)
            runs, level = -(-runs // FANOUT), level + 1
        tables = [x for level in self.levels for x in level]
        if len(tables) > 1:
            top = flush(self.merged(tables, F.lit(0)), "top")
            discard(*tables)
            self.levels = [[] for _ in self.levels[:-1]] + [[top]]
        return self.levels[-1][0].drop("run")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id of the rows of a new batch whose normalised text is indexed:
        the filter of each table of runs first, then an exact join on the digest, then a
        comparison of the texts."""
        batch = stored(entries(docs, self.id_col, self.text_col), "batch")
        found = None
        for runs in (x for level in self.levels for x in level):
            f = bloom.build(runs, F.col("digest"), max(1, runs.count()))
            hits = f.possible(batch, F.col("digest")).join(runs.select("digest", F.col("best").alias("first")), "digest").select("digest", "best", "raw", "first")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return batch.where("false").select(F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"))
        hits = stored(found.groupBy("digest", "best", "raw").agg(F.min("first").alias("first")), "found")
        own = texts_of(docs, hits.select(F.col("best.doc_id").alias("_id"), "raw", "digest").distinct(), self.id_col, self.text_col)
        kept = None
        for x in self.batches:
            rows = entries_with_text(x, self.id_col, self.text_col).join(hits.select("digest", F.col("first").alias("best")).distinct(), ["digest", "best"], "left_semi").select("digest", "norm")
            kept = rows if kept is None else kept.unionByName(rows)
        same = own.join(kept.distinct(), ["digest", "norm"], "left_semi").select("digest", F.col("_id").alias("doc_id"), "raw").distinct()
        ids = hits.select("digest", F.col("best.doc_id").alias("doc_id"), "raw", F.col("first.doc_id").alias("keep_id"))
        on = (ids["digest"] == same["digest"]) & (ids["raw"] == same["raw"]) & ids["doc_id"].eqNullSafe(same["doc_id"])
        return ids.join(same, on, "left_semi").select("doc_id", "keep_id")


def entries_with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    best = F.struct((-F.length(filled(text))).cast("long").alias("less"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"))
    return docs.select(F.unhex(F.sha2(normalised(text), 256)).alias("digest"), best.alias("best"), normalised(text).alias("norm"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """digest, raw, best, n, first (the entry that stays) of each document, and whether
    some rows repeat both id and text."""
    index = LsmIndex(id_col, text_col)
    runs = index.insert(docs).drop("run")
    top = index.compact()
    hits = stored(top.where("n > 1").withColumnRenamed("best", "first"), "hits")
    discard(*index.levels[-1])
    n_hits, n_rows = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    f = bloom.build(hits, F.col("digest"), n_hits)
    if f.small:
        possible, settled = f.possible(runs, F.col("digest")), f.impossible(runs, F.col("digest"))
    else:  # entries are a few bytes each, so they are joined as they are
        possible, settled = runs, None
    hot = max(HOT, n_rows // BROADCAST_ROWS)  # fewer than BROADCAST_ROWS digests have so many rows
    few = hits.where(F.col("n") > hot)
    exact = possible.join(F.broadcast(few.select("digest", F.col("n").alias("hot_n"), F.col("first").alias("hot_first"))), "digest", "left")
    cold = exact.where("hot_n IS NULL").drop("hot_n", "hot_first").join(hits.where(F.col("n") <= hot), "digest", "left")
    joined = cold.select("digest", "raw", "best", "n", "first").unionByName(exact.where("hot_n IS NOT NULL").select("digest", "raw", "best", F.col("hot_n").alias("n"), F.col("hot_first").alias("first")))
    joined = stored(joined, "joined")
    doubled = joined.where("n IS NOT NULL")
    wrong = stored(mismatches(docs, doubled, id_col, text_col, hot), "mismatches")
    single = joined.where("n IS NULL").drop("n", "first")
    single = single if settled is None else single.unionByName(settled.select("digest", "raw", "best"))
    out = doubled.unionByName(single.select("*", F.lit(1).cast("long").alias("n"), F.col("best").alias("first")))
    if not wrong.isEmpty():
        out = regrouped(out, wrong)
    repeats = not doubled.groupBy("digest", "raw", "best").count().where("count > 1").isEmpty()
    return (out.distinct() if repeats else out), repeats


def texts_of(docs: DataFrame, hit: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``hit`` (_id, raw and others), each with its normalised text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = hit.where("_id IS NOT NULL").select("_id")
    n = ids.count()
    parts = max(1, -(-n * bloom.BITS_PER_KEY // (64 * bloom.BROADCAST_BLOCKS)))
    if parts <= PASSES:
        whole, rows = rows, rows.where("doc_id IS NULL")
        for k in range(parts):
            mine = lambda c: F.pmod(F.xxhash64(c, F.lit(31)), F.lit(parts)) == k
            f = bloom.build(ids.where(mine("_id")), F.col("_id"), -(-n // parts))
            rows = rows.unionByName(f.possible(whole.where(mine("doc_id")) if parts > 1 else whole, F.col("doc_id")))
    text = rows.select(F.col("doc_id").alias("_text_id"), raw_hash(F.col("text")).alias("_text_raw"), normalised(F.col("text")).alias("norm"))
    return text.join(hit, F.expr("_text_id <=> _id AND _text_raw = raw")).drop("_text_id", "_text_raw")


def mismatches(docs: DataFrame, doubled: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """Rows whose digest equals that of the row that stays but whose bytes differ."""
    hit = doubled.select(F.col("best.doc_id").alias("_id"), "raw", "digest", "best", F.col("best").eqNullSafe(F.col("first")).alias("stays"), F.ceil(F.col("n") / hot).cast("int").alias("parts")).distinct()
    got = texts_of(docs, hit, id_col, text_col)
    # the text that stays goes to each part of its group
    first = got.where("stays").groupBy("digest", "parts").agg(F.min("norm").alias("kept_norm")).select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = got.where("NOT stays").withColumn("part", F.pmod(F.xxhash64("raw", "_id"), F.col("parts")).cast("int"))
    return rows.join(first, ["digest", "part"]).where("norm != kept_norm").select("digest", "raw", "best", "norm").distinct()


def regrouped(out: DataFrame, wrong: DataFrame) -> DataFrame:
    """Takes the mismatched rows out of their groups and groups them by their text."""
    key = ["digest", "raw", "best"]
    own = wrong.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.min("best").alias("first"))
    taken = wrong.groupBy("digest").agg(F.count("*").alias("gone"))
    rest = out.join(wrong, key, "left_anti").join(taken, "digest", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone")
    return rest.unionByName(wrong.join(own, ["digest", "norm"]).select(*out.columns))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return decisions(docs, id_col, text_col)[0].select(
        F.col("best.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best").eqNullSafe(F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; one of rows repeated outright."""
    made, repeats = decisions(docs, id_col, text_col)
    gone_id, gone_raw, raw = fresh(docs, "gone_id"), fresh(docs, "gone_raw"), fresh(docs, "raw")
    gone = stored(made.where(~F.col("best").eqNullSafe(F.col("first"))).select(F.col("best.doc_id").alias(gone_id), F.col("raw").alias(gone_raw)), "dropped")
    small = gone.count() <= BROADCAST_ROWS
    rest = docs.join(F.broadcast(gone) if small else gone, docs[id_col].eqNullSafe(F.col(gone_id)) & (raw_hash(docs[text_col]) == F.col(gone_raw)), "left_anti")
    if repeats:
        rest = rest.withColumn(raw, raw_hash(F.col(text_col))).dropDuplicates([id_col, raw]).drop(raw)
    return rest
