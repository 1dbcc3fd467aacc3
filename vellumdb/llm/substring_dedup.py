"""Removal of repeated passages, by level-wise doubling of repeated windows.

A word goes if a window of 20 consecutive words covers it whose word sequence also
starts earlier (in a smaller id, or earlier in the same document).

Levels double the length until it is the one asked for, or no candidate survives: 5 and
10 words, then 20.  Not all short windows need counting: each full window chooses, among
the half windows inside it, the one of least hash (the first of equals), and that one
chooses among its own halves in the same way.  Equal full windows choose equal halves at
equal places, so only chosen windows are counted, about one for six words, and none is
missed.  Windows that occur once at one level die there: a filter of the others goes to
the workers for the next level, in ``PASSES`` parts with a scan each if it is too large to
be sent at once; beyond that all pass, which costs shuffling and changes nothing.

The last level extends the survivors to the full length.  A run of full windows with one
chosen half is one row, (half, id, start, hashes), dealt out by the half and sorted, so
the first occurrence of each window is seen first and later ones are repeats.  Windows
repeated within a worker's slice are found there and leave it as finished spans: a
passage that a third of all documents share costs one row for each slice.  If one half
has too many different windows to remember, the rest of its windows are dealt out once
more, by half and window, and aggregated.

At the full length the candidates' fate is known, so the doubling ends: a longer
repeat is made of repeated windows of this length.  Spans then meet their texts by id,
sorted, in a stream; rows without an id, which nothing can concern, stay where they are.

Defined cases: a null or empty text has no words and removes nothing; texts under 20
words stay; a document with a null id is left alone and causes no removal; rows that
repeat an id are one document and equal starts do not remove each other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, as_array, discard, map_arrow, mix, rolling, stored, text_slices, word_hashes, words

WINDOW = 20
#: No level has shorter windows.
SHORTEST = 5
#: Largest part of a filter of repeated windows, in 64-bit blocks, that is sent to the
#: workers, and most parts.
FILTER_BLOCKS = 4_000_000
PASSES = 4
#: Different windows of one half that a worker remembers.
REMEMBERED = 2_000_000


def levels(window: int) -> list[int]:
    """Lengths that double up to the window's."""
    out = [window // 2, window]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


@dataclass(frozen=True)
class Runs:
    """All full windows of some texts, in order, as (text, start, hash).  ``first``: where
    runs with one chosen half begin; ``places`` and ``hashes``: of the chosen window of
    each run, for every level, the shortest first."""

    text: np.ndarray
    start: np.ndarray
    full: np.ndarray
    first: np.ndarray
    places: list[np.ndarray]
    hashes: list[np.ndarray]

    def group(self) -> np.ndarray:
        """The run of each window."""
        out = np.zeros(len(self.text), np.int64)
        out[self.first[1:]] = 1
        return np.cumsum(out)


def least(hashes: np.ndarray, places: np.ndarray, choices: int) -> np.ndarray:
    """Of the ``choices`` windows from each place on, the one of least hash."""
    view = np.lib.stride_tricks.sliding_window_view(mix(hashes, 5), choices)
    return places + (view if len(places) == len(view) else view[places]).argmin(axis=1)


def runs_of(texts: pa.Array, window: int = WINDOW) -> Runs:
    sizes = levels(window)[:-1]
    offsets, codes, names = words(texts)
    hashes = word_hashes(names)[codes] if len(codes) else np.empty(0, U64)
    full = rolling(hashes, window)
    if not len(full):
        none = np.empty(0, np.int64)
        return Runs(none, none, full, none, [none] * len(sizes), [full] * len(sizes))
    small = rolling(hashes, sizes[-1])
    chosen = least(small, np.arange(len(full)), window - sizes[-1] + 1)
    text = np.searchsorted(offsets, np.arange(len(full)), side="right") - 1
    inside = np.arange(len(full)) + window <= offsets[text + 1]
    at = np.flatnonzero(inside)
    text, chosen = text[at], chosen[at]
    new = np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(text) != 0)]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    places, found = [chosen[first]], [small[chosen[first]]]
    for longer, size in zip(sizes[:0:-1], sizes[-2::-1], strict=True):
        shorter = rolling(hashes, size)
        places.insert(0, least(shorter, places[0], longer - size + 1))
        found.insert(0, shorter[places[0]])
    return Runs(text, at - offsets[text], full[at], first, places, found)


def filter_place(half: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and mask of hashes in the filter of repeated halves."""
    mask = np.zeros(len(half), U64)
    for k in range(5):
        mask |= U64(1) << ((half >> U64(6 * k)) & U64(63))
    return ((half >> U64(30)) % U64(blocks)).astype(np.int64), mask


@dataclass(frozen=True)
class Part:
    """The filter of the repeated windows of a level whose hash is ``k`` modulo ``n``;
    without a table all pass."""

    k: int
    n: int
    table: np.ndarray | None

    def alive(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool) if self.n == 1 else hashes % U64(self.n) == U64(self.k)
        if self.table is not None and len(hashes):
            block, mask = filter_place(hashes, len(self.table))
            out &= (self.table[block] & mask) == mask
        return out


def counted(docs: DataFrame, level: int, part: Part | None, window: int) -> DataFrame:
    """half, n: chosen windows of a level, of which the level before has survivors."""
    sent = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches):
        known = sent.value
        for batch in batches:
            texts = as_array(batch.column(1))
            for a, b in text_slices(texts):
                runs = runs_of(texts.slice(a, b - a), window)
                places, hashes = runs.places[level], runs.hashes[level]
                if known is not None:
                    alive = known.alive(runs.hashes[level - 1])
                    places, hashes = places[alive], hashes[alive]
                _, once = np.unique(places, return_index=True)
                keys, n = np.unique(hashes[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["half", "n"])

    return map_arrow(docs, run, "half long, n long")


def filters(again: DataFrame, n: int) -> Iterator[Part]:
    """The filter of n repeated windows, part after part."""
    blocks = max(1, n * 12 // 64)
    parts = -(-blocks // max(1, FILTER_BLOCKS))
    if parts > PASSES:
        yield Part(0, 1, None)
        return
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("half", 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3)).bitwiseOR(bit(4))
    blocks = -(-blocks // parts)
    for k in range(parts):
        # the hash is unsigned in the workers
        mine = F.expr(f"pmod(pmod(half, {parts}) + CASE WHEN half < 0 THEN {2**64 % parts} ELSE 0 END, {parts}) = {k}")
        rows = again.where(mine).select(F.pmod(F.shiftrightunsigned("half", 30), F.lit(blocks)).alias("block"), mask.alias("mask")).groupBy("block").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
        out = np.zeros(blocks, U64)
        out[np.asarray(rows["block"])] = np.asarray(rows["mask"]).view(U64)
        yield Part(k, parts, out)


def candidates(docs: DataFrame, part: Part, window: int) -> DataFrame:
    """half, doc_id, start, n, hashes: runs of surviving windows; runs whose repetition
    is already settled have no hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(part)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = sent.value
        for batch in batches:
            order = pc.sort_indices(batch.column(0))
            ids, texts = as_array(batch.column(0)).take(order), as_array(batch.column(1)).take(order)
            for a, b in text_slices(texts):
                runs = runs_of(texts.slice(a, b - a), window)
                group = runs.group()
                alive = known.alive(runs.hashes[-1])[group]
                text, start, full, half, group = runs.text[alive], runs.start[alive], runs.full[alive], runs.hashes[-1][group[alive]], group[alive]
                if not len(text):
                    continue
                own = ids.slice(a, b - a)
                # rows of one id are one document, the earliest place of a window stays
                rank = np.asarray(pc.rank(own, tiebreaker="dense"))[text]
                seen, place = np.unique(full, return_inverse=True)
                earliest = np.full(len(seen), np.iinfo(np.int64).max)
                key = rank * (1 << 32) + start
                np.minimum.at(earliest, place, key)
                settled = key > earliest[place]
                new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(start) != 1) | (np.diff(settled.astype(np.int8)) != 0) | (~settled[1:] & (np.diff(group) != 0))])
                at = np.flatnonzero(new)
                ends = np.concatenate([at[1:], [len(text)]])
                raw = memoryview(full.astype("<u8").tobytes())
                blobs = [None if s else bytes(raw[8 * x : 8 * y]) for x, y, s in zip(at.tolist(), ends.tolist(), settled[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(half[at].view(np.int64)), own.take(pa.array(text[at])), pa.array(start[at], pa.int32()), pa.array(ends - at, pa.int32()), pa.array(blobs, pa.binary()),
                ], names=["half", "doc_id", "start", "n", "hashes"])

    return map_arrow(docs, run, f"half long, doc_id {id_type}, start int, n int, hashes binary")


def settled(rows: DataFrame) -> DataFrame:
    """doc_id, start, n: runs of repeated windows; rows with a half and a window are not
    settled yet."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start int, n int, half long, window long"
    dealt = rows.repartition("half").sortWithinPartitions("half", "doc_id", "start")

    def run(batches):
        state = Resolver()
        for batch in batches:
            yield from state.step(batch)
        yield from state.flush()

    return stored(map_arrow(dealt, run, schema), "spans")


class Resolver:
    """Finds repeats in a stream sorted by (half, id, start).  Rows of the last half are
    held until the next one comes, or settled against what is remembered of it."""

    HELD = 50_000

    def __init__(self):
        self.held: pa.Table | None = None
        self.half, self.seen, self.full = None, None, False

    def step(self, batch: pa.RecordBatch):
        table = pa.Table.from_batches([batch])
        done = table.filter(pc.is_null(table["hashes"]))
        if done.num_rows:
            yield self.spans(done["doc_id"], np.asarray(done["start"]), np.asarray(done["n"]))
        table = table.filter(pc.is_valid(table["hashes"]))
        if self.held is not None:
            table = pa.concat_tables([self.held, table])
        self.held = None
        if not table.num_rows:
            return
        half = np.asarray(table["half"])
        last = int(np.flatnonzero(half != half[-1])[-1]) + 1 if half[0] != half[-1] else 0
        if last:
            yield from self.resolve(table.slice(0, last))
        rest = table.slice(last)
        if rest.num_rows > self.HELD:  # whole documents of one half are settled now
            ids = rest["doc_id"]
            other = np.flatnonzero(np.asarray(pc.not_equal(ids, ids[-1])))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from self.resolve(rest.slice(0, cut), more=True)
            rest = rest.slice(cut)
        self.held = rest

    def flush(self):
        if self.held is not None:
            yield from self.resolve(self.held)

    @staticmethod
    def spans(ids, start, n, half=None, window=None):
        count = len(start)
        ids = as_array(ids) if not isinstance(ids, pa.Array) else ids
        extra = [pa.nulls(count, pa.int64()) if x is None else pa.array(x) for x in (half, window)]
        return pa.RecordBatch.from_arrays([ids, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *extra], names=["doc_id", "start", "n", "half", "window"])

    def resolve(self, table: pa.Table, more: bool = False):
        """``more``: the table holds one half, of which further rows will follow."""
        half = np.asarray(table["half"])
        carried = self.seen is not None and half[0] == self.half
        if not more:
            many = np.concatenate([[False], half[1:] == half[:-1]])
            many |= np.concatenate([half[1:] == half[:-1], [False]])
            if carried:
                many |= half == half[0]
            table, half = table.filter(pa.array(many)), half[many]
        if not table.num_rows:
            self.half, self.seen, self.full = None, None, False
            return
        n = np.asarray(table["n"]).astype(np.int64)
        window = np.frombuffer(b"".join(table["hashes"].to_pylist()), "<u8")
        row = np.repeat(np.arange(len(n)), n)
        start = np.asarray(table["start"])[row] + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        code = np.asarray(pc.rank(as_array(table["doc_id"]), tiebreaker="dense")).astype(np.int64)[row]
        order = np.lexsort((window, half[row]))  # stable: equal windows stay in (id, start) order
        w, h = window[order], half[row][order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        repeat, open_ = np.zeros(len(window), bool), np.zeros(len(window), bool)
        repeat[order] = (code[order] != code[first]) | (start[order] != start[first])
        if carried:
            mine = half[row] == half[0]
            known = np.isin(window, self.seen)
            repeat |= mine & known
            if self.full:
                open_ = mine & ~known
                repeat &= ~open_
        if more:
            seen = self.seen if carried else np.empty(0, U64)
            full = carried and self.full
            seen = seen if full else np.union1d(seen, window)
            self.half, self.seen, self.full = half[0], seen, len(seen) > REMEMBERED
        else:
            self.half, self.seen, self.full = None, None, False
        ids = as_array(table["doc_id"])
        at = np.flatnonzero(repeat)
        if len(at):
            begin = np.concatenate([[True], (np.diff(row[at]) != 0) | (np.diff(at) != 1)])
            b = np.flatnonzero(begin)
            yield self.spans(ids.take(pa.array(row[at[b]])), start[at[b]], np.diff(np.concatenate([b, [len(at)]])))
        at = np.flatnonzero(open_)
        if len(at):
            yield self.spans(ids.take(pa.array(row[at])), start[at], np.ones(len(at)), half[row[at]], window[at].view(np.int64))


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, n: runs of n windows that are repeats, of documents (doc_id, text)."""
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts: list[Part | None] = [None]
    for level in range(len(levels(window)) - 1):
        counts = reduce(DataFrame.unionByName, [counted(named, level, part, window) for part in parts]).groupBy("half").agg(F.sum("n").alias("n"))
        again = stored(counts.where("n > 1").select("half"), "repeated")
        n = again.count()
        if not n:  # no candidate survives
            return named.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, n int")
        parts = list(filters(again, n))
        discard(again)
    found = settled(reduce(DataFrame.unionByName, [candidates(named, part, window) for part in parts]))
    late = found.where("half IS NOT NULL")
    first = late.groupBy("half", "window").agg(F.min(F.struct("doc_id", "start")).alias("f"))
    more = late.join(first, ["half", "window"]).where(F.struct("doc_id", "start") > F.col("f")).select("doc_id", "start", "n")
    done = found.where("half IS NULL").select("doc_id", "start", "n")
    return done if late.isEmpty() else done.unionByName(more)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cut = spans(docs, window).select("doc_id", F.lit(0).alias("kind"), "start", "n", F.lit(None).cast("string").alias("text"))
    whole = docs.select("doc_id", F.lit(1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("n"), "text")
    # a document's spans come before its text; rows without an id are dealt out evenly
    evenly = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = whole.unionByName(cut).withColumn("spread", evenly).repartition("doc_id", "spread").sortWithinPartitions("doc_id", "kind").drop("spread")

    def run(batches):
        at, marks = None, []
        for batch in batches:
            out = []
            for i, kind, start, n, text in zip(*(batch.column(k).to_pylist() for k in range(4)), as_array(batch.column(4)).cast(pa.binary()).to_pylist(), strict=True):
                if i != at:
                    at, marks = i, []
                if not kind:
                    marks.append((start, start + n + window - 1))
                    continue
                tokens = (text or b"").split()
                if marks and i is not None:
                    gone = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(gone, [x for x, _ in marks], 1)
                    np.add.at(gone, [y for _, y in marks], -1)
                    keep = (np.cumsum(gone)[:-1] == 0).tolist()
                    kept = [t for t, k in zip(tokens, keep, strict=True) if k]
                else:
                    kept = tokens
                body = b" ".join(kept)
                out.append((i, len(tokens), len(tokens) - len(kept), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_arrow(rows, run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
