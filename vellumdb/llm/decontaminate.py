"""Benchmark decontamination by greedy string tiling.

Words are compared without case and outer punctuation.  Benchmark items are indexed by
the Karp-Rabin hashes of their runs of ``seed`` words; a document's seeds are joined
with them, and for each item that shares one the running matches are tiled: seeds on one
diagonal join into maximal matches, the longest is marked first, and what a mark leaves
of a shorter one is matched again until none of ``seed`` words is left.  Tiles do not
overlap in the item or in the document, and their order is free, so a reordered passage
is covered as well as a plain one.  An item counts as leaked when its tiles cover at
least ``coverage`` of its words.

What an item and a document share is first bounded by the item's words in shared seeds,
counted without pairing places; only items that can reach ``coverage`` are tiled.  Words
that repeat make many pairs of places; beyond ``PAIRS`` of them the same tiles are found
without listing pairs, by Karp-Rabin hashes of unmarked windows: the greatest length at
which both sides share one, all its matches marked in order, then the next length.

The benchmark goes to the workers in blocks of at most ``BLOCK_CHARS`` characters, each
a pass over the documents; the documents are never shuffled and nothing is collected.

Defined cases: null and empty texts and items match nothing; items under ``seed`` words
are too short for evidence and never match; repeated items and rows are judged each;
ties between equally long matches go to the first in the item, then in the document;
an empty table gives an empty result; other columns are not read by ``leaks`` and are
kept by ``keep_clean``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_array, map_arrow, mix, rolling, text_slices, word_hashes, words

SEED = 5
COVERAGE = 0.75
BLOCK_CHARS = 16 << 20
#: Pairs of places (item, document) that are listed at once.
PAIRS = 200_000
#: Bytes that are dropped at both ends of a word.
OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(names: list[bytes]) -> list[bytes]:
    return [x.decode("utf-8", "replace").lower().encode().strip(OUTER) for x in names]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, hash of each word); words of nothing but punctuation go."""
    offsets, codes, names = words(texts)
    bare = plain(names)
    full = np.fromiter(map(bool, bare), dtype=bool, count=len(bare))[codes] if len(codes) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return before[offsets], (word_hashes(bare)[codes] if len(codes) else np.empty(0, np.uint64))[full]


class Benchmark:
    def __init__(self, ids: list, texts: list, seed: int = SEED):
        self.ids, self.seed = ids, seed
        offsets, hashes = tokens(pa.array(texts, pa.string()))
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keys, items, places = [], [], []
        for k, w in enumerate(self.words):
            h = rolling(w, seed)
            keys.append(h)
            items.append(np.full(len(h), k))
            places.append(np.arange(len(h)))
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(items)[order] if items else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.empty(0, np.int64)
        self.unique = np.unique(self.key)

    def seeds(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose run of words occurs in some item."""
        h = rolling(hashes, self.seed)
        if not len(h) or not len(self.unique):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.unique, h), len(self.unique) - 1)
        return np.flatnonzero(self.unique[at] == h)

    def leaks(self, texts: pa.Array, coverage: float):
        """(row, item, covered words, tiles) of each leak."""
        for a, b in text_slices(texts):
            offsets, hashes = tokens(texts.slice(a, b - a))
            found = self.seeds(hashes)
            row = np.searchsorted(offsets, found, side="right") - 1
            inside = found + self.seed <= offsets[row + 1]
            found, row = found[inside], row[inside]
            for r in np.unique(row):
                start, end = offsets[r], offsets[r + 1]
                where = found[row == r] - start
                for item, covered, tiles in self.tiled(hashes[start:end], where, coverage):
                    yield a + int(r), item, covered, tiles

    def tiled(self, doc: np.ndarray, where: np.ndarray, coverage: float):
        """(item, covered words, tiles) of the items that a document leaks; ``where``: its
        seeds' places."""
        h = rolling(doc, self.seed)[where]
        order = np.argsort(h, kind="stable")
        by_hash, places = h[order], where[order]
        keys = np.unique(h)
        low, high = np.searchsorted(self.key, keys, side="left"), np.searchsorted(self.key, keys, side="right")
        shared = np.zeros(len(self.words), np.int64)  # places of each item that start a shared seed
        ends = np.cumsum(high - low)
        for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            b = min(a + PAIRS, int(ends[-1]))
            k = np.searchsorted(ends, np.arange(a, b), side="right")
            entry = high[k] - (ends[k] - np.arange(a, b))
            shared += np.bincount(self.item[entry], minlength=len(shared))
        for k in np.flatnonzero(shared):
            size = len(self.words[k])
            need = coverage * size
            if self.seed * shared[k] < need:
                continue
            own = rolling(self.words[k], self.seed)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            i = np.flatnonzero(keys[at] == own)
            covers = np.zeros(size + 1, np.int64)
            np.add.at(covers, i, 1)
            np.add.at(covers, i + self.seed, -1)
            if np.count_nonzero(np.cumsum(covers)[:-1]) < need:
                continue
            first, last = np.searchsorted(by_hash, own[i], side="left"), np.searchsorted(by_hash, own[i], side="right")
            times = last - first
            if times.sum() <= PAIRS:
                item = np.repeat(i, times)
                at = places[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(item))]
                by = np.lexsort((item, at - item))
                covered, tiles = tile(item[by], at[by], size, self.seed)
            else:
                covered, tiles = tile_windows(self.words[k], doc, self.seed)
            if covered >= need:
                yield int(k), covered, tiles


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values, by doubling."""
    n, out = 1, mix(h)
    while 2 * n <= size:
        out = joined(out[:-n], out[n:])
        n *= 2
    return joined(out[: len(h) - size + 1], out[size - n : len(h) - n + 1]) if size > n else out


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x * np.uint64(0x9E3779B97F4A7C15) + y, 3)


def tile_windows(item: np.ndarray, doc: np.ndarray, seed: int) -> tuple[int, int]:
    """Greedy tiling of two sequences of words, in memory of their lengths: (covered
    words, tiles).  The tiles are those of ``tile``."""
    used_item, used_doc, covered, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), 0, 0

    def free(h: np.ndarray, used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked windows of n words."""
        marked = np.concatenate([[0], np.cumsum(used)])
        at = np.flatnonzero(marked[n:] == marked[:-n])
        return at, windows(h, n)[at]

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (i, x), (j, y) = free(item, used_item, n), free(doc, used_doc, n)
        both = np.intersect1d(x, y)
        x_in, y_in = np.isin(x, both), np.isin(y, both)
        return i[x_in], x[x_in], j[y_in], y[y_in]

    top = min(len(item), len(doc))
    while top >= seed:
        low, high = seed - 1, top  # the greatest length at which a window is shared
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        if low < seed:
            break
        i, x, j, y = shared(low)
        order = np.argsort(y, kind="stable")
        y, j = y[order], j[order]
        begin, end = dict(zip(*(v.tolist() for v in np.unique(y, return_index=True)), strict=True)), {}
        for place, key in zip(i.tolist(), x.tolist(), strict=True):
            if used_item[place : place + low].any():
                continue
            k = end.get(key, begin[key])
            while k < len(y) and y[k] == key and (used_doc[j[k]] or used_doc[j[k] + low - 1] or not np.array_equal(item[place : place + low], doc[j[k] : j[k] + low])):
                k += 1  # marks are of at least this length, so a window's ends tell
            end[key] = k
            if k < len(y) and y[k] == key:
                used_item[place : place + low] = used_doc[j[k] : j[k] + low] = True
                covered, tiles = covered + low, tiles + 1
        top = low - 1
    return covered, tiles


def tile(i: np.ndarray, j: np.ndarray, size: int, seed: int) -> tuple[int, int]:
    """Greedy tiling of seeds (item place, document place) sorted by diagonal and place:
    (covered words, tiles)."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    runs = np.diff(np.concatenate([new, [len(i)]])) + seed - 1
    heap = [(-int(n), int(i[k]), int(j[k])) for k, n in zip(new, runs, strict=True)]
    heapq.heapify(heap)
    used_item, used_doc, covered, tiles = np.zeros(size, bool), {}, 0, 0
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [not used_item[a + k] and (b + k) not in used_doc for k in range(-n)]
        if all(free):
            used_item[a : a - n] = True
            used_doc.update(dict.fromkeys(range(b, b - n)))
            covered, tiles = covered - n, tiles + 1
            if covered == size:
                break
            continue
        k = 0
        while k < -n:  # what the marks leave
            m = k
            while m < -n and free[m]:
                m += 1
            if m - k >= seed:
                heapq.heappush(heap, (k - m, a + k, b + k))
            k = m + 1
    return covered, tiles


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of bounded size, one at a time."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in part], [r["text"] for r in part]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, covered_words, tiles of each document and leaked item."""
    types = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {types[0]}, item_id {types[1]}, coverage double, covered_words int, tiles int"
    out = None
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        part = map_arrow(docs.select(F.col(id_col), F.col(text_col)), leak_rows(ids, texts, benchmark.schema[item_col], seed, coverage), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def leak_rows(ids: list, texts: list, item_field, seed: int, coverage: float):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_field.dataType)

    def run(batches):
        bench = Benchmark(ids, texts, seed)
        for batch in batches:
            found = list(bench.leaks(as_array(batch.column(1)), coverage))
            yield pa.RecordBatch.from_arrays([
                as_array(batch.column(0)).take(pa.array([r for r, *_ in found], pa.int64())), pa.array([bench.ids[k] for _, k, *_ in found], item_type),
                pa.array([c / len(bench.words[k]) for _, k, c, _ in found], pa.float64()), pa.array([c for *_, c, _ in found], pa.int32()), pa.array([t for *_, t in found], pa.int32()),
            ], names=["doc_id", "item_id", "coverage", "covered_words", "tiles"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item leaked."""
    at = docs.columns.index(text_col)
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        docs = map_arrow(docs, clean_rows(ids, texts, at, seed, coverage), docs.schema)
    return docs


def clean_rows(ids: list, texts: list, at: int, seed: int, coverage: float):
    def run(batches):
        bench = Benchmark(ids, texts, seed)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in bench.leaks(as_array(batch.column(at)), coverage)]] = False
            yield batch.filter(pa.array(keep))

    return run
