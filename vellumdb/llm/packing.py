"""Best-fit packing by minimum bin slack.

Texts become token ids and a closing 0; only longer ones are cut, into pieces of the
sequence length.  Packing needs no more than how many pieces have each length, a table
of at most ``size`` rows whatever the input, so it runs on the driver: a bitset
subset-sum over the lengths still available finds the fullest combination that fits,
and the combination is taken out as often as the counts allow, which uses up some
length; the number of distinct combinations is thus bounded by the lengths too, not by
the pieces.  Every bin begins with the longest piece left (a subset without it would
only put off the hardest piece).

Pieces get their places by rank: the k-th piece of a length fills the k-th slot that the
combinations hold for that length.  Ranks come from counts for each (task, length), so
no group of equal lengths meets in one task.

Defined cases: a null or empty text is one piece of length 1 (the closing id);
repeated rows are packed each; an empty table gives an empty result; other columns are
not read.  A null id is kept.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_array, kept, lower_ascii, map_arrow, stored, text_slices, word_codes

SIZE = 2048
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 300_000
#: Words encoded in one call, which bounds what the library holds.
ENCODED = 500
#: Of words that are letters only.
PLAIN = 4000
#: Separates words of one call; itself one token.
BREAK = "<|endoftext|>"
MARKS = ",.!?;:|"
#: Of each byte its number among the marks, from 1, and whether it is a letter or digit.
MARK_NUMBER = np.array([MARKS.find(chr(c)) + 1 for c in range(256)], np.int64)
PLAIN_END = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
#: Most marks at a word's end that are kept apart; they make a number of 63 bits.
MOST_MARKS = 21


class WordTokens:
    """Ids of texts.  The tokenizer lower-cases, drops white space and never merges across
    it, nor between a letter or digit and the marks after it (unless it becomes
    something else, as a dotted capital I does: i and a combining dot); so ids are kept by
    lower-cased word without its closing marks, and by those marks, and a word's are
    put together from both.  The store has a fixed size; early words, mostly frequent
    ones, stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.break_id = self.tokenizer.token_to_id(BREAK)
        # whether an id closes a word
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.closes[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.at: dict[bytes, int] = {}
        self.ends: dict[str, bool] = {}
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int32)

    def ids(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, count of each word)."""
        texts = [x.decode("utf-8", "replace") for x in names]
        if self.break_id is None or any("<|" in x for x in texts):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        got = np.array(self.tokenizer.encode_batch_fast([f" {BREAK} ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(got == self.break_id)
        return np.delete(got, cuts), np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1

    def plain_ids(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, which stand one space apart: each gives one
        id at least that closes it, so as many of these as words tell them apart."""
        got = np.array(self.tokenizer.encode_batch_fast([b" ".join(names).decode()], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.closes[got])
        if len(last) == len(names) and last[-1] == len(got) - 1:
            return got, np.diff(last, prepend=-1)
        each = [self.ids(names[k : k + ENCODED]) for k in range(0, len(names), ENCODED)]
        return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])

    def closed_by(self, char: str) -> bool:
        """Whether marks after this character are tokens of their own."""
        if char not in self.ends:
            t = self.tokenizer
            text = t.normalizer.normalize_str(f"{char}.") if t.normalizer else f"{char}."
            self.ends[char] = char.isalnum() and t.pre_tokenizer is not None and t.pre_tokenizer.pre_tokenize_str(text)[-1][0] == "."
        return self.ends[char]

    def look_up(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each of some distinct names, flat ids, bounds of the places).  What
        has no room in the store has a place in this result alone."""
        place = np.fromiter(map(self.at.get, names, repeat(-1)), np.int32, len(names))
        lack = np.flatnonzero(place < 0)
        if not len(lack):
            return place, self.flat, self.bounds
        stored, lacking = len(self.at), [names[k] for k in lack.tolist()]
        letters = np.fromiter((x.isalpha() or not x.isascii() and x.decode("utf-8", "replace").isalpha() for x in lacking), bool, len(lacking))
        order = np.argsort(~letters, kind="stable")
        lacking, plain = [lacking[k] for k in order.tolist()], int(letters.sum())
        place[lack[order]] = np.arange(stored, stored + len(lacking))
        made, sizes = [self.flat], []
        for some, most, encoded in ((lacking[:plain], PLAIN, self.plain_ids), (lacking[plain:], ENCODED, self.ids)):
            for k in range(0, len(some), most):
                ids, count = encoded(some[k : k + most])
                made.append(ids)
                sizes.append(count)
        flat = np.concatenate(made)
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        room = min(len(lacking), CACHE_WORDS - stored)
        if room > 0:
            self.at.update(zip(lacking[:room], range(stored, stored + room)))
            self.bounds = bounds[: stored + room + 1].copy()
            self.flat = flat[: self.bounds[-1]].copy()
        return place, flat, bounds

    def word_ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, bounds) of distinct words."""
        cores, mark_of, marks = parted(names, self.closed_by)
        coded = pa.concat_arrays([cores, pa.array(marks, pa.binary()).cast(pa.string())]).dictionary_encode()
        place, flat, bounds = self.look_up(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        place = place.take(np.asarray(coded.indices))
        parts = np.stack([place[: len(names)], place[len(names) :].take(mark_of)], axis=1).ravel()
        size = np.diff(bounds).take(parts)
        total = np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(axis=1))]).astype(np.int32)
        return flat.take(spread(bounds.take(parts), size)), total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by 0; offsets of the texts)."""
        # special tokens count as written, so texts that may have one keep their case
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        lower = lower_ascii(texts)
        offsets, codes, names = word_codes(pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower)
        n = len(texts)
        if not len(codes):
            return np.zeros(n, np.uint32), np.arange(n + 1)
        flat, bounds = self.word_ids(names)
        first, sizes = bounds.take(codes), np.diff(bounds).take(codes)
        by_text = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        ids = flat.take(spread(first, sizes))
        return np.insert(ids, by_text[1:], 0), by_text + np.arange(n + 1)


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one after the other, in 32 bits."""
    ends = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat((first - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def parted(names: pa.Array, closed_by: Callable[[str], bool]) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """(words without the marks that close them, which marks each had, those marks), if what
    stands before them allows it (``closed_by``; ASCII letters and digits do); else, as
    before very many marks, the word is left whole, with no marks."""
    names = names.cast(pa.string())
    cores = pc.ascii_rtrim(names, characters=MARKS)
    size, total = np.asarray(pc.binary_length(cores)).astype(np.int64), np.asarray(pc.binary_length(names))
    start = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names)].astype(np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8)
    apart = (size > 0) & (size < total) & (total - size <= MOST_MARKS)
    begin, end = start[apart], (start + size)[apart]
    sure, other = PLAIN_END[data[end - 1]], np.flatnonzero(data[end - 1] >= 0x80)
    sure[other] = [closed_by(bytes(data[max(x, y - 4) : y]).decode("utf-8", "ignore")[-1:]) for x, y in zip(begin[other].tolist(), end[other].tolist(), strict=True)]
    apart[apart] = sure
    end, count = (start + size)[apart], (total - size)[apart]
    number = np.zeros(len(end), np.int64)
    for k in range(int(count.max(initial=0))):
        some = np.flatnonzero(count > k)
        number[some] = number[some] * 8 + MARK_NUMBER[data[end[some] + k]]
    numbers, at, which = np.unique(number, return_index=True, return_inverse=True)
    mark_of = np.zeros(len(names), np.int64)
    mark_of[apart] = which + 1
    marks = [bytes(data[end[k] : end[k] + count[k]]) for k in at.tolist()]
    return pc.if_else(pa.array(apart), cores, names), mark_of, [b"", *marks]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and its rank among
    the pieces of its length there."""
    id_type, owner = docs.schema[id_col].dataType.simpleString(), f"packing {tokenizer or TOKENIZER}"

    def run(batches):
        encoder = kept(owner, lambda: WordTokens(tokenizer or tokenizer_path(TOKENIZER)))
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            texts = as_array(batch.column(1))
            for a, b in text_slices(texts, 2 << 20):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                total = np.diff(offsets)
                pieces = -(-total // size)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(size, total[row] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = ((offsets[:-1][row] + start) * 4).tolist()
                crc = [zlib.crc32(raw[x : x + 4 * n]) for x, n in zip(begin, length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = np.arange(len(row)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    pc.take(as_array(batch.column(0)).slice(a, b - a), pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long", keeps=owner)


def fullest(counts: Counter, size: int) -> list[int]:
    """The combination of available lengths that holds the longest one and fills a bin
    most, by a bitset of reachable sums; lengths in descending order."""
    longest = max(counts)
    room = size - longest
    bits, steps, full = 1, [], (1 << (room + 1)) - 1
    goal = 1 << room
    for n in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[n] - (n == longest), room // n)
        times = 1
        while left > 0:  # binary splitting of the copies
            take = min(times, left)
            steps.append((n, take, bits))
            bits |= (bits << (n * take)) & full
            left -= take
            times *= 2
        if bits & goal:
            break
    at, chosen = bits.bit_length() - 1, [longest]
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            chosen += [n] * take
    return sorted(chosen, reverse=True)


def pack(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(combination, how many bins hold it), until every piece is placed."""
    left, out = Counter({n: c for n, c in counts.items() if c > 0}), []
    while left:
        chosen = Counter(fullest(left, size))
        times = min(left[n] // c for n, c in chosen.items())
        out.append((sorted(chosen.elements(), reverse=True), times))
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of this length in a bin, first bin,
    place of the first such piece), by rank."""
    used, rows, bin_no = Counter(), {}, 0
    for chosen, times in plan:
        place = 0
        for n, c in sorted(Counter(chosen).items(), reverse=True):
            rows.setdefault(n, []).append((used[n], c, bin_no, place))
            used[n] += c * times
            place += n * c
        bin_no += times
    return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, id_col, text_col, size, tokenizer), "pieces")
    by_task = pieces.groupBy("length", "task").agg((F.max("rank") + 1).alias("n"))
    # one row for each task within a length: it grows with tasks, not with pieces
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    sent = spark.sparkContext.broadcast(slots(pack(counts, size)))
    ranked = pieces.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        table = sent.value
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, t = length == n, table[int(n)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                step = rank[at] - t[k, 0]
                sequence[at] = t[k, 2] + step // t[k, 1]
                offset[at] = t[k, 3] + step % t[k, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(ranked, place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
