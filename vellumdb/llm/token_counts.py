"""Token counts under a unigram model, by trie-shared dynamic programming.

A pre-token is a word with a word mark before it.  The distinct new pre-tokens of some
texts make a trie, level by level in arrays: sorted, they share a node of each depth with
their neighbour up to their common prefix.  The forward (best-path) score of a prefix is
computed once, at its node, from the nodes up to one longest piece above it, for all
nodes of a depth together; the pieces that end there come from a trie of reversed
pieces.  The terminal node has how many tokens the best segmentation has, which is kept
by word.  A text's count is the sum over its words.

Pieces are those of a public vocabulary file, which has ranks but no probabilities.  A
unigram model of them is estimated on all documents: start scores are those of Zipf's
law (the piece of rank r has the probability 1 / ((r + 1) H), H the harmonic sum); every
word is segmented best under them, the pieces are counted with the words' numbers, and
the counts, ``ADD`` more each, give the model's probabilities (a step of Viterbi
training).  Only these counts, one number for each piece, are summed and reach the
driver.  A character that is a piece nowhere costs one token for each of its UTF-8 bytes,
at a score below every piece's.  Equal scores: the fewer tokens, then the shorter last
piece.

Defined cases: a null or empty text has no tokens; very long words take the same steps
without being inserted; repeated rows are counted each, and count each for the model;
an empty table leaves the start scores and gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_array, discard, map_arrow, stored, text_slices, words

VOCABULARY = "piece_bpe_32k.model"
#: Words of one trie, and words whose tokens a task keeps.
TOGETHER = 50_000
KEPT_WORDS = 300_000
#: Longer words are segmented alone.
LONGEST = 64
MARK = "▁"
#: Smoothing of the pieces' counts.
ADD = 0.1


def zipf(pieces: list[str]) -> dict[str, float]:
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a vocabulary file, in order of rank."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def unigram(pieces: list[str], counts: np.ndarray) -> dict[str, float]:
    """Log probabilities of the pieces by how often each was used."""
    logs = np.log(counts + ADD) - math.log(float(counts.sum()) + ADD * max(1, len(pieces)))
    return dict(zip(pieces, logs.tolist(), strict=True))


class Unigram:
    """Segments words.  ``scores``: of the pieces, in order of rank."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - 10
        self.score = np.array(list(scores.values()), float)
        child: dict[int, int] = {}  # of node and character together, backwards from a piece's end
        rank = [-1]
        for k, p in enumerate(scores):
            node = 0
            for c in reversed(p):
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(rank)
                    rank.append(-1)
                node = child[key]
            rank[node] = k
        self.child, self.ranks, self.rank = child, rank, np.array(rank, np.int64)
        self.keys = np.array(sorted(child), np.int64)
        self.below = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.kept: dict[bytes, int] = {}

    def step(self, node: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The reversed trie's next nodes, or -1."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.below[at], -1)

    def forward(self, text: str) -> list[int]:
        """A long word alone: the ranks of its tokens' pieces, -1 for each byte of an
        unknown character."""
        best, count, back = [0.0], [0], [(0, -1)]
        for end in range(1, len(text) + 1):
            node, found = 0, None
            for start in range(end - 1, -1, -1):
                node = self.child.get(node << 21 | ord(text[start]), -1)
                rank = self.ranks[node] if node >= 0 else -1
                if rank >= 0:
                    s, n = best[start] + self.score[rank], count[start] + 1
                elif start == end - 1:
                    s, n = best[start] + self.unknown, count[start] + len(text[start].encode("utf-8", "replace"))
                if (rank >= 0 or start == end - 1) and (found is None or s > found[0] or s == found[0] and n < found[1]):
                    found = s, n, start, rank
                if node < 0:
                    break
            best.append(found[0])
            count.append(found[1])
            back.append(found[2:])
        out, end = [], len(text)
        while end:
            start, rank = back[end]
            out += [rank] * (1 if rank >= 0 else count[end] - count[start])
            end = start
        return out[::-1]

    def trie(self, texts: list[str]) -> Trie:
        """The forward scores of all prefixes of some words."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        wide = int(size.max())
        array = np.array(texts, f"U{wide}")
        order = np.argsort(array, kind="stable")
        size, chars = size[order], array[order].view(np.uint32).reshape(len(texts), wide).astype(np.int64)
        # characters that a word has in common with the one before it
        same = np.concatenate([[0], np.argmin(np.concatenate([chars[1:] == chars[:-1], np.zeros((len(texts) - 1, 1), bool)], axis=1), axis=1)])
        same[1:] = np.minimum(same[1:], np.minimum(size[1:], size[:-1]))
        total = 1 + int((size - same).sum())
        best, count = np.zeros(total), np.zeros(total, np.int64)
        length, rank = np.zeros(total, np.int64), np.full(total, -1)  # of the last piece
        node = np.zeros((wide + 1, len(texts)), np.int32)  # of each depth and word
        made = 1
        for depth in range(1, wide + 1):
            here = np.flatnonzero(size >= depth)
            new = same[here] < depth
            node[depth, here] = made - 1 + np.cumsum(new)
            word = here[new]
            end = made + len(word)
            c = chars[word, depth - 1]
            above = node[depth - 1, word]
            top, n = best[above] + self.unknown, count[above] + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            by, last = np.ones(len(word), np.int64), np.full(len(word), -1)
            alive, state = np.arange(len(word)), np.zeros(len(word), np.int64)
            for back in range(1, depth + 1):
                state = self.step(state, chars[word[alive], depth - back])
                alive, state = alive[state >= 0], state[state >= 0]
                if not len(alive):
                    break
                piece = self.rank[state]
                some, piece = alive[piece >= 0], piece[piece >= 0]
                above = node[depth - back, word[some]]
                s, t = best[above] + self.score[piece], count[above] + 1
                better = (s > top[some]) | ((s == top[some]) & (t < n[some])) | (back == 1)
                some = some[better]
                top[some], n[some], by[some], last[some] = s[better], t[better], back, piece[better]
            best[made:end], count[made:end], length[made:end], rank[made:end] = top, n, by, last
            made = end
        return Trie(order, size, node, count, length, rank)

    def counts(self, names: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = [x for x in names if x not in self.kept]
        for short, texts in parts(new):
            if texts:
                self.kept.update(zip(short, self.trie(texts).tokens().tolist(), strict=True))
            else:
                self.kept[short] = len(self.forward(marked(short)))
        return np.fromiter((self.kept[x] for x in names), np.int64, len(names))

    def used(self, names: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is used by words that occur so many times."""
        total, weight = np.zeros(len(self.score), np.int64), dict(zip(names, times.tolist(), strict=True))
        for short, texts in parts(names):
            if texts:
                self.trie(texts).add_pieces(total, np.array([weight[x] for x in short], np.int64))
            else:
                for rank in self.forward(marked(short)):
                    if rank >= 0:
                        total[rank] += weight[short]
        return total


class Trie:
    """``order``, ``size``: of the sorted words; ``node``: of each depth and word; of each
    node the tokens, and the last piece's length and rank."""

    def __init__(self, order, size, node, count, length, rank):
        self.order, self.size, self.node, self.count, self.length, self.rank = order, size, node, count, length, rank

    def tokens(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.count[self.node[self.size, np.arange(len(self.order))]]
        return out

    def add_pieces(self, total: np.ndarray, times: np.ndarray) -> None:
        word, end = np.arange(len(self.order)), self.size.copy()
        while len(word):
            at = self.node[end, word]
            known = self.rank[at] >= 0
            np.add.at(total, self.rank[at][known], times[self.order[word[known]]])
            end = end - self.length[at]
            word, end = word[end > 0], end[end > 0]


def marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "replace")


def parts(names: list[bytes]):
    """(words, their texts) of many short words, and (word, None) of each long one."""
    short, texts = [], []
    for x in names:
        text = marked(x)
        if len(text) > LONGEST:
            yield x, None
        else:
            short.append(x)
            texts.append(text)
            if len(texts) == TOGETHER:
                yield short, texts
                short, texts = [], []
    if texts:
        yield short, texts


def piece_counts(docs: DataFrame, vocabulary: str | None = None) -> np.ndarray:
    """How often the best segmentations under the start scores use each piece, over all
    rows of (text)."""

    def run(batches):
        import public_tokenizers

        model, held = Unigram(zipf(pieces_of(vocabulary or public_tokenizers.path(VOCABULARY)))), {}
        total = np.zeros(len(model.score), np.int64)
        for batch in batches:
            texts = as_array(batch.column(0))
            for a, b in text_slices(texts):
                _, codes, names = words(texts.slice(a, b - a))
                for x, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                    held[x] = held.get(x, 0) + n
                if len(held) > KEPT_WORDS:
                    total += model.used(list(held), np.array(list(held.values())))
                    held.clear()
        total += model.used(list(held), np.array(list(held.values()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    def add(batches):
        total = 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = total + np.frombuffer(x, "<i8")
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    rows = map_arrow(docs, run, "counts binary")
    # sums of up to 64 tasks' counts, summed again: rows of one size, a 64th as many each time
    rows = stored(rows, "counts")
    while (n := rows.count()) > 64:
        less = stored(map_arrow(rows.repartition(-(-n // 64)), add, "counts binary"), "counts")
        discard(rows)
        rows = less
    got = [np.frombuffer(r["counts"], "<i8") for r in rows.collect()]
    discard(rows)
    return np.sum(got, axis=0) if got else np.empty(0, np.int64)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = piece_counts(docs.select(F.col(text_col)), vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import public_tokenizers

        pieces = pieces_of(vocabulary or public_tokenizers.path(VOCABULARY))
        model = Unigram(unigram(pieces, sent.value) if len(sent.value) else zipf(pieces))
        for batch in batches:
            texts = as_array(batch.column(1))
            for a, b in text_slices(texts):
                offsets, codes, names = words(texts.slice(a, b - a))
                sums = np.concatenate([[0], np.cumsum(model.counts(names)[codes])])
                yield pa.RecordBatch.from_arrays([as_array(batch.column(0)).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {id_type}, n_words long, n_tokens long")
