"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased words and one end for each text.  The model factors a token's
probability by class: a softmax over classes whose features are hashed n-grams of the
preceding tokens (the last one, the last two) and a skip feature (the one before the
last), then the token within its class by nested classes: a class's words are the leaves
of a tree whose nodes have up to ``WIDE`` children, frequent words nearer to the top, and
each node on the way to a word is a softmax over its children, with the last token and
the skip feature, hashed together with the node.  Its start, where all weights are zero,
are the smoothed counts of the words after the preceding token's class.

* Counts of all training tokens are one distributed aggregation of 64-bit word hashes.
* The ``WORDS`` most frequent are the model's own; others form the rare class, inside
  which a token's share is its smoothed count's.  A second pass over the texts writes
  each token's place among the words, two bytes, which is all that later passes read; it
  also counts which frequent tokens precede each word, over all training texts, which
  places words in classes (k-means on the driver over that table of fixed size).
* The counts of (preceding class, word) pairs are summed over all training texts.
* Training is distributed: every task takes gradient steps (AdaGrad) for both factors
  over all of its training tokens, from the shared start; the changes, weighted by
  tokens, are summed by blocks of parameters and averaged.  Both tables of weights have a
  fixed size, as has what reaches the driver.
* Scoring runs in sparse numpy batches: only the few active feature rows of each token
  are gathered.  Rare tokens' counts are looked up by a shuffled join on their hashes,
  of which a row (text) gathers a sum.

Defined cases: a null or empty text is one end token; without training texts every
token is unknown and the score equals the base score; repeated rows are scored each and
train each; a null id counts as the empty text where ids are hashed; other columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, as_array, crc_text, lower_ascii, map_arrow, mix, stored, text_slices, word_hashes, words

#: Frequent words with places of their own in the model (a place has two bytes).
WORDS = 65_535
#: Rows of weights for the classes, and for the nodes inside them as a power of two.
FEATURES = 1 << 14
NODE_BITS = 17
#: Most children of a node.
WIDE = 16
ANCHORS = 32
CLUSTERS = 15
BATCH = 65_536
RATE = 0.3
#: Hash of the end token, which no word has (words' hashes are made odd).
END = np.uint64(2)
#: Smoothing of counts.
ADD = 0.1
#: Distinct words that a task counts before it passes them on.
COUNTED = 500_000


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts, code of each token, hash of each code), an end, the last
    code, after each text's words."""
    offsets, codes, names = words(lower_ascii(texts))
    n = len(texts)
    out = np.full(len(codes) + n, len(names))
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))] = codes
    return offsets + np.arange(n + 1), out, np.append(word_hashes(names) | U64(1), END)


def held_out(ids: list) -> np.ndarray:
    return crc_text(ids) % 10 == 0


def training_slices(batches):
    for batch in batches:
        texts = as_array(batch.column(1)).filter(pa.array(~held_out(batch.column(0).to_pylist())))
        for a, b in text_slices(texts):
            yield encoded(texts.slice(a, b - a))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash), n over the training texts."""

    def run(batches):
        keys, counts, size = [], [], 0
        for _, codes, h in training_slices(batches):
            keys.append(h)
            counts.append(np.bincount(codes, minlength=len(h)))
            size += len(h)
            if size > COUNTED:
                yield merged(keys, counts)
                keys, counts, size = [], [], 0
        if keys:
            yield merged(keys, counts)

    rows = map_arrow(docs, run, "token long, n long")
    return stored(rows.groupBy("token").agg(F.sum("n").alias("n")), "counts")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["token", "n"])


def summed(rows: DataFrame, blocks: int) -> list[np.ndarray]:
    """Adds up blocks (block, values as float32) in streams; ``blocks`` rows of fixed
    size reach the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), "<f4").astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    got = {r["block"]: np.frombuffer(r["data"], "<f8") for r in map_arrow(rows.repartition("block"), add, "block int, data binary").collect()}
    return [got.get(k, np.empty(0)) for k in range(blocks)]


def block_rows(arrays: list[np.ndarray]) -> pa.RecordBatch:
    blobs = [zlib.compress(np.ascontiguousarray(x, "<f4").tobytes(), 1) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(range(len(arrays)), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "data"])


class Vocabulary:
    """Hashes of the model's words in order; others have the place after the last."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes).astype(np.int64)
        self.sorted = hashes[self.order]
        self.size = len(hashes)

    def places(self, h: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.size)


def before(offsets: np.ndarray, places: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preceding token and of the one before it; ``start`` at a text's
    beginning."""
    one = np.concatenate([[start], places[:-1]])
    two = np.concatenate([[start, start], places[:-2]])[: len(places)]
    first = offsets[:-1]
    one[first] = start
    two[first] = start
    second = first + 1
    two[second[second < offsets[1:]]] = start
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of each token's three features."""
    a, b = one.astype(U64), two.astype(U64)
    with np.errstate(over="ignore"):
        pair = a * U64(0x9E3779B97F4A7C15) + b
    return np.stack([mix(a, 11), mix(pair, 12), mix(b, 13)], axis=1)


def feature_rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U64(FEATURES)).astype(np.int64)


ROWS = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, places binary, block int, data binary"


def token_rows(docs: DataFrame, vocabulary: Vocabulary, logs: np.ndarray) -> DataFrame:
    """A row for each text: its tokens' places, the sum of ``logs`` by place, the hashes
    of rare tokens; and in the rows that have a block, a task's part of how often each
    of the most frequent words is one of the two before a word."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, logs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    k, names = vocabulary.size, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "places", "block", "data"]

    def run(batches):
        v, logs = sent.value
        near, task, row, kind = np.zeros((k + 1) * ANCHORS, np.float32), TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            ids, texts = as_array(batch.column(0)), as_array(batch.column(1))
            kind = ids.type
            for a, b in text_slices(texts):
                offsets, codes, h = encoded(texts.slice(a, b - a))
                places = v.places(h).take(codes)
                part = ids.slice(a, b - a)
                held = held_out(part.to_pylist())
                train = ~np.repeat(held, np.diff(offsets))
                for x in before(offsets, places, k + 1):
                    some = (x < ANCHORS) & train
                    near += np.bincount(places[some] * ANCHORS + x[some], minlength=len(near)).astype(np.float32)
                known = places < k
                cold = np.flatnonzero(~known)
                raw = memoryview(places.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(task + row + np.arange(b - a)), part, pa.array(held), pa.array(np.diff(offsets)), pa.array(np.add.reduceat(known.astype(np.int64), offsets[:-1])),
                    pa.array(np.add.reduceat(logs[places], offsets[:-1])), pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, offsets), pa.int32()), pa.array(h[codes[cold]].view(np.int64))),
                    pa.array([bytes(raw[2 * x : 2 * y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()),
                ], names=names)
                row += b - a
        if kind is not None:
            blocks = block_rows(np.array_split(near, PARTS))
            n = blocks.num_rows
            empty = [pa.nulls(n, t) for t in (pa.int64(), kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *blocks.columns], names=names)

    out = stored(map_arrow(docs, run, ROWS.format(id_type)), "tokens")
    sent.destroy()
    return out


def place_slices(blobs: pa.Array):
    """(first row, last row, offsets, places) of texts' places, some at a time."""
    for a, b in text_slices(blobs):
        part = blobs.slice(a, b - a)
        sizes = np.asarray(pc.binary_length(part)).astype(np.int64) // 2
        yield a, b, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(part.to_pylist()), "<u2").astype(np.int64)


def classes_of(counts: np.ndarray, near: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, int]:
    """(class of each word, number of classes): k-means of the anchors' shares."""
    k = len(counts)
    if not k:
        return np.empty(0, np.int64), 0
    share = np.sqrt((near + 0.5) / (near + 0.5).sum(axis=1, keepdims=True))
    centre = share[np.linspace(0, min(k, 4 * clusters) - 1, clusters).astype(int)]
    for _ in range(15):
        group = (share @ centre.T).argmax(axis=1)
        for c in range(clusters):
            mine = group == c
            if mine.any():
                m = (share[mine] * counts[mine, None]).sum(axis=0)
                centre[c] = m / np.linalg.norm(m)
    used, out = np.unique(group, return_inverse=True)
    return out, len(used)


class Tree:
    """Trees over the words of each class.  A node parts an interval of the class's words,
    in falling frequency, where its counts come to equal shares, so frequent words are
    children of their own.  ``children``: of each node a word, (number of words + node) or
    -1; ``levels``: how many nodes each depth has; ``nodes``, ``branches``: of each depth
    and word the node on the way to it, or -1, and its child there."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray):
        k = len(classes)
        order = np.lexsort((-counts, classes))
        total = np.concatenate([[0.0], np.cumsum(counts[order] + ADD)])
        lo = np.flatnonzero(np.diff(classes[order], prepend=-1))
        hi = np.append(lo[1:], k)
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        first, self.levels, children, mass = 0, [], [], []
        parent, side = np.full(2 * k + 1, -1), np.zeros(2 * k + 1, np.int64)
        steps = np.arange(WIDE + 1)
        while len(lo):
            n = len(lo)
            mass.append(total[hi] - total[lo])
            share = total[lo][:, None] + (total[hi] - total[lo])[:, None] * steps / WIDE
            cut = np.clip(np.searchsorted(total, share), lo[:, None] + steps, hi[:, None] - WIDE + steps)
            cut = np.maximum.accumulate(cut, axis=1)
            small = hi - lo <= WIDE
            cut[small] = np.minimum(lo[small][:, None] + steps, hi[small][:, None])
            cut[:, -1] = hi
            a, b = cut[:, :-1].ravel(), cut[:, 1:].ravel()
            inner = b - a > 1
            child = np.where(inner, k + first + n + np.cumsum(inner) - 1, np.where(b > a, order[np.minimum(a, k - 1)], -1))
            there = child >= 0
            parent[child[there]], side[child[there]] = np.repeat(np.arange(first, first + n), WIDE)[there], np.tile(np.arange(WIDE), n)[there]
            children.append(child.reshape(n, WIDE))
            self.levels.append(n)
            first, lo, hi = first + n, a[inner], b[inner]
        self.size, self.words = first, k
        self.children = np.concatenate(children) if children else np.zeros((0, WIDE), np.int64)
        depth = len(self.levels)
        self.nodes, self.branches = np.full((depth, k + 1), -1, np.int32), np.zeros((depth, k + 1), np.int64)  # none for the rare class's slot
        level = np.repeat(np.arange(depth), self.levels)
        at, word = np.arange(k), np.arange(k)
        while len(at := at[some := parent[at] >= 0]):
            word = word[some]
            up = parent[at]
            self.nodes[level[up], word], self.branches[level[up], word] = up, side[at]
            at = k + up
        self.salts = mix(np.arange(first), 14)
        # a node's rows of weights lie together, about four times its share of all tokens
        part = np.concatenate(mass) / max(total[-1], 1e-9) if mass else np.zeros(0)
        self.shifts = (64 - np.clip(np.ceil(np.log2(np.maximum(part, 1e-12) * (4 << NODE_BITS))), 4, NODE_BITS - 3)).astype(U64)

    def start(self, logs: np.ndarray) -> np.ndarray:
        """For each node and preceding class the log shares of the node's children, by
        which words get the log probabilities ``logs`` (preceding class x word)."""
        mass = np.concatenate([np.exp(logs[:, : self.words]), np.zeros((len(logs), self.size + 1))], axis=1)  # the last for no child
        b = self.size
        for n in reversed(self.levels):
            a = b - n
            mass[:, self.words + a : self.words + b] = mass[:, self.children[a:b]].sum(axis=2)
            b = a
        shares = mass[:, self.children] / np.maximum(mass[:, self.words : self.words + self.size, None], 1e-300)
        return np.ascontiguousarray(np.log(np.maximum(shares, 1e-30)).astype(np.float32).swapaxes(0, 1))


def node_rows(hashes: np.ndarray, salts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The rows of weights of features at nodes."""
    with np.errstate(over="ignore"):
        inside = ((hashes ^ salts) * U64(0x9E3779B97F4A7C15)) >> shifts
        return ((salts + inside) & U64((1 << NODE_BITS) - 1)).astype(np.int64)


class Model:
    """classes: of words, the rare class last.  w: feature rows x classes; bias.  Within
    the classes: tree; start: log shares of its nodes' children, for each preceding class
    (a text's beginning: last); node_w: rows of weights of features and nodes."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, n_classes: int, bias: np.ndarray):
        self.vocabulary, self.n_classes = vocabulary, n_classes
        self.classes = np.concatenate([classes, [n_classes], [n_classes + 1]]).astype(np.int64)  # words, rare, start
        self.bias = bias.astype(np.float32)
        self.w = np.zeros((FEATURES, n_classes + 1), np.float32)
        self.tree: Tree | None = None
        self.start: np.ndarray | None = None
        self.node_w = np.zeros((1 << NODE_BITS, WIDE), np.float32)

    def on_the_way(self, hashes: np.ndarray, places: np.ndarray, one: np.ndarray):
        """For each depth: (tokens, children's logits, the child on the way, the features'
        rows of weights, the first in order)."""
        before, start = self.classes[one], self.start.reshape(-1, WIDE)
        last, skip = hashes[:, 0].copy(), hashes[:, 2].copy()
        for nodes, branches in zip(self.tree.nodes, self.tree.branches, strict=True):
            node = nodes.take(places)
            of = np.flatnonzero(node >= 0)
            if not len(of):
                continue
            node = node.take(of).astype(np.int64)
            first = node_rows(last.take(of), self.tree.salts.take(node), self.tree.shifts.take(node))
            order = np.argsort(first.astype(np.int32))  # near in memory
            of, node, first = of.take(order), node.take(order), first.take(order)
            second = node_rows(skip.take(of), self.tree.salts.take(node), self.tree.shifts.take(node))
            z = start.take(node * self.start.shape[1] + before.take(of), axis=0)
            z += self.node_w.take(first, axis=0)
            z += self.node_w.take(second, axis=0)
            yield of, np.minimum(z, 60, out=z), branches.take(places.take(of)), [first, second]

    def node_step(self, hashes: np.ndarray, places: np.ndarray, one: np.ndarray, state: np.ndarray) -> None:
        """One gradient step on the log loss of the words within their classes; ``node_w``
        is a view of the state."""
        for _, z, branch, rows in list(self.on_the_way(hashes, places, one)):
            descend(state, z, branch, rows)

    def word_logs(self, hashes: np.ndarray, places: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Log probability of each token within its class."""
        out = np.zeros(len(places))
        for of, z, branch, _ in self.on_the_way(hashes, places, one):
            out[of] += log_shares(z, branch)
        return out

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        z = self.w.take(rows[:, 0], axis=0)
        z += self.w.take(rows[:, 1], axis=0)
        z += self.w.take(rows[:, 2], axis=0)
        z += self.bias
        z -= z.T.copy().max(axis=0)[:, None]  # along rows as short as these it takes four times as long
        return z

    def step(self, rows: np.ndarray, target: np.ndarray, state: np.ndarray) -> None:
        """One gradient step on the log loss of the classes."""
        order = np.argsort(rows[:, 0].astype(np.int32))
        rows = rows.take(order, axis=0)
        descend(state, self.class_logits(rows), target.take(order), list(rows.T))

    def log10(self, places: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of each token, for a rare one only its class's part."""
        out = np.empty(len(places))
        for a in range(0, len(places), BATCH):
            b = min(a + BATCH, len(places))
            hashes = features(one[a:b], two[a:b])
            z = self.class_logits(feature_rows(hashes))
            target = self.classes[places[a:b]]
            out[a:b] = log_shares(z, target)
            out[a:b] += self.word_logs(hashes, places[a:b], one[a:b])
        return out / np.log(10)


def training_state(w: np.ndarray) -> np.ndarray:
    """Weights and AdaGrad's memory of their squared gradients: rows x 2 x columns, of
    which each table lies on its own, as ``take`` needs."""
    return np.stack([w, np.zeros_like(w)]).swapaxes(0, 1)


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of short rows, as a product: numpy's own sum takes ten times as long."""
    return (x @ np.ones(x.shape[1], x.dtype))[:, None]


def log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log softmax of each row at its target; ``z`` is spent."""
    at = z.reshape(-1).take(np.arange(len(z)) * z.shape[1] + target)
    return at - np.log(row_sums(np.exp(z, out=z)))[:, 0]


def descend(state: np.ndarray, z: np.ndarray, target: np.ndarray, rows: list[np.ndarray]) -> None:
    """One AdaGrad step on the log loss of softmaxes; ``rows``: the rows of weights that
    each feature adds to the logits ``z``, which are spent, the first feature's in order."""
    w, squares = state[:, 0], state[:, 1]
    g = np.exp(z, out=z)
    g /= row_sums(g)
    flat, at = g.reshape(-1), np.arange(len(target)) * g.shape[1] + target
    flat[at] = flat.take(at) - 1
    for k, ids in enumerate(rows):
        part = g
        if k:
            order = np.argsort(ids.astype(np.int32))
            ids, part = ids.take(order), g.take(order, axis=0)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if g.shape[1] % 2 == 0:  # two columns in an addition
            total = np.add.reduceat(part.view(np.complex64), first, axis=0).view(np.float32)
        else:
            total = np.add.reduceat(part, first, axis=0)
        u = ids.take(first)
        now = squares.take(u, axis=0)
        now += total * total
        squares[u] = now
        total *= RATE
        total /= np.sqrt(now, out=now) + 1
        w[u] = w.take(u, axis=0) - total


#: Blocks in which tables of parameters and counts are summed.
PARTS = 16


def pairs_of(rows: DataFrame, model: Model) -> np.ndarray:
    """How often each word (rare ones as one) follows each class, a text's beginning last."""
    sent = rows.sparkSession.sparkContext.broadcast(model.classes)
    k, n = model.vocabulary.size, model.n_classes + 2

    def run(batches):
        classes, pairs = sent.value, np.zeros(n * (k + 1), np.float32)
        for batch in batches:
            for _, _, offsets, places in place_slices(as_array(batch.column(0))):
                pairs += np.bincount(classes[before(offsets, places, k + 1)[0]] * (k + 1) + places, minlength=len(pairs)).astype(np.float32)
        yield block_rows(np.array_split(pairs, PARTS))

    got = np.concatenate(summed(map_arrow(rows, run, "block int, data binary"), PARTS))
    sent.destroy()
    return got.reshape(n, k + 1) if len(got) else np.zeros((n, k + 1))


def trained(rows: DataFrame, model: Model, counts: np.ndarray) -> Model:
    """The model after all training texts' (places): averaged steps from the counts'
    start."""
    k = model.vocabulary.size
    model.tree = Tree(model.classes[:k], counts)
    model.start = model.tree.start(within(pairs_of(rows, model), model.classes[: k + 1], model.n_classes + 1))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import copy

        m = copy.copy(sent.value)
        state, node_state, tokens = training_state(m.w), training_state(m.node_w), 0
        m.w, m.node_w = state[:, 0], node_state[:, 0]
        for batch in batches:
            for _, _, offsets, places in place_slices(as_array(batch.column(0))):
                one, two = before(offsets, places, k + 1)
                target = m.classes[places]
                tokens += len(places)
                for a in range(0, len(places), BATCH):
                    b = a + BATCH
                    hashes = features(one[a:b], two[a:b])
                    m.step(feature_rows(hashes), target[a:b], state)
                    m.node_step(hashes, places[a:b], one[a:b], node_state)
        changes = ((m.w - sent.value.w).ravel(), (m.node_w - sent.value.node_w).ravel())
        yield block_rows([*(x for c in changes for x in np.array_split(c * np.float32(tokens), PARTS)), np.array([tokens])])

    got = summed(map_arrow(rows, run, "block int, data binary"), 2 * PARTS + 1)
    sent.destroy()
    tokens = got[-1][0] if len(got[-1]) else 0.0
    if tokens:
        model.w = (np.concatenate(got[:PARTS]) / tokens).reshape(model.w.shape).astype(np.float32)
        model.node_w = (np.concatenate(got[PARTS : 2 * PARTS]) / tokens).reshape(model.node_w.shape).astype(np.float32)
    return model


def within(pairs: np.ndarray, classes: np.ndarray, n: int, prior: float = 20.0) -> np.ndarray:
    """Log probability of each word in its class given the preceding class: its counts
    there, with the class's overall shares as a prior; 0 for the rare class's own slot."""
    total = pairs.sum(axis=0) + 1e-3
    by_class = np.bincount(classes, weights=total, minlength=n)
    share = total / by_class[classes]
    seen = np.stack([np.bincount(classes, weights=row, minlength=n) for row in pairs])
    p = (pairs + prior * share) / (seen[:, classes] + prior)
    out = np.log(p)
    out[:, classes == n - 1] = 0.0  # the rare slot
    return out


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = token_counts(docs)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    top = counts.orderBy(F.desc("n"), "token").limit(n_words).collect()
    hashes = np.array([r["token"] for r in top], np.int64).view(U64)
    own = np.array([r["n"] for r in top], np.float64)
    vocabulary = Vocabulary(hashes)
    logs = np.log10(np.concatenate([own + ADD, [1.0]]))
    rows = token_rows(docs, vocabulary, logs)
    near = np.concatenate(summed(rows.where("block IS NOT NULL").select("block", "data"), PARTS))
    near = near.reshape(vocabulary.size + 1, ANCHORS)[:-1] if len(near) else np.zeros((vocabulary.size, ANCHORS))
    rows = rows.where("block IS NULL")
    classes, n_classes = classes_of(own, near)
    mass = np.concatenate([np.bincount(classes, weights=own, minlength=n_classes), [n - own.sum() + ADD]])
    model = trained(rows.where("NOT held_out").select("places"), Model(vocabulary, classes, n_classes, np.log((mass + ADD) / (mass + ADD).sum())), own)
    whole = n + ADD * (v + 1)
    # what the base gives rare tokens in all, which they share in the model
    rare = whole - (own + ADD).sum()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        k = m.vocabulary.size
        for batch in batches:
            for a, b, offsets, places in place_slices(as_array(batch.column(6))):
                one, two = before(offsets, places, k + 1)
                score = np.add.reduceat(m.log10(places, one, two), offsets[:-1])  # no text is without a token
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(6)), pa.array(score)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    some = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "places")
    made = stored(map_arrow(some, run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, model double"), "scored")
    sent.destroy()
    cold = rows.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    found = cold.groupBy("row").agg(F.sum(log).alias("logs"), F.count("n").alias("known"))
    out = made.join(found, "row", "left")
    logs, known, n_rare = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0)), F.col("n_tokens") - F.col("n_known")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"),
        (F.col("model") + logs - n_rare * F.lit(float(np.log10(rare)))).alias("score"),
    )
