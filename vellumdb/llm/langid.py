"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every word, framed as ``<word>``, gives hashed byte n-grams of 3 to 5 bytes and itself.
A word's vector is the mean of its features' embeddings and a text's the mean of its
words', so both count whole texts.  Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows; a
temperature and a rejection threshold are then calibrated on sampled rows that training
did not see.  Workers turn sampled texts, whole and of any length, into features, of
which a text has ``BUCKETS`` at most, so what reaches the driver has a bound.  Since the model is linear, workers get only the embeddings' products with
the softmax matrix (``BUCKETS`` x languages floats).

Defined cases: a null text, an empty text and one without a letter are ``und`` with
score 0 and rejected; without any labelled row every text is; ties between languages go
to the first in sorted order; repeated rows give repeated results; other columns are
not read.  A null id is kept and counts as the empty text where ids are hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_array, crc_mod, crc_text, discard, keep_ids, lower_ascii, map_arrow, spread_sample, stored, text_slices, words

BUCKETS = 1 << 16
DIM = 16
#: The bound of the training sample: texts for each language, texts in all, and distinct
#: features of the texts in all (6 bytes each); texts of any length are sampled.
SAMPLE_PER_LANG = 400
SAMPLE_TOTAL = 20_000
SAMPLE_FEATURES = 12_000_000
#: No text of a higher score is rejected: one language is then likelier than all others
#: together, and a quantile of a bounded sample would also reject short clean texts.
CEILING = 0.5


def subwords(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of each feature, in order of the word index."""
    sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 2
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join([b"<%b>" % x for x in names]), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(names)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes up to the word's end
    whose, which = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4, 5):
            m = max(0, len(raw) - n + 1)
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ raw[k : k + m]) * np.uint64(0x100000001B3)
            inside = left[:m] >= n
            whose.append(owner[:m][inside])
            which.append((h[inside] ^ (h[inside] >> np.uint64(31))) % np.uint64(BUCKETS))
        steps = np.cumsum((raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ** (left.astype(np.uint64) & np.uint64(63)), dtype=np.uint64)
        whole = steps[ends - 1] - np.concatenate([[np.uint64(0)], steps[ends[:-1] - 1]]) if len(names) else np.empty(0, np.uint64)
        whose.append(np.arange(len(names)))
        which.append((whole ^ (whole >> np.uint64(29))) % np.uint64(BUCKETS))
    whose, which = np.concatenate(whose), np.concatenate(which).astype(np.int64)
    order = np.argsort(whose, kind="stable")
    return whose[order], which[order]


def segment_means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means of consecutive rows; an empty segment gives zeros."""
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, np.diff(offsets))[:, None]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages
    temperature: float = 1.0
    threshold: float = 0.5

    def logits(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, names = words(lower_ascii(texts))
        if not len(codes):
            return np.zeros((len(texts), len(self.langs)))
        whose, which = subwords(names)
        ends = np.searchsorted(whose, np.arange(len(names) + 1))
        by_word = segment_means(self.table[which], ends)
        return segment_means(by_word[codes], offsets)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.langs:
            return best, score
        for a, b in text_slices(texts, 1 << 20):
            part = texts.slice(a, b - a)
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False))
            p = softmax(self.logits(part) / self.temperature)
            best[a:b] = np.where(lettered, p.argmax(axis=1), -1)
            score[a:b] = np.where(lettered, p.max(axis=1), 0.0)
        return best, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: its mean embedding is the weighted sum."""
    out = []
    for k in range(len(texts)):
        _, codes, names = words(lower_ascii(texts.slice(k, 1)))
        whose, which = subwords(names)
        share = np.bincount(codes, minlength=len(names)) / max(1, len(codes)) / np.maximum(1, np.bincount(whose, minlength=len(names)))
        ids, inverse = np.unique(which, return_inverse=True)
        weight = np.bincount(inverse, weights=share[whose], minlength=len(ids)) if len(ids) else np.empty(0)
        out.append((ids.astype(np.uint16), weight.astype(np.float32)))
    return out


Vectors = list[tuple[np.ndarray, np.ndarray]]


def train(docs: Vectors, langs: list[str], calibrate: tuple[Vectors, list[str]] = ((), ()), epochs: int = 4, rate: float = 0.5, keep: float = 0.999, seed: int = 7) -> LanguageModel:
    """``keep``: the share of rightly labelled calibration rows that must not be
    rejected, as far as scores up to ``CEILING`` can tell."""
    known = tuple(sorted(set(langs)))
    if not known:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32))
    rng, k = np.random.default_rng(seed), len(known)
    e, w = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k))
    target = [known.index(x) for x in langs]
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, weight = docs[i]
            lr = rate * (1 - steps / total)
            steps += 1
            h = weight @ e[ids]
            g = softmax((h @ w)[None])[0]
            g[target[i]] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            e[ids] -= (lr * 20 * weight)[:, None] * back[None]
    seen = np.zeros(BUCKETS, bool)
    for ids, _ in docs:
        seen[ids] = True
    e[~seen] = 0  # features that no training text has tell nothing: all languages are alike
    model = LanguageModel(known, (e @ w).astype(np.float32))
    return calibrated(model, *calibrate, keep=keep)


def calibrated(model: LanguageModel, docs: Vectors, langs: list[str], keep: float) -> LanguageModel:
    """The temperature of least log loss, and as threshold the score that a share of
    ``keep`` of the rightly labelled rows reaches, ``CEILING`` at most."""
    rows = [(d, model.langs.index(x)) for d, x in zip(docs, langs, strict=True) if x in model.langs and len(d[0])]
    if not rows:
        return model
    y = np.array([i for _, i in rows])
    z = np.stack([weight @ model.table[ids] for (ids, weight), _ in rows])
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = softmax(z / heat)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    at = float(right[int((1 - keep) * len(right))]) if len(right) else 0.5
    return LanguageModel(model.langs, model.table, heat, min(at, CEILING))


def featured(rows: DataFrame) -> DataFrame:
    """(lang, part, h, text) to (lang, part, h, n, ids, weights), without the texts."""

    def run(batches):
        for batch in batches:
            texts = as_array(batch.column(3))
            for a, b in text_slices(texts, 1 << 20):
                got = vectors(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, b - a) for k in range(3)), pa.array([len(i) for i, _ in got], pa.int32()),
                    pa.array([i.astype("<u2").tobytes() for i, _ in got], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in got], pa.binary()),
                ], names=["lang", "part", "h", "n", "ids", "weights"])

    return map_arrow(rows.select("lang", "part", "h", "text"), run, "lang string, part int, h long, n int, ids binary, weights binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learns from rows with a language whose crc32(id) mod 3 is not 1: remainder 0
    trains, remainder 2 calibrates.  The sample is ``per_lang`` rows of each language and
    remainder at most, ``SAMPLE_TOTAL`` in all, with ``SAMPLE_FEATURES`` in all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("part", crc_mod("doc_id", 3).cast("int")).where("part != 1 AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = spread_sample(rows.withColumn("lang", F.concat_ws("/", "lang", "part")), "doc_id", "lang", per_lang)
    some = keep_ids(rows, ids, "doc_id").withColumn("h", F.xxhash64("doc_id", "text", "lang"))
    made = stored(featured(some), "features")
    sizes = made.select("h", "n").orderBy("h").limit(SAMPLE_TOTAL).collect()
    within = np.cumsum([r["n"] for r in sizes]) <= SAMPLE_FEATURES
    last = sizes[int(within.sum()) - 1]["h"] if within.any() else None
    got = made.where(F.col("h") <= last).orderBy("h", "lang", "part").limit(SAMPLE_TOTAL).collect() if last is not None else []
    discard(made)

    def fold(rows: list) -> tuple[Vectors, list[str]]:
        return [(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["weights"], "<f4")) for r in rows], [r["lang"] for r in rows]

    a, b = [r for r in got if r["part"] == 0] or got, [r for r in got if r["part"] == 2]
    return train(*fold(a), fold(b))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = sent.value
        for batch in batches:
            best, score = m.predict(as_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(crc_text(batch.column(0).to_pylist()) % 3 == 1), pa.array([m.langs[i] if i >= 0 else "und" for i in best], pa.string()),
                pa.array(score), pa.array((best >= 0) & (score >= m.threshold)),
            ], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        for batch in batches:
            best, score = m.predict(as_array(batch.column(at)))
            yield batch.filter(pa.array((best >= 0) & (score >= m.threshold)))

    return map_arrow(docs, run, docs.schema)
