"""Toxicity scoring: a counterfactually regularised logistic model.

Features are the presence of words and of their first 3 to 6 letters.  Those whose
document frequency differs significantly between the labels of a bounded sample are
kept, with all identity terms; weights are fitted in numpy by gradient descent on the
log loss.  For every sampled text that names a group, the named identity term is swapped
for each other one of its language, and the squared change of the score is penalised;
equal swaps count together, with their number as weight.  Groups thus get equal weights,
and a neutral mention of one does not raise a score.  Workers turn sampled texts, whole
and of any length, into the hashes of their features; the driver gets those.

Scores are of whole texts and read nothing else.

Defined cases: null and empty texts get the score of a text without known features;
without labels of both kinds every score is the share of toxic labels (0 without any);
an id with several labels counts with each; repeated rows are scored each; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_array, crc_mod, crc_text, discard, keep_ids, map_arrow, stored, text_slices, word_hashes, words

#: The bound of the training sample: rows of each label, and distinct features of the
#: texts in all (8 bytes each); texts of any length are sampled.
SAMPLE_PER_LABEL = 4000
SAMPLE_FEATURES = 12_000_000
MOST_FEATURES = 20_000
#: Smallest |z| of the difference of two document frequencies.
SIGNIFICANT = 4.0
#: Features of the sample that the driver counts at once.
PART = 1 << 18
THRESHOLD = 0.7
KEPT_WORDS = 300_000
#: Terms that name groups, by language; a term is swapped for others of its language.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "european", "gay", "lesbian", "straight", "transgender", "disabled", "deaf", "blind", "old", "young", "immigrant", "immigrants", "refugees", "foreigners"),
    ("frauen", "männer", "frau", "mann", "mädchen", "jungen", "christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "schwarze", "weiße", "asiaten", "afrikaner", "europäer", "schwule", "lesben", "behinderte", "gehörlose", "blinde", "alte", "junge", "einwanderer", "flüchtlinge", "ausländer"),
    ("femmes", "hommes", "femme", "homme", "filles", "garçons", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "noirs", "blancs", "asiatiques", "africains", "européens", "gays", "lesbiennes", "handicapés", "sourds", "aveugles", "vieux", "jeunes", "immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "mujer", "hombre", "chicas", "chicos", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "negros", "blancos", "asiáticos", "africanos", "europeos", "gais", "lesbianas", "discapacitados", "sordos", "ciegos", "viejos", "jóvenes", "inmigrantes", "refugiados", "extranjeros"),
)
OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features_of(word: bytes) -> list[bytes]:
    """The bare word and its beginnings."""
    bare = word.decode("utf-8", "replace").lower().strip(OUTER.decode())
    if not bare:
        return []
    return [bare.encode(), *(b"^" + bare[:n].encode() for n in (3, 4, 5, 6) if len(bare) > n)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray  # sorted hashes of the features
    weights: np.ndarray
    bias: float
    threshold: float = THRESHOLD

    def known(self, names: list[bytes], kept: dict[bytes, tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs of the words' known features."""
        new = [x for x in names if x not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = names
        parts = [features_of(x) for x in new]
        sizes = [len(p) for p in parts]
        h = word_hashes([f for p in parts for f in p])
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        found = np.where(hit, at, -1).tolist()
        k = 0
        for x, n in zip(new, sizes, strict=True):
            kept[x] = tuple(i for i in found[k : k + n] if i >= 0)
            k += n
        pairs = [(w, i) for w, x in enumerate(names) for i in kept[x]]
        return (np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))

    def scores(self, texts: pa.Array, kept: dict[bytes, tuple] | None = None) -> np.ndarray:
        kept = {} if kept is None else kept
        z = np.full(len(texts), self.bias)
        for a, b in text_slices(texts):
            offsets, codes, names = words(texts.slice(a, b - a))
            whose, feature = self.known(names, kept)
            if not len(whose):
                continue
            # only words with known features are followed to their texts
            low = np.searchsorted(whose, np.arange(len(names) + 1))
            some = np.flatnonzero((low[1:] > low[:-1])[codes])
            row = np.searchsorted(offsets, some, side="right") - 1
            count = (low[1:] - low[:-1])[codes[some]]
            first = np.repeat(low[:-1][codes[some]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pairs = np.unique(np.repeat(row, count) * len(self.weights) + feature[first])
            np.add.at(z, a + pairs // len(self.weights), self.weights[pairs % len(self.weights)])
        return sigmoid(z)


def presence(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of the features in each text."""
    out = []
    for k in range(len(texts)):
        _, _, names = words(texts.slice(k, 1))
        out.append(np.unique(word_hashes([f for x in names for f in features_of(x)])))
    return out


def train(rows: list[np.ndarray], toxic: list[int], prior: float | None = None, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 5.0, l2: float = 1e-3, steps: int = 800, threshold: float = THRESHOLD) -> ToxicityModel:
    """``rows``: the features of each text.  ``prior``: the share of toxic rows that
    scores should rest on, if the sample is balanced otherwise; the bias is shifted to it."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))), threshold)
    groups = [[word_hashes(features_of(t.encode())) for t in own] for own in terms]  # the bare term first
    n = np.array([len(y) - y.sum(), y.sum()])
    named = np.unique(np.concatenate([g for own in groups for g in own])) if any(terms) else np.empty(0, np.uint64)
    chosen = np.union1d(telling(rows, y, n), named)
    ri, fi = places(rows, chosen)
    swap, feature, sign, weight = counterfactuals(rows, groups, chosen)
    w, b, m, v = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        own, gw = np.zeros(len(y)), np.zeros(len(w))
        for a in range(0, len(ri), PART):
            np.add.at(own, ri[a : a + PART], w[fi[a : a + PART]])
        g = sigmoid(own + b) - y
        for a in range(0, len(ri), PART):
            np.add.at(gw, fi[a : a + PART], g[ri[a : a + PART]])
        gw = gw / len(y) + l2 * w / max(1, len(w)) ** 0.5
        if len(weight):  # gradient of the mean squared change of the score
            change = np.bincount(swap, weights=sign * w[feature], minlength=len(weight)) * weight / weight.sum()
            gw += 2 * penalty * np.bincount(feature, weights=sign * change[swap], minlength=len(w))
        g_all = np.append(gw, g.mean())
        m, v = 0.9 * m + 0.1 * g_all, 0.999 * v + 0.001 * g_all**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    if prior is not None:
        b += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(n[1] / n[0])
    return ToxicityModel(chosen, w, float(b), threshold)


def telling(rows: list[np.ndarray], y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features whose frequency differs most between the labels,
    ``n`` rows of each.  Ranges of hashes are counted one after the other, about ``PART``
    features at a time, so that counting takes little beside the rows themselves."""
    parts = 1 + sum(len(r) for r in rows) // PART
    borders = np.arange(1, parts, dtype=np.uint64) * np.uint64((2**64 - 1) // parts)
    cuts = np.zeros((len(rows), parts + 1), np.int32)
    for k, r in enumerate(rows):
        cuts[k, 1:-1], cuts[k, -1] = np.searchsorted(r, borders), len(r)
    best, score = np.empty(0, np.uint64), np.empty(0)
    for k in range(parts):
        names, place = np.unique(np.concatenate([r[a:b] for r, a, b in zip(rows, cuts[:, k].tolist(), cuts[:, k + 1].tolist(), strict=True)]), return_inverse=True)
        all_rows, toxic_rows = np.bincount(place, minlength=len(names)), np.bincount(place, weights=np.repeat(y, cuts[:, k + 1] - cuts[:, k]), minlength=len(names))
        share = all_rows / n.sum()
        z = np.abs((toxic_rows / n[1] - (all_rows - toxic_rows) / n[0]) / np.sqrt(np.maximum(share * (1 - share) * (1 / n[0] + 1 / n[1]), 1e-12)))
        best, score = np.append(best, names[z >= SIGNIFICANT]), np.append(score, z[z >= SIGNIFICANT])
        most = np.sort(np.argsort(-score, kind="stable")[:MOST_FEATURES])
        best, score = best[most], score[most]
    return best


def places(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the sorted ``chosen``) of every chosen feature of every row."""
    found = []
    for r in rows:
        at = np.searchsorted(chosen, r)
        found.append(at[chosen[np.minimum(at, len(chosen) - 1)] == r].astype(np.int32) if len(chosen) else np.empty(0, np.int32))
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in found]), np.concatenate(found)


def counterfactuals(rows: list[np.ndarray], groups: list[list[np.ndarray]], chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """All swaps of an identity term that a text names for each other term of its
    language: (swap, feature, sign) of the features gained (1) and lost (-1), and how
    many texts each distinct swap stands for."""
    count: dict[tuple[bytes, bytes], int] = {}
    for own in groups:
        bare = np.array([g[0] for g in own])
        for row in rows:
            for k in np.flatnonzero(np.isin(bare, row)):
                for j, other in enumerate(own):
                    if j != k:
                        key = np.setdiff1d(other, row).tobytes(), np.setdiff1d(own[k], other).tobytes()
                        count[key] = count.get(key, 0) + 1
    swap, feature, sign = [], [], []
    for k, (gained, lost) in enumerate(count):
        for part, s in ((gained, 1.0), (lost, -1.0)):
            places = np.searchsorted(chosen, np.frombuffer(part, np.uint64)).tolist()
            swap += [k] * len(places)
            feature += places
            sign += [s] * len(places)
    return np.array(swap, np.int64), np.array(feature, np.int64), np.array(sign), np.array(list(count.values()), float)


def sample(marks: DataFrame, totals: dict[int, int], most: int) -> DataFrame:
    """Distinct ids: all of a label with at most ``most``, else the ``most`` of least
    hash.  Where that cut lies is found among the hashes below a share of their range
    that holds slightly more of them, so few reach the driver and nothing is sorted."""
    h = F.xxhash64(F.col("doc_id"), F.lit(20240229))
    keep = F.lit(False)
    for label, n in totals.items():
        own = F.col("toxic") == label
        if n > most:
            share = min(1.0, (most + 8 * most**0.5 + 8) / n)
            least = marks.where(own & (h <= F.lit(min(2**63 - 1, int(2**64 * share) - 2**63)))).select(h.alias("h")).collect()
            own &= h <= F.lit(sorted(r["h"] for r in least)[:most][-1])
        keep |= own
    return marks.where(keep).select("doc_id").distinct()


def featured(rows: DataFrame) -> DataFrame:
    """(toxic, h, text) to (toxic, h, n, features), without the texts."""

    def run(batches):
        for batch in batches:
            texts = as_array(batch.column(2))
            for a, b in text_slices(texts, 1 << 20):
                got = presence(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(2)), pa.array([len(x) for x in got], pa.int32()), pa.array([x.astype("<u8").tobytes() for x in got], pa.binary())], names=["toxic", "h", "n", "features"])

    return map_arrow(rows.select("toxic", "h", "text"), run, "toxic int, h long, n int, features binary")


def gathered(made: DataFrame, h: list[int], n: int) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of the rows with the sorted hashes ``h``, ``n`` features in
    all.  One partition's rows at a time are on their way, and all lie in one array."""
    if not h:
        return [], []
    last, tied = h[-1], h.count(h[-1])  # rows that repeat may go beyond the bound
    into, end, rows = np.empty(n, np.uint64), 0, []
    for r in made.where(F.col("h") <= last).select("h", "toxic", "features").toLocalIterator():
        if r["h"] == last:
            tied -= 1
            if tied < 0:
                continue
        own = np.frombuffer(r["features"], "<u8")
        into[end : end + len(own)] = own
        rows.append((r["h"], r["toxic"], end, end := end + len(own)))
    rows.sort(key=lambda r: r[:2])
    return [into[a:b] for _, _, a, b in rows], [t for _, t, _, _ in rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Learns from labelled rows whose crc32(id) mod 3 is not 1, ``per_label`` rows of
    each label at most, with ``SAMPLE_FEATURES`` in all."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(crc_mod("doc_id", 3) != 1).distinct()
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    ids = sample(marks, totals, per_label)
    texts = keep_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL"), ids, "doc_id")
    some = texts.join(keep_ids(marks, ids, "doc_id"), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", "toxic"))
    made = stored(featured(some), "features")
    sizes = made.select("h", "n").orderBy("h").limit(4 * per_label).collect()
    sizes = sizes[: int((np.cumsum([r["n"] for r in sizes]) <= SAMPLE_FEATURES).sum())]
    features, toxic = gathered(made, [r["h"] for r in sizes], sum(r["n"] for r in sizes))
    discard(made)
    total = sum(totals.values())
    return train(features, toxic, totals.get(1, 0) / total if total else None)


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m, kept = sent.value, {}
        for batch in batches:
            score = m.scores(as_array(batch.column(1)), kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc_text(batch.column(0).to_pylist()) % 3 == 1), pa.array(score), pa.array((score >= m.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
