"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document is the set of its distinct 5-word shingles (64-bit hashes); documents with
equal sets form a class, of which only the smallest id takes part in the join.  Sets of
m and n tokens and similarity s or more have at least o = ceil(s (m + n) / (1 + s)) in
common; so under *every* global order they share a token among the first m - o + 1 of
one and n - o + 1 of the other, and a pair must pass this filter under several orders
before its sets are compared.  The orders put rare tokens first: frequencies come from a
counting sketch of fixed size, summed over all documents, and ties are broken by a hash
that differs between the orders.  Any common order is lossless; the sketch only decides
how short the lists are.  Before texts move, a pair's overlap is bounded from above by
how many tokens each set has in each of about as many cells as it has tokens.

Components need no list of all pairs:

1. Prefix tokens of the first order are shuffled with their places; each token's
   documents are compared with the one that has it earliest (a star), since an original
   has fewer rare tokens than its edited copies.  Pairs that also pass the other orders
   are verified.
2. A document stays in a token's list only while its place and size leave it one there
   to be similar to.  Tokens whose documents lie in one component are done, and so are
   those of two documents.  For the others every pair of documents of different components is still
   compared, after further star rounds while such pairs are many.

Tokens that the sketch calls hot are salted into smaller lists whose first documents
then form a list of their own.  Comparisons are dealt out by (first document, salt), a
few hundred texts each, and stream through the workers.  Components are found in blocks
of links, whose stars are merged by large-star and small-star steps over tables; nothing
of this reaches the driver.

Defined cases: a null text or one without words has no shingles, links with nothing and
is its own component; fewer than five words: the whole sequence is the one shingle; rows
that repeat an id share one decision; a null id takes the component of its class, or
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, U64, as_array, discard, fresh, lower_ascii, map_arrow, mix, rolling, stored, text_slices, word_hashes, words

N = 5
#: Similarity in hundredths.
SIMILAR = 75
SKETCH_BITS = 22
SKETCH_CHUNKS = 64
#: Estimated documents of a token from which its list is salted, and of each part.
HOT = 50_000
#: Texts compared with one copy of a first document.
GROUP = 256
STAR_ROUNDS = 2
#: Pairs left for each document from which another star round is worth its while.
MANY = 8
#: Documents of a token in one block of its list.
BLOCK = 512
#: A cell's largest count; cells that reach it bound nothing.
FULL = 15
#: Links that one task unites.
BLOCK_LINKS = 500_000


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in text_slices(texts):
        offsets, codes, names = words(lower_ascii(texts.slice(a, b - a)))
        hashes = word_hashes(names)[codes] if len(codes) else np.empty(0, U64)
        runs = rolling(hashes, n)
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if y - x >= n:
                out.append(np.unique(runs[x : y - n + 1]))
            elif y > x:
                out.append(mix(rolling(hashes[x:y], y - x), 1000 + y - x))
            else:
                out.append(np.empty(0, U64))
    return out


def prefix_size(n: int, similar: int = SIMILAR) -> int:
    """Of a set of n, whatever the other's size."""
    return n - (similar * n + 99) // 100 + 1


def needed(m, n, similar: int = SIMILAR):
    """Tokens that similar sets of m and n have in common at least."""
    return (similar * (m + n) + 99 + similar) // (100 + similar)


def prefix(tokens: np.ndarray, levels: np.ndarray, order: int, similar: int = SIMILAR) -> np.ndarray:
    """The first tokens of a set under one global order: by level, then by hash."""
    p = prefix_size(len(tokens), similar)
    key = mix(tokens, order)
    level = levels[(tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.lexsort((key, level))[:p]]


def cells_of(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each of a power of two of cells, two counts to a byte."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    counts = np.minimum(np.bincount((tokens & U64(size - 1)).astype(np.int64), minlength=size), FULL).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def counts_of(cells: bytes) -> np.ndarray:
    packed = np.frombuffer(cells, np.uint8)
    out = np.empty(2 * len(packed), np.int16)
    out[0::2], out[1::2] = packed & 15, packed >> 4
    out[out == FULL] = 16_384
    return out


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    while len(counts) > size:
        counts = np.minimum(counts[: len(counts) // 2] + counts[len(counts) // 2 :], 16_384)
    return counts


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the tokens that two sets share, from the counts in their cells."""
    size = min(len(x), len(y))
    return int(np.minimum(folded(x, size), folded(y, size)).sum(dtype=np.int64))


def dealt(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, salt, kind, doc_id and ``columns`` of ``rows``, sorted: each first document (kind
    0) of pairs (a, b) before those that it is compared with, ``GROUP`` at a time."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("copies"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("doc_id"))
    leads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("doc_id"))
    roles = members.unionByName(leads)
    few = 2 * pairs.count() <= BROADCAST_ROWS
    return rows.select("doc_id", *columns).join(F.broadcast(roles) if few else roles, "doc_id").select("a", "salt", "kind", "doc_id", *columns).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "doc_id")


def bounded(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The (a, b) whose cells allow the overlap that they need.  ``sets``: doc_id, n,
    cells."""

    def run(batches):
        lead, at = None, None
        for batch in batches:
            left, right = [], []
            for a, salt, kind, b, n, cells in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                counts = counts_of(cells)
                if kind == 0:
                    lead, at = (n, counts), (a, salt)
                elif at == (a, salt) and most_shared(lead[1], counts) >= needed(lead[0], n, similar):
                    left.append(a)
                    right.append(b)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])

    return map_arrow(dealt(pairs, sets, ["n", "cells"]), run, pairs.schema)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2, cells of each document (a set's size, its 128-bit fingerprint
    and its tokens by cell), and a task's part of the sketch in the rows that have a
    chunk."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    width = (1 << SKETCH_BITS) // SKETCH_CHUNKS
    schema = f"doc_id {id_type}, n long, f1 long, f2 long, cells binary, chunk int, counts binary"

    def run(batches):
        counts, kind = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in batches:
            kind = batch.column(0).type
            sets = shingle_sets(as_array(batch.column(1)))
            with np.errstate(over="ignore"):
                f1 = np.array([mix(s, 1).sum(dtype=U64) for s in sets], U64).view(np.int64)
                f2 = np.array([mix(s, 2).sum(dtype=U64) for s in sets], U64).view(np.int64)
            for s in sets:
                np.add.at(counts, (s >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([cells_of(s) for s in sets], pa.binary()), *none], names=["doc_id", "n", "f1", "f2", "cells", "chunk", "counts"])
        if kind is not None:
            blobs = [zlib.compress(counts[k * width : (k + 1) * width].astype("<u4").tobytes(), 1) for k in range(SKETCH_CHUNKS)]
            empty = [pa.nulls(SKETCH_CHUNKS, t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "f1", "f2", "cells", "chunk", "counts"])

    return stored(map_arrow(docs, run, schema), "prints")


def sketch(rows: DataFrame) -> np.ndarray:
    """The summed sketch; workers add up streams of parts, each in one array."""
    width = (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    summed = map_arrow(rows.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk"), add, "chunk int, counts binary")
    for r in summed.collect():  # SKETCH_CHUNKS rows, 17 MB in all
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], "<u4")
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 4 * np.log2(1 + counts.astype(np.float32))).astype(np.uint8)


def postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, salt, doc (place, doc_id, n), lead (the first of them), rows: prefix tokens
    of the first order that several documents have which may be similar; lead and rows are
    of a (token, salt)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((levels_of(counts), np.clip(counts // HOT + (counts % HOT > 0), 1, 65_535).astype(np.uint16)))

    def run(batches):
        levels, parts = sent.value
        for batch in batches:
            sets = shingle_sets(as_array(batch.column(1)))
            firsts = [prefix(s, levels, 1) if len(s) else s for s in sets]
            sizes = np.array([len(x) for x in firsts], np.int64)
            token = np.concatenate(firsts) if firsts else np.empty(0, U64)
            row = np.repeat(np.arange(len(sets)), sizes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.array([len(s) for s in sets], np.int64)[row]
            split = parts[(token >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            salt = np.where(split > 1, np.array([zlib.crc32(repr(x).encode()) for x in batch.column(0).to_pylist()], np.int64)[row] % split, -1)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(place.astype(np.int32)), as_array(batch.column(0)).take(pa.array(row)), pa.array(n.astype(np.int32))], names=["token", "salt", "place", "doc_id", "n"])

    rows = map_arrow(docs, run, f"token long, salt int, place int, doc_id {id_type}, n int")
    w = Window.partitionBy("token", "salt")
    rows = fitting(rows.select("token", "salt", F.struct("place", "doc_id", "n").alias("doc")), ["token", "salt"], "salt >= 0")
    rows = rows.select("token", "salt", "doc", F.count("*").over(w).alias("rows")).withColumn("lead", F.min("doc").over(w))
    return stored(rows.where("rows > 1 OR salt >= 0"), "postings")


def fitting(rows: DataFrame, keys: list[str], always: str = "false") -> DataFrame:
    """The rows whose ``doc`` may fit another of the same ``keys``, or which ``always``
    holds for.  Two documents fit by place and size (``may_fit``) if neither's size is
    above the other's room, so sorted by size a document is left out only if the next one
    is above its room and none before it has room for it or all before are above its own."""
    w = Window.partitionBy(*keys).orderBy("_size")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.col("doc.n").cast("long").alias("_size"), F.expr(f"({100 + SIMILAR} * (doc.n - doc.place)) div {SIMILAR} - doc.n").alias("_room"))
    rows = rows.select("*", F.lead("_size").over(w).alias("_next"), F.first("_size").over(ahead).alias("_least"), F.max("_room").over(ahead).alias("_most"))
    return rows.where(f"coalesce(_next <= _room, false) OR coalesce(_least <= _room AND _most >= _size, false) OR ({always})").drop("_size", "_room", "_next", "_least", "_most")


def may_fit(x: str, y: str):
    """Whether sets whose first common token is the one of these rows can be similar."""
    o = F.expr(f"({SIMILAR} * ({x}.n + {y}.n) + {99 + SIMILAR}) div {100 + SIMILAR}")
    return (F.col(f"{x}.place") + o <= F.col(f"{x}.n")) & (F.col(f"{y}.place") + o <= F.col(f"{y}.n"))


def pairs_of(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(may_fit(x, y)).select(F.col(f"{x}.doc_id").alias("a"), F.col(f"{y}.doc_id").alias("b"))


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, counts: np.ndarray, similar: int = SIMILAR) -> DataFrame:
    """The (a, b) among pairs that pass the other filters and whose sets are similar."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    some = stored(pairs.distinct(), "candidates")
    pairs = stored(bounded(some, sets, similar), "pairs")
    discard(some)
    rows = dealt(pairs, docs, ["text"])
    sent = docs.sparkSession.sparkContext.broadcast(levels_of(counts))

    def run(batches):
        levels, lead, at = sent.value, None, None
        for batch in batches:
            sets = shingle_sets(as_array(batch.column(4)))
            left, right = [], []
            for a, salt, kind, b, s in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
                firsts = [prefix(s, levels, k, similar) for k in (2, 3)]
                if kind == 0:
                    lead, at = (s, firsts), (a, salt)
                elif at == (a, salt) and passes(lead, (s, firsts), similar) and alike(lead[0], s, similar):
                    left.append(a)
                    right.append(b)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])

    found = stored(map_arrow(rows, run, f"a {id_type}, b {id_type}"), "links")
    sent.destroy()
    discard(pairs)
    return found


def passes(one: tuple, two: tuple, similar: int) -> bool:
    """The filters of the other orders."""
    o = needed(len(one[0]), len(two[0]), similar)
    m, n = len(one[0]) - o + 1, len(two[0]) - o + 1
    return m > 0 and n > 0 and all(len(np.intersect1d(x[:m], y[:n], assume_unique=True)) for x, y in zip(one[1], two[1], strict=True))


def alike(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similar * (len(x) + len(y) - both)


def united(links: DataFrame) -> tuple[DataFrame, int]:
    """Number of blocks, and u, v: each id of a block of links with the smallest id
    of its component there."""
    blocks = max(1, -(-links.count() // BLOCK_LINKS))
    id_type = links.schema["a"].dataType.simpleString()

    def run(batches):
        above: dict = {}

        def top(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(above.setdefault(a, a)), top(above.setdefault(b, b))
                above[max(x, y)] = min(x, y)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(above, kind), pa.array([top(x) for x in above], kind)], names=["u", "v"])

    return stored(map_arrow(links.select("a", "b").repartition(blocks), run, f"u {id_type}, v {id_type}").where("u != v"), "united"), blocks


def connected(links: DataFrame) -> DataFrame:
    """doc_id, comp (the smallest id of its component) of every id in (a, b) links that
    is not the smallest itself."""
    edges, blocks = united(links)
    state = None
    while blocks > 1:
        # large star: the larger neighbours of u move to the smallest of all around u
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges, old = stored(small, "edges"), edges
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp"))


def all_pairs(rest: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b) of every two documents of a token in different components, unless their
    places, sizes or cells rule similarity out.  ``rest``: token, doc, doc_id, comp."""
    id_type = rest.schema["doc_id"].dataType.simpleString()
    lists = rest.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rest.join(lists, "token").select("token", "blocks", F.col("doc.place").alias("place"), F.col("doc.n").alias("n"), "doc_id", "comp")
    whole = rows.where("blocks = 1").select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "place", "n", "doc_id", "comp", F.lit(None).cast("binary").alias("cells"))
    long = rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).join(sets.select("doc_id", "cells"), "doc_id")
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "place", "n", "doc_id", "comp", "cells")
    dealt_out = whole.unionByName(long).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "block", "doc_id")

    def found(rows: list[tuple]) -> tuple[list, list]:
        i, j = rows[0][1:3]
        cells = [counts_of(r[8]) if r[8] is not None else None for r in rows]
        block, place, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        comps = {c: k for k, c in enumerate(dict.fromkeys(r[7] for r in rows))}
        comp = np.array([comps[r[7]] for r in rows])
        left, right = [], []
        for x in range(len(rows)):
            if block[x] != i:
                continue
            y = np.arange(x + 1, len(rows)) if i == j else np.flatnonzero(block == j)
            o = needed(n[x], n[y], similar)
            y = y[(comp[y] != comp[x]) & (place[x] + o <= n[x]) & (place[y] + o <= n[y])]
            for k in y.tolist():
                if cells[x] is None or most_shared(cells[x], cells[k]) >= needed(n[x], n[k], similar):
                    left.append(rows[x][6])
                    right.append(rows[k][6])
        return left, right

    def run(batches):
        held, kind = [], None
        for batch in batches:
            kind = batch.column(6).type
            left, right = [], []
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if held and held[0][:3] != row[:3]:
                    a, b = found(held)
                    left += a
                    right += b
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])
        if held:
            left, right = found(held)
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])

    return map_arrow(dealt_out, run, f"a {id_type}, b {id_type}")


def joined(docs: DataFrame, sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, comp of the linked ones among documents with distinct sets."""
    n_docs = sets.count()
    rows = postings(docs, counts)
    stars = pairs_of(rows.where("doc.doc_id != lead.doc_id"), "lead", "doc")
    tops = rows.where("salt >= 0").groupBy("token").agg(F.min("lead").alias("top"))
    stars = stars.unionByName(pairs_of(rows.where("salt >= 0 AND doc.doc_id = lead.doc_id").join(tops, "token").where("top.doc_id != lead.doc_id"), "top", "lead"))
    links = verified(docs, stars, sets, counts)
    comps = connected(links)
    # a star has settled its first document's pairs, and so lists of two documents; salted
    # tokens stay whole, as no task holds one
    rest = fitting(rows.where("rows > 2 AND salt < 0 AND doc.doc_id != lead.doc_id"), ["token"]).unionByName(rows.where("salt >= 0")).select("token", "doc", F.col("doc.doc_id").alias("doc_id"))
    base = rows
    some = MANY * max(n_docs, 12_500)
    for round_no in range(STAR_ROUNDS + 1):
        rest = rest.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        mixed = rest.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token")
        rest = stored(rest.join(mixed, "token", "left_semi"), "rest")
        discard(base)
        by_comp = rest.groupBy("token", "comp").agg(F.count("*").cast("double").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
        left = by_comp.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0]
        if left is None:
            return comps
        last = left <= some or round_no == STAR_ROUNDS
        now = rest
        if last:
            more = all_pairs(rest, sets)
        else:
            # the one that has the token earliest, once the compared ones are gone
            firsts = rest.groupBy("token").agg(F.min(F.struct("doc", "comp")).alias("f"), F.count("*").alias("open")).select("token", F.col("f.doc").alias("first"), F.col("f.comp").alias("first_comp"), "open")
            more = pairs_of(rest.join(firsts, "token").where("comp != first_comp"), "first", "doc")
            # this star settles lists of two
            left_over = rest.join(firsts.where("open > 2"), "token").where("doc_id != first.doc_id")
            rest = base = stored(left_over.select("token", "doc", "doc_id"), "rest")
        found = verified(docs, more, sets, counts)
        discard(now)
        if not found.isEmpty():
            links = stored(links.unionByName(found), "links")
            comps = connected(links)
        if last:
            return comps
    return comps


def classes(rows: DataFrame) -> DataFrame:
    """f1, f2, n, rep of every set that is not empty."""
    return rows.where("chunk IS NULL AND n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = prints(docs)
    own = rows.where("chunk IS NULL").drop("chunk", "counts", "cells")
    reps = stored(own.where("n > 0").join(classes(rows), ["f1", "f2", "n"]).select("doc_id", "n", "rep"), "classes")
    copies = reps.where("doc_id IS NULL OR doc_id != rep").select("doc_id").distinct()
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    distinct = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    own_sets = rows.where("chunk IS NULL AND n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "cells")
    comps = joined(distinct, own_sets, sketch(rows))
    linked = reps.select("doc_id", "n", F.col("rep")).join(comps.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left").select("doc_id", "n", F.coalesce("comp", "rep").alias("component_id"))
    alone = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    nameless = own.where("n > 0").join(classes(rows), ["f1", "f2", "n"], "left_anti").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless).withColumnRenamed("n", "n_shingles").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their component;
    rows without an id stay unless their class has one."""
    made, gone_id = components(docs, id_col, text_col), fresh(docs, "gone")
    gone = stored(made.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone[gone_id], "left_anti")
