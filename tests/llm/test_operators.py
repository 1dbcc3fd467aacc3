"""Each operator against a brute-force version, over rows with nulls, empty and very
long texts, ties, repeated rows and other columns whose names clash."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumdb.llm import bloom, decontaminate, exact_dedup, jaccard_join, langid, lm_score, packing, substring_dedup, token_counts, toxicity, url_filter

SCHEMA = "score double, doc_id long, kept boolean, text string, n long, lang string, source string, token long, raw string"
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text)"""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 30)
    texts = [None, "", " \t\n", "one", "one two three", "One Two THREE", base, base.upper(), "  " + base.replace(" ", "\n"), base + " ", prose(rng, 25), prose(rng, 19), "ÀÉ ñ 日本 x\u00a0y\x1cz \x0b\x0c"]
    texts += [edited(rng, base, k % 6) for k in range(30)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    texts += [" ".join(["same"] * 60), " ".join(["same"] * 90), prose(rng, 9000), "x" * 30_000, passage + " " + passage]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return out + [(1000, base), (1001, None), (1002, passage)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [(6, dict(rows)[6]), (6, dict(rows)[6])]  # rows repeated outright
    data = [(0.5, i, True, t, i, "en", "src", 7, "r") for i, t in rows + more]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(text):
    return (text or "").translate(dict.fromkeys([*range(9, 14), 32]))


def tokens(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_exact_dedup(spark, docs, none, rows):
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs).collect()}
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in rows + [(6, dict(rows)[6])] * 2:
        groups[squeezed(t)].append((-len(t or ""), i))
    for i, t in rows:
        group = groups[squeezed(t)]
        first = min(group)[1]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (first, len(group), i == first)
        assert got[i]["text_sha256"] == hashlib.sha256(squeezed(t).encode()).hexdigest()
    named = docs.withColumnsRenamed({"n": "_raw", "token": "gone_id"})
    left = exact_dedup.keep_first(named)
    assert left.columns == named.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.dedup(none).count() == exact_dedup.keep_first(none).count() == 0


def test_colliding_digests_are_grouped_by_their_bytes(spark):
    best = lambda i: {"less": -1, "no_id": False, "doc_id": i}
    kind = "struct<less:long,no_id:boolean,doc_id:long>"
    out = spark.createDataFrame([(bytearray(b"d"), i, best(i), 4, best(1)) for i in (1, 2, 3, 4)], f"digest binary, raw long, best {kind}, n long, first {kind}")
    wrong = spark.createDataFrame([(bytearray(b"d"), i, best(i), "other") for i in (3, 4)], f"digest binary, raw long, best {kind}, norm string")
    got = {r["raw"]: (r["n"], r["first"]["doc_id"]) for r in exact_dedup.regrouped(out, wrong).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (2, 3)}


def test_merge_index_takes_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.LsmIndex()
    for k in range(5):
        index.insert(frame([(10 * k + 1, f"text {k}"), (10 * k + 2, "common")]))
    assert [len(x) for x in index.levels] == [1, 1]  # four sets were merged
    merged = {r["best"]["doc_id"]: r["n"] for r in index.compact().collect()}
    assert merged == {1: 1, 11: 1, 21: 1, 31: 1, 41: 1, 2: 5}
    got = index.lookup(frame([(99, "com mon"), (98, "new"), (97, "text3")])).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(97, 31), (99, 2)]


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 20_000, 2)
    f = bloom.build(keys, F.col("id"), 10_000)
    passed = {r["id"] for r in f.possible(spark.range(20_000), F.col("id")).collect()}
    assert passed >= set(range(0, 20_000, 2))
    assert len(passed) < 10_600


def test_url_filter(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://xexample.com/en/7", "http://net/de/", "ftp://u@b.example.net/de/80", "http://example.net/de/7", "http://com?/en/", "x://y.org#/es/", "http://y.org/es/", "http://É.com/en/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(4, urls[4], "again")], "page_id long, url string, verdict string")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

    def judged(url):
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.find("/") :])]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = [(r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()]
    assert sorted(k for k, _ in got) == sorted([*range(len(urls)), 4])
    for k, g in got:
        assert g == judged(urls[k]), urls[k]
    many = spark.createDataFrame([("block", f"h{k}.x/{'p' * k}") for k in range(300)], "action string, rule string")
    some = spark.createDataFrame([(k, f"http://a.h{k}.x/{'p' * (k + 1)}") for k in range(5)], "page_id long, url string")
    assert {r["rule"] for r in url_filter.judge(some, many).collect()} == {f"h{k}.x/{'p' * k}" for k in range(5)}
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, rules).limit(0)).collect()} == {"allow"}
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)  # all joins shuffle
    again = [(r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filter.judge(pages.withColumnRenamed("url", "_url"), url_filter.rule_table(spark), url_col="_url").collect()]
    assert sorted(again, key=str) == sorted(got, key=str)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def windows_removed(rows, size=20):
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = tokens(t)
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k : k + size]), (i, k)) != (i, k):
                gone[i].update(range(k, k + size))
    return gone


def test_substring_dedup(spark, docs, none, rows):
    gone = windows_removed(rows)
    assert any(gone.values())
    for r in substring_dedup.dedup(docs).collect():
        w = tokens(dict(rows)[r["doc_id"]])
        body = b" ".join(x for k, x in enumerate(w) if k not in gone[r["doc_id"]])
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone[r["doc_id"]]), hashlib.sha256(body).hexdigest()), r["doc_id"]
    assert substring_dedup.dedup(none).count() == 0
    nameless = spark.createDataFrame([(None, "a " * 50), (1, "b " * 50)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(nameless).collect()} == {None: 0, 1: 49}


def test_substring_dedup_without_a_filter_and_with_little_memory(spark, docs, rows, monkeypatch):
    gone = windows_removed(rows)
    assert substring_dedup.levels(20) == [5, 10, 20] and substring_dedup.levels(7) == [3, 7]
    for blocks, passes in ((1, 0), (30, 1000)):  # all pass, and a filter in many parts
        monkeypatch.setattr(substring_dedup, "FILTER_BLOCKS", blocks)
        monkeypatch.setattr(substring_dedup, "PASSES", passes)
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()}
        assert got == {i: len(gone[i]) for i, _ in rows}


def test_filters_of_repeated_windows_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FILTER_BLOCKS", 50)
    keys = np.random.default_rng(2).integers(0, 2**64, 900, dtype=np.uint64)
    parts = list(substring_dedup.filters(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "half long"), len(keys)))
    assert len(parts) == 4
    assert (sum(p.alive(keys) for p in parts) == 1).all()  # each in the part that is its own
    others = np.random.default_rng(3).integers(0, 2**64, 9000, dtype=np.uint64)
    assert sum(p.alive(others) for p in parts).sum() < 900


def test_a_half_with_too_many_windows_is_dealt_out_again(monkeypatch):
    """The resolver in pieces of few rows, remembering few windows."""
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 5)
    monkeypatch.setattr(substring_dedup.Resolver, "HELD", 3)
    rng = random.Random(2)
    data = [(half, doc, start, [rng.randrange(12) for _ in range(rng.randrange(1, 4))]) for half in (1, 2, 2**40) for doc in range(30 if half == 2 else 2) for start in (0, 50)]
    first, want = {}, set()
    for half, doc, start, windows in data:
        for k, w in enumerate(windows):
            if first.setdefault((half, w), (doc, start + k)) != (doc, start + k):
                want.add((doc, start + k, half))
    state, out = substring_dedup.Resolver(), []
    for at in range(0, len(data), 4):
        part = data[at : at + 4]
        batch = pa.RecordBatch.from_arrays([
            pa.array([h for h, *_ in part], pa.int64()), pa.array([d for _, d, *_ in part], pa.int64()), pa.array([s for *_, s, _ in part], pa.int32()), pa.array([len(w) for *_, w in part], pa.int32()),
            pa.array([np.array(w, "<u8").tobytes() for *_, w in part], pa.binary()),
        ], names=["half", "doc_id", "start", "n", "hashes"])
        out += state.step(batch)
    out += state.flush()
    got, late = collections.Counter(), collections.defaultdict(list)
    for batch in out:
        for r in batch.to_pylist():
            if r["half"] is None:
                got.update((r["doc_id"], r["start"] + k) for k in range(r["n"]))
            else:
                late[r["half"], r["window"]].append((r["doc_id"], r["start"]))
    assert late
    for places in late.values():
        got.update(sorted(places)[1:])
    assert got == collections.Counter((d, s) for d, s, _ in want)


def shingles(text):
    w = tokens(text, True)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_components(rows):
    sets, above = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return sets, {i: top(i) for i in above}


def test_jaccard_components(spark, docs, none, rows):
    sets, comps = linked_components(rows)
    got = jaccard_join.components(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comps[r["doc_id"]])
    left = jaccard_join.keep_one(docs.withColumnRenamed("n", "_gone"))
    assert left.columns == docs.withColumnRenamed("n", "_gone").columns
    assert {r["doc_id"] for r in left.collect()} == set(comps.values())
    assert jaccard_join.components(none).count() == 0


@pytest.mark.parametrize("blocks", [True, False])
def test_jaccard_with_salted_lists_and_blocks(spark, monkeypatch, blocks):
    """A large group of edited copies whose mutual similarity is around the threshold."""
    monkeypatch.setattr(jaccard_join, "HOT", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK_LINKS", 30)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0 if blocks else 2)
    monkeypatch.setattr(jaccard_join, "MANY", 0)  # star rounds while any pair is left
    rng = random.Random(9)
    base = prose(rng, 90)
    rows = [(k, edited(rng, base, rng.randrange(6))) for k in range(70)]
    _, comps = linked_components(rows)
    assert 1 < len(set(comps.values())) < 70
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comps


def test_jaccard_lists_keep_what_may_be_similar(spark):
    rng = random.Random(12)
    lists = {t: [(rng.randrange(n), k, n) for k, n in enumerate(rng.choices((5, 6, 7, 9, 12, 30, 38, 200, 250, 1000), k=rng.randrange(1, 8)))] for t in range(300)}
    rows = spark.createDataFrame([(t, x) for t, docs in lists.items() for x in docs], "token long, doc struct<place: int, doc_id: long, n: int>")
    got = {(r["token"], r["doc"]["doc_id"]) for r in jaccard_join.fitting(rows, ["token"]).collect()}

    def fit(x, y):
        o = int(jaccard_join.needed(x[2], y[2]))
        return x[1] != y[1] and x[0] + o <= x[2] and y[0] + o <= y[2]

    want = {(t, x[1]) for t, docs in lists.items() for x in docs if any(fit(x, y) for y in docs)}
    assert want <= got and len(got) < rows.count() / 5
    # a passage in texts of sizes too far apart makes no list, however many they are
    passage = prose(rng, 12)
    docs = spark.createDataFrame([(k, f"{passage} {prose(rng, 40 * 2**k)}") for k in range(8)], "doc_id long, text string")
    counts = jaccard_join.sketch(jaccard_join.prints(docs))
    assert jaccard_join.postings(docs, np.zeros_like(counts)).count() == 0


def test_prefix_bounds_are_lossless():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 5, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        if len(y) and jaccard_join.alike(x, y, 75):
            assert jaccard_join.passes((x, [jaccard_join.prefix(x, levels, k) for k in (2, 3)]), (y, [jaccard_join.prefix(y, levels, k) for k in (2, 3)]), 75)


def test_cells_bound_what_sets_share():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 700)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(1, 500)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        most = jaccard_join.most_shared(*(jaccard_join.counts_of(jaccard_join.cells_of(s)) for s in (x, y)))
        assert both <= most <= min(len(x), len(y)) or most >= 16_384
    full = np.arange(64, 64 * 40, 64).astype(np.uint64)  # all in one cell
    assert jaccard_join.most_shared(*[jaccard_join.counts_of(jaccard_join.cells_of(full))] * 2) >= len(full)


def test_packing(spark, docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    want = collections.Counter()
    for i, text in rows + [(6, dict(rows)[6])] * 2:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packed(docs).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed(none).count() == 0


def test_packing_of_special_tokens():
    from tokenizers import Tokenizer

    texts = ["<|ENDOFTEXT|> b", "a <|endoftext|> B", "A<|StartOfText|>.", "plain Text <|", None, "<|startoftext|>x, <|endoftext|>!"]
    path = packing.tokenizer_path(packing.TOKENIZER)
    t, coder = Tokenizer.from_file(path), packing.WordTokens(path)
    for _ in range(2):  # the second time from the store
        ids, offsets = coder.encode(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0], x


def test_packing_encodes_words_of_letters_together(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    t, coder = Tokenizer.from_file(path), packing.WordTokens(path)
    names = ["the", "ΟΔΟΣ", "İstanbul", "ﬁn", "ª", "日本語", "한국어", "Ǆ", "straße", "x" * 300, "été", "e\u0301te", "don't", "a1b", "...", "s", "t", "\U0001d518x", "anderhastnd"] + [f"q{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(200)]
    asked, ids = [], coder.ids
    monkeypatch.setattr(coder, "ids", lambda some: asked.extend(some) or ids(some))
    got, offsets = coder.encode(pa.array([f"{x}," for x in names]))
    for k, x in enumerate(names):
        assert got[offsets[k] : offsets[k + 1]].tolist() == [*t.encode(f"{x},", add_special_tokens=False).ids, 0], x
    # a word that gives another number of closing ids sends its batch the other way
    plain = [x.encode() for x in names if x.isalpha() and x != "İstanbul"]
    asked.clear()
    flat, sizes = coder.plain_ids(plain)
    assert not asked and flat.tolist() == [i for x in plain for i in t.encode(x.decode(), add_special_tokens=False).ids] and len(sizes) == len(plain)


def test_packing_keeps_words_without_their_marks(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    words = ["alpha,", "beta.", "...", "été;", "日本|", "x\u00a0.", "’s!", "a" + "." * 21, "a" + "?!" * 11, "b<|", "7:", "٣,", "½.", "e\u0301,", ".a,", ",;", "don't.", "aİ.", "\u0958,"]
    cores, mark_of, marks = packing.parted(pa.array(["skipped!", *words])[1:], packing.WordTokens(path).closed_by)
    for word, core, k in zip(words, cores.to_pylist(), mark_of.tolist(), strict=True):
        short = word.rstrip(packing.MARKS)
        whole = not short[-1:].isalnum() or short[-1] in "İ\u0958" or len(word) - len(short) > packing.MOST_MARKS
        assert (core, marks[k].decode()) == ((word, "") if whole else (short, word[len(short) :]))
    for room in (0, 3, 300_000):  # whatever has no place in the store is encoded again
        monkeypatch.setattr(packing, "CACHE_WORDS", room)
        coder = packing.WordTokens(path)
        for text in [" ".join(words), "Alpha. beta, beta alpha", " ".join(words[::-1])] * 2:
            ids, offsets = coder.encode(pa.array([text, None, text]))
            want = [*t.encode(text, add_special_tokens=False).ids, 0]
            assert ids.tolist() == [*want, 0, *want] and offsets.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]
        assert len(coder.at) <= room
    coder, asked = packing.WordTokens(path), []
    for name in ("ids", "plain_ids"):
        monkeypatch.setattr(coder, name, lambda some, of=getattr(coder, name): asked.extend(some) or of(some))
    coder.encode(pa.array(["alpha, beta. gamma"]))
    asked.clear()
    coder.encode(pa.array(["alpha. beta, gamma. Alpha Beta"]))
    assert not asked


def test_packing_takes_the_fullest_combination():
    rng = random.Random(1)
    for _ in range(60):
        counts = collections.Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 9)))
        chosen = packing.fullest(counts, 60)
        assert max(counts) in chosen and not collections.Counter(chosen) - counts
        sums = {max(counts)}
        rest = list((counts - collections.Counter([max(counts)])).elements())
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(chosen) == max(s for s in sums if s <= 60)
        plan = packing.pack(counts, 60)
        placed = collections.Counter()
        for c, times in plan:
            for n in c:
                placed[n] += times
        assert placed == counts and all(sum(c) <= 60 for c, _ in plan)


def segmented(scores, word):
    """(tokens, pieces) of the best segmentation, by trying all pieces at all places."""
    worst = min(scores.values()) - 10
    text, state = token_counts.MARK + word.decode(), [(0.0, 0, ())]
    longest = max(map(len, scores))
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - longest), end):
            piece = text[start:end]
            if piece in scores:
                ways.append((state[start][0] + scores[piece], -state[start][1] - 1, start, (*state[start][2], piece)))
            elif len(piece) == 1:
                ways.append((state[start][0] + worst, -state[start][1] - len(piece.encode()), start, state[start][2]))
        best = max(ways, key=lambda w: w[:3])
        state.append((best[0], -best[1], best[3]))
    return state[-1][1:]


def test_token_counts(spark, docs, none, rows, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(token_counts.VOCABULARY)
    pieces = token_counts.pieces_of(path)
    start, used, seen = token_counts.zipf(pieces), collections.Counter(), {}
    words = collections.Counter(w for _, t in rows + [(6, dict(rows)[6])] * 2 for w in tokens(t))
    for w, n in words.items():
        if w not in seen:
            seen[w] = segmented(start, w)[1] if len(w) < 1000 else None
        for p in seen[w] or [pieces[k] for k in token_counts.Unigram(start).forward(token_counts.marked(w)) if k >= 0]:
            used[p] += n
    whole = math.log(sum(used.values()) + token_counts.ADD * len(pieces))
    scores = {p: math.log(used[p] + token_counts.ADD) - whole for p in pieces}
    by_word = {w: segmented(scores, w)[0] for w in words if len(w) < 1000}
    for together, kept in ((token_counts.TOGETHER, token_counts.KEPT_WORDS), (40, 3)):
        model = token_counts.Unigram(scores)
        monkeypatch.setattr(token_counts, "TOGETHER", together)
        monkeypatch.setattr(token_counts, "KEPT_WORDS", kept)
        names = list(by_word)
        for part in (names[:200], names[100:], names):
            assert model.counts(part).tolist() == [by_word[w] for w in part]
    monkeypatch.undo()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.counted(docs).collect()}
    for i, t in rows:
        if all(w in by_word for w in tokens(t)):
            assert got[i] == (len(tokens(t)), sum(by_word[w] for w in tokens(t))), t
    assert got[1000][0] == 120
    assert token_counts.counted(none).count() == 0


def test_token_counts_of_long_words_are_those_of_the_trie(monkeypatch):
    rng = random.Random(17)
    pieces = ["▁", "▁a", "a", "ab", "ba", "aab", "bb", "b", "abab", "▁ba", "é"]
    scores = {p: math.log((k + 1) / 66) for k, p in enumerate(pieces)}
    words = ["".join(rng.choice("abéc\0") for _ in range(rng.randrange(1, 9 if k % 2 else 300))).encode() for k in range(60)]
    words = list(dict.fromkeys(words))
    want = [segmented(scores, w)[0] for w in words]
    for longest in (0, 64, 1000):  # all without the trie, some, none
        monkeypatch.setattr(token_counts, "LONGEST", longest)
        assert token_counts.Unigram(scores).counts(words).tolist() == want
        used = collections.Counter(p for k, w in enumerate(words) for p in segmented(scores, w)[1] for _ in range(k))
        assert token_counts.Unigram(scores).used(words, np.arange(len(words))).tolist() == [used[p] for p in pieces]


def test_lm_scores(spark, docs, none, rows):
    got = {r["doc_id"]: r for r in lm_score.scored(docs, n_words=100).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    texts = {i: [*tokens(t, True), None] for i, t in rows}
    train = [w for i, t in rows + [(6, dict(rows)[6])] * 2 if i not in held for w in texts[i]]
    c = collections.Counter(train)
    whole = len(train) + 0.1 * (len(c) + 1)
    for i, r in got.items():
        want = sum(math.log10((c[w] + 0.1) / whole) for w in texts[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(texts[i]), sum(w in c for w in texts[i]), len(train))
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert r["score"] < 0
    assert lm_score.scored(none).count() == 0


def test_lm_probabilities_sum_to_one_and_beat_the_base(spark):
    rng = random.Random(4)
    # the next word depends on the last: word k is followed by one of three
    def walk():
        at, out = rng.randrange(30), []
        for _ in range(80):
            out.append(f"v{at}")
            at = (at * 7 + rng.randrange(3)) % 30
        return " ".join(out)

    docs = spark.createDataFrame([(k, walk()) for k in range(600)], "doc_id long, text string")
    got = lm_score.scored(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > 0.75 * got[1]
    table = lm_score.within(np.arange(16, dtype=float).reshape(4, 4), np.array([0, 0, 1, 2]), 3)
    for row in np.exp(table):
        assert row[:2].sum() == pytest.approx(1) and row[2] == pytest.approx(1) and row[3] == 1


def test_lm_words_within_a_class_depend_on_the_words_before():
    rng = np.random.default_rng(3)
    k, counts = 40, np.floor(1000 / np.arange(1, 41))
    model = lm_score.Model(lm_score.Vocabulary(np.arange(k).astype(np.uint64)), np.arange(k) % 3 // 2, 2, np.zeros(3))
    table = lm_score.within(rng.integers(0, 50, (4, k + 1)).astype(float), model.classes[: k + 1], 3)
    model.tree = lm_score.Tree(model.classes[:k], counts)
    model.start = model.tree.start(table)
    places = np.arange(k + 1)  # the rare class's slot last
    near = lambda w: (np.full(k + 1, w), np.full(k + 1, 7))
    logs = lambda w: model.word_logs(lm_score.features(*near(w)), places, near(w)[0])
    for w in (0, 5, k, k + 1):  # the start is the table of counts
        assert logs(w) == pytest.approx(table[model.classes[w]], abs=1e-5)
    # word 9 after word 3, word 30 after word 4: all of one class
    assert len({int(model.classes[x]) for x in (3, 4, 9, 30)}) == 1
    state = lm_score.training_state(model.node_w)
    model.node_w = state[:, 0]
    one, target = np.tile([3, 4], 50), np.tile([9, 30], 50)
    for _ in range(30):
        model.node_step(lm_score.features(one, np.full(100, 7)), target, one, state)
    p, q = np.exp(logs(3)), np.exp(logs(4))
    assert p[9] > 0.5 > 0.2 > q[9] and q[30] > 0.5 > 0.2 > p[30]
    for x in (p, q):
        for c in range(3):
            assert x[model.classes[: k + 1] == c].sum() == pytest.approx(1, abs=1e-5)


def test_language_id(spark, docs, none):
    rng = random.Random(8)
    alphabets = {"aa": ["ba", "ke", "lo"], "bb": ["ßu", "tz", "ör"], "cc": ["ñi", "qué", "rr"]}
    make = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(3)) for _ in range(rng.randrange(3, 40)))
    data = [(i, make(k), k) for i, k in enumerate(rng.choice(list(alphabets)) for _ in range(400))]
    data += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "ba" * 30_000, None)]
    frame = spark.createDataFrame([(i, t, k, 0.1) for i, t, k in data], "doc_id long, text string, lang string, score double")
    model = langid.fit(frame)
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    truth = {i: k for i, _, k in data[:400]}
    held = [i for i in truth if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.98 * len(held) > 50
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert got[1003]["lang_pred"] == "aa"
    others = ["жги клм прст", "αβγ δεζ", "日本語のテキスト", "xqzw wvkj"]
    assert all(s < model.threshold for s in model.predict(pa.array(others))[1])
    kept = langid.keep_identified(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["accepted"]}
    blank = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(frame, blank).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_lm_log_probabilities_by_brute_force():
    """Each factor by walking the model's tables from the class down to the word."""
    rng = np.random.default_rng(12)
    k, counts = 300, np.floor(3000 / np.arange(1, 301))
    classes = rng.integers(0, 3, k)
    model = lm_score.Model(lm_score.Vocabulary(np.arange(k).astype(np.uint64)), classes, 3, rng.normal(size=4))
    model.tree = lm_score.Tree(classes, counts)
    model.start = model.tree.start(lm_score.within(rng.integers(0, 9, (5, k + 1)).astype(float), model.classes[: k + 1], 4))
    model.w[:] = rng.normal(0, 0.3, model.w.shape)
    model.node_w[:] = rng.normal(0, 0.3, model.node_w.shape)
    above = {int(c): (n, j) for n, row in enumerate(model.tree.children) for j, c in enumerate(row) if c >= 0}
    share = lambda z, j: float(z[j] - np.log(np.exp(np.float64(z)).sum()))

    def slow(word, one, two):
        h = lm_score.features(np.array([one]), np.array([two]))
        total = share(model.bias + sum(model.w[r] for r in lm_score.feature_rows(h)[0]), model.classes[word])
        at = word
        while at in above:
            node, j = above[at]
            rows = [int(lm_score.node_rows(h[:, f], model.tree.salts[[node]], model.tree.shifts[[node]])[0]) for f in (0, 2)]
            total += share(model.start[node, model.classes[one]] + model.node_w[rows].sum(axis=0), j)
            at = k + node
        return total / math.log(10)

    with np.errstate(over="ignore"):
        for one, two in ((0, 7), (250, 3), (k, k + 1), (k + 1, k + 1)):
            want = np.array([slow(w, one, two) for w in range(k + 1)])
            got = model.log10(np.arange(k + 1), np.full(k + 1, one), np.full(k + 1, two))
            assert got == pytest.approx(want, abs=1e-4)
            assert (10**got).sum() == pytest.approx(1, abs=1e-4)  # the rare class counts as a whole
    assert model.tree.children.shape[1] == lm_score.WIDE and len(model.tree.levels) > 1


def test_lm_step_by_brute_force():
    """Both tables lie on their own, so that rows are taken without a copy of the table,
    and a step is AdaGrad's, for an even and an odd number of columns."""
    rng = np.random.default_rng(6)
    for wide in (16, 5):
        w = rng.normal(size=(50, wide)).astype(np.float32)
        state = lm_score.training_state(w)
        assert state.shape == (50, 2, wide) and state[:, 0].flags.c_contiguous and state[:, 1].flags.c_contiguous
        squares = np.zeros((50, wide))
        for _ in range(3):
            rows = [np.sort(rng.integers(0, 50, 400)), rng.integers(0, 50, 400)]
            target, z = rng.integers(0, wide, 400), rng.normal(size=(400, wide)).astype(np.float32)
            g = np.exp(z.astype(float))
            g = g / g.sum(axis=1, keepdims=True) - np.eye(wide)[target]
            lm_score.descend(state, z, target, rows)
            for ids in rows:
                total = np.stack([g[ids == r].sum(axis=0) for r in range(50)])
                squares += total**2
                w = w - np.where(total == 0, 0, lm_score.RATE * total / (np.sqrt(squares) + 1))
            assert state[:, 0] == pytest.approx(w, abs=1e-4) and state[:, 1] == pytest.approx(squares, rel=1e-3, abs=1e-4)
    docs = pa.array(["B a b", None])
    offsets, codes, hashes = lm_score.encoded(docs)  # a hash for each distinct token
    assert offsets.tolist() == [0, 4, 5] and codes.tolist() == [0, 1, 0, 2, 2] and len(hashes) == 3 and hashes[2] == lm_score.END


def test_null_ids_repeats_and_ties(spark):
    """Rows without an id and rows that repeat are judged each."""
    texts = [(None, "ba be bi"), (None, None), (None, "ba be bi"), (3, "ba be bi"), (3, "ba be bi"), (8, ""), (9, "zz " * 3000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, lang string, piece int")
    count = lambda rows: collections.Counter(r["doc_id"] for r in rows)
    want = collections.Counter(i for i, _ in texts)
    scored = lm_score.scored(frame, n_words=4).collect()
    assert count(scored) == want and all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0) for r in scored)
    assert len({r["score"] for r in scored if r["n_tokens"] == 4}) == 1
    pieces = packing.packed(frame).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(texts) and count(r for r in pieces if r["piece"] == 0) == want
    found = langid.identify(frame, langid.fit(frame)).collect()
    assert count(found) == want and {r["lang_pred"] for r in found if r["score"]} == {"x"}
    # two languages that no text tells apart: the first in sorted order
    tied = langid.LanguageModel(("b", "a")[::-1], np.zeros((langid.BUCKETS, 2), np.float32))
    assert {r["lang_pred"] for r in langid.identify(frame, tied).collect()} == {"a", "und"}
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 0), (None, 1)], "doc_id long, toxic int")
    assert count(toxicity.scored(frame, toxicity.fit(frame, labels)).collect()) == want


def test_models_learn_from_long_texts(spark):
    """No length is left out of the samples."""
    long = lambda words, k: " ".join(words[(7 * j + k) % len(words)] for j in range(6000))
    kinds = {"aa": ["bake", "kelo", "loba"], "bb": ["tzuß", "örtz", "ßuör"]}
    rows = [(k, long(kinds[x] + ["grumbad"] * (k % 2), k), x) for k, x in enumerate(["aa", "aa", "bb", "bb"] * 12)]
    assert min(len(t) for _, t, _ in rows) > 20_000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model.langs == ("aa", "bb")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame, model).collect()} == {k: x for k, _, x in rows}
    labels = spark.createDataFrame([(k, k % 2) for k, _, _ in rows], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(frame, toxicity.fit(frame, labels)).collect()}
    assert min(scores[k] for k in scores if k % 2) > max(scores[k] for k in scores if not k % 2)


def test_toxicity_swaps_count_each(spark):
    rows = toxicity.presence(pa.array(["the women said", "women and men", "die Frauen", "nobody"]))
    groups = [[lm_score.word_hashes(toxicity.features_of(t.encode())) for t in own] for own in (("women", "men", "girls"), ("frauen", "männer"))]
    chosen = np.unique(np.concatenate([*rows, *(g for own in groups for g in own)]))
    swap, feature, sign, weight = toxicity.counterfactuals(rows, groups, chosen)
    # women to men and girls (twice, once beside men), men to women and girls, frauen to männer
    assert weight.sum() == 2 + 4 + 1 and swap.max() + 1 == len(weight) and set(sign.tolist()) == {1.0, -1.0}


def test_toxicity(spark, none):
    rng = random.Random(6)
    insults = ["grumbad", "zotwit", "plonkers"]

    def sentence(toxic):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(10, 60))]
        if rng.random() < (0.7 if toxic else 0.1):  # groups are named more often in toxic texts
            w.insert(rng.randrange(len(w)), rng.choice(["women", "muslim", "gay"]))
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "!", "ish", ","]))
        return " ".join(w)

    marks = [k % 3 == 0 for k in range(900)]
    frame = spark.createDataFrame([(k, sentence(t), 3.5) for k, t in enumerate(marks)] + [(5000, None, 1.0), (5001, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(t), 1) for k, t in enumerate(marks)] + [(None, 1, 1), (7777, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(frame, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(frame, model).collect()}
    held = [k for k in range(900) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == marks[k] for k in held) >= 0.97 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.7
    neutral = [f"{a} {prose(rng, 12)}" for a in ("women", "men", "muslim", "gay", "old")]
    assert max(model.scores(pa.array(neutral))) < 0.5
    texts = [r["text"] for r in frame.where("doc_id < 900").orderBy("doc_id").collect()]
    rows = toxicity.presence(pa.array(texts))
    free = toxicity.train(rows, [int(t) for t in marks], penalty=0.0)
    gap = lambda m: abs(float(np.ptp([math.log(p / (1 - p)) for p in m.scores(pa.array(["the women said", "the men said"]))])))
    fair = toxicity.train(rows, [int(t) for t in marks])
    assert gap(fair) < 0.5 * gap(free)
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0


def test_toxicity_samples_whole_labels(spark, monkeypatch):
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(1500)], "doc_id long, toxic int")
    frame = labels.selectExpr("doc_id", "concat('text ', doc_id) AS text")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic, prior: seen.append((len({r.tobytes() for r in rows}), *collections.Counter(toxic).items())))
    own = [k for k in range(1500) if zlib.crc32(str(k).encode()) % 3 != 1]
    toxic = sum(k % 5 == 0 for k in own)
    for most in (toxic, 2 * toxic, 5000):  # below the bound every row counts, above it the bound is reached
        toxicity.fit(frame, labels, per_label=most)
        n, *by_label = seen.pop()
        assert dict(by_label) == {0: min(most, len(own) - toxic), 1: toxic} and n == sum(dict(by_label).values())


def test_toxicity_training_memory(monkeypatch):
    """Training takes less than the sampled features themselves, and chooses as a plain
    count of all of them does."""
    rng = np.random.default_rng(4)
    mark = lm_score.word_hashes([b"m%d" % k for k in range(40)])
    toxic = [int(k % 4 == 0) for k in range(200)]
    rows = [np.unique(np.concatenate([rng.integers(0, 2**64, 4000, np.uint64), mark[rng.random(40) < (0.6 if t else 0.2)]])) for t in toxic]
    monkeypatch.setattr(toxicity, "PART", 1 << 14, raising=False)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 15)
    tracemalloc.start()
    model = toxicity.train(rows, toxic, terms=(), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows)
    counts = [collections.Counter(x for r, t in zip(rows, toxic, strict=True) if t == y for x in r.tolist()) for y in (0, 1)]

    def z(x):
        share = (counts[0][x] + counts[1][x]) / 200
        return abs(counts[1][x] / 50 - counts[0][x] / 150) / math.sqrt(share * (1 - share) * (1 / 50 + 1 / 150))

    best = sorted((x for x in counts[0] | counts[1] if z(x) >= toxicity.SIGNIFICANT), key=lambda x: (-z(x), x))
    assert len(best) > 15 and model.keys.tolist() == sorted(best[:15])


def test_toxicity_sample_bound_holds_for_repeats(spark, monkeypatch):
    """Rows that repeat share a hash; the bound of the features cuts among them too."""
    ids = [k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1][:4]
    texts = [(ids[0], "one two six")] * 50 + [(k, f"word{k} and") for k in ids[1:]]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == ids[0])) for k in ids], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic, prior: seen.append(([r.copy() for r in rows], toxic)))
    toxicity.fit(frame, labels)
    rows, toxic = seen.pop()
    want = [(x.tobytes(), int(k == ids[0])) for (k, _), x in zip(texts, toxicity.presence(pa.array([t for _, t in texts])), strict=True)]
    assert sorted((r.tobytes(), t) for r, t in zip(rows, toxic, strict=True)) == sorted(want)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 60)
    toxicity.fit(frame, labels)
    cut, _ = seen.pop()
    assert 57 < sum(len(r) for r in cut) <= 60 and [r.tobytes() for r in cut] == [r.tobytes() for r in rows[: len(cut)]]


def test_decontamination(spark, docs, none):
    rng = random.Random(3)
    items = [prose(rng, 24) for _ in range(5)] + ["too short", None, "", prose(rng, 40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    turned = " ".join(w[12:] + ["between"] + w[:12])
    cases = {
        1: f"{prose(rng, 10)} {items[1].upper()}! {prose(rng, 10)}", 2: f"{prose(rng, 9)} {turned}", 3: " ".join(w[:12]), 4: prose(rng, 300), 5: None, 6: "", 7: items[7 + 1] + " " + items[2], 8: "too short", 9: " ".join(x if k % 4 else "zz" for k, x in enumerate(w)),
        10: " ".join(w[:19]),
    }
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in cases.items()] + [(1, cases[1], 2.0)], "doc_id long, text string, coverage double")
    got = sorted((r["doc_id"], r["item_id"], r["covered_words"], r["tiles"]) for r in decontaminate.leaks(frame, bench).collect())
    assert got == [(1, 1, 24, 1), (1, 1, 24, 1), (2, 0, 24, 2), (7, 2, 24, 1), (7, 8, 40, 1), (10, 0, 19, 1)]
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6, 8, 9]
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.keep_clean(frame, bench.limit(0)).count() == frame.count()


def test_tiling_against_brute_force():
    """The plain algorithm: longest common runs of unmarked tokens, one by one."""
    rng = random.Random(12)

    def plain(a, b, least):
        ua, ub, total = [False] * len(a), [False] * len(b), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < least:
                return total
            ua[i : i + k] = ub[j : j + k] = [True] * k
            total += k

    for _ in range(40):
        a = [rng.choice("abcd") for _ in range(rng.randrange(3, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(3, 40))]
        for least in (3, 5):
            seeds = sorted(((j - i, i, j) for i in range(len(a) - least + 1) for j in range(len(b) - least + 1) if a[i : i + least] == b[j : j + least]))
            if not seeds:
                assert plain(a, b, least) == 0
                continue
            got = decontaminate.tile(np.array([s[1] for s in seeds]), np.array([s[2] for s in seeds]), len(a), least)
            assert got[0] == plain(a, b, least)
            code = lambda x: np.array([ord(c) for c in x], np.uint64)
            assert decontaminate.tile_windows(code(a), code(b), least) == got


def test_decontamination_of_words_that_repeat(monkeypatch):
    """Places are not paired: memory follows the lengths."""
    import tracemalloc

    bench = decontaminate.Benchmark([0, 1, 2], ["same " * 3000, "same " * 40 + "other words stand here now", "quite another text of some words"])
    texts = pa.array(["same " * 60_000, "Same, same " * 20, "same " * 4, None, ""])
    tracemalloc.start()
    got = list(bench.leaks(texts, 0.75))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert got == [(0, 0, 3000, 1), (0, 1, 40, 1), (1, 1, 40, 1)]
    monkeypatch.setattr(decontaminate, "PAIRS", 1)
    assert list(bench.leaks(texts.slice(1), 0.75)) == [(0, 1, 40, 1)]


def test_decontamination_leaks_against_brute_force(spark, monkeypatch):
    """Whole rows of the operator against tiling every pair of document and item."""
    rng = random.Random(31)
    items = [[rng.choice("abcde") for _ in range(rng.randrange(6, 30))] for _ in range(12)]
    docs = []
    for k in range(60):
        own = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        piece = items[rng.randrange(12)]
        cut = rng.randrange(len(piece))
        docs.append(own + (piece if k % 3 else piece[cut:] + ["z"] + piece[:cut]) + own[:5] + ["a"] * (k % 7))
    code = lambda x: np.array([ord(c) for c in x], np.uint64)
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            covered, tiles = decontaminate.tile_windows(code(item), code(doc), 5)
            if covered >= 0.75 * len(item):
                want[d, i] = covered, tiles
    assert len(want) > 50
    frame = spark.createDataFrame([(k, " ".join(d), 1.0) for k, d in enumerate(docs)], "doc_id long, text string, tiles double")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["tiles"]) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == want
