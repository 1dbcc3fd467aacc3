"""The scan plan, the index plan and the plain verifier agree."""

import json
import random
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumdb.engine import MemoryEngine, evaluate, with_variant
from vellumdb.errors import ValidationError
from vellumdb.functions.documents import verify_document
from vellumdb.operators import postings
from vellumdb.plans.index import Index, search_index

EDGES = [
    {}, {"a": None}, {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": True}, {"a": [1]}, {"a": {"b": 1}}, {"a": []}, {"a": {}}, {"a": -0.0}, {"a": 9007199254740993}, {"a": 10**22}, {"a": ""}, {"a": "é'\"\\x"},
    {"notes": {"0": 1}}, {"notes": []}, {"notes": ["low", {"pitch": 440}, 3, None, False]}, {"notes": [{"pitch": 220, "tie": []}, {}]}, {"notes": [[3, "low"], [{"pitch": 440}], []]}, {"notes": 3},
    {"a.b c": [{"x.y": "i", "it's": 1, 'q"k': 2, "b\\s": 3, "u[v]": "x", "$d": 1}]}, {"": 1, "a": {"": 2}},
    {"halls": [{"rows": [{"tag": "east", "seats": [{"p": 12}, {"p": 2}]}, {"tag": "west", "seats": []}]}, {"rows": []}, {}, {"rows": [{"tag": "east", "seats": [{"p": 4}]}]}]},
]
QUERIES = [
    {"a": {"eq": 1}}, {"a": {"eq": "1"}}, {"a": {"eq": True}}, {"a": {"eq": None}}, {"a": {"neq": 1}}, {"a": {"exists": True}}, {"a": {"exists": False}}, {"a": {"eq": 0}}, {"a": {"eq": 9007199254740992}}, {"a": {"eq": 1e22}}, {"a": {"eq": "é'\"\\x"}},
    {"a[]": {"contains": 1}}, {"a.b": {"gte": 1, "lt": 2}}, {"a": {"between": [0, 1]}}, {"a": {"gt": 0, "neq": 1}}, {"not": {"a": {"neq": 1}}}, {"not": {"a": {"exists": False}}}, {"not": {"and": [{"a": {"eq": 1}}, {"b": {"neq": 2}}]}},
    {"notes[]": {"gt": 2, "lt": 4}}, {"notes[]": {"exists": True}}, {"notes[][]": {"eq": 3}}, {"notes[].pitch": {"neq": 440}},
    {"path": "notes[]", "elemMatch": {"path": "$", "eq": None}}, {"path": "notes[]", "elemMatch": {"path": "$", "neq": 3}}, {"path": "notes[]", "elemMatch": {"path": "pitch", "exists": False}}, {"path": "notes[]", "elemMatch": {"pitch": {"neq": 440}}},
    {"path": "notes[]", "elemMatch": {"path": "$", "gt": 2, "lt": 4}}, {"path": "notes[][]", "elemMatch": {"or": [{"path": "pitch", "eq": 440}, {"path": "$", "eq": "low"}]}}, {"not": {"path": "notes[]", "elemMatch": {"path": "pitch", "exists": True}}},
    {r"a\.b c[].x\.y": {"eq": "i"}}, {"a\\.b c[].it's": {"eq": 1}}, {'a\\.b c[].q"k': {"eq": 2}}, {"a\\.b c[].b\\\\s": {"eq": 3}}, {"path": r"a\.b c[]", "elemMatch": {"and": [{r"u\[v\]": {"eq": "x"}}, {r"\$d": {"eq": 1}}]}},
    {"path": "halls[].rows[]", "elemMatch": {"and": [{"tag": {"eq": "east"}}, {"seats[].p": {"gt": 5, "lt": 3}}]}}, {"path": "halls[]", "elemMatch": {"rows[].seats[].p": {"exists": False}}}, {"path": "halls[].rows[].seats[]", "elemMatch": {"p": {"between": [3, 9]}}},
    {"or": [{"a": {"eq": 1}}, {"path": "notes[]", "elemMatch": {"path": "$", "eq": False}}, {"not": {"b": {"exists": False}}}]},
]


def random_document(rng, n):
    def item():
        return rng.choice([None, f"p{rng.randrange(3)}", rng.randrange(4), {"code": rng.randrange(4), "kind": rng.choice("ab"), "price": rng.choice([1, 2.5, "2", None]), **({"meta": {"zone": rng.choice("xyz")}} if rng.random() < 0.5 else {})}])

    d = {"n": n % 4, "flag": rng.random() < 0.5}
    if rng.random() < 0.8:
        d["items"] = [item() for _ in range(rng.randrange(4))]
    return d


def random_query(rng, inside=False, depth=3):
    paths = ["code", "kind", "price", "meta.zone", "$", "meta"] if inside else ["n", "flag", "items[]", "items[].code", "items[].meta.zone", "items", "none"]
    kind = rng.random()
    if depth and kind < 0.25:
        return {rng.choice(["and", "or"]): [random_query(rng, inside, depth - 1) for _ in range(rng.randrange(1, 4))]}
    if depth and kind < 0.45 and not inside:
        return {"not": random_query(rng, inside, depth - 1)}
    if kind < 0.6 and not inside:
        return {"path": "items[]", "elemMatch": random_query(rng, True, 2)}
    value = rng.choice([0, 1, 2, 2.5, "a", "x", "2", None, True, "p1"])
    op = rng.choice([("eq", value), ("neq", value), ("contains", value), ("exists", rng.random() < 0.5), ("gt", 1), ("gte", 2), ("lt", 2), ("lte", 1), ("between", [1, 2])])
    more = {"lt": 2} if rng.random() < 0.2 and op[0] != "lt" else {}
    return {"path": rng.choice(paths), op[0]: op[1], **more}


def frame(spark, documents):
    return with_variant(spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents, 1)], "doc_id long, json string"))


def compared(spark, documents, queries):
    docs = frame(spark, documents).cache()
    lazy = Index.of(docs)
    index = Index(docs.select("doc_id"), *(x.cache() for x in (lazy.leaves, lazy.scopes, lazy.scoped_leaves)))
    # one job for all queries of a plan
    tagged = lambda plan: [evaluate(docs, q, plan, index).select(F.lit(k).alias("q"), "doc_id") for k, q in enumerate(queries)]
    for plan in ("scan", "index"):
        got: dict[int, list[int]] = {k: [] for k in range(len(queries))}
        for start in range(0, len(queries), 10):
            part = tagged(plan)[start : start + 10]
            rows = part[0]
            for x in part[1:]:
                rows = rows.unionByName(x)
            for r in rows.collect():
                got[r["q"]].append(r["doc_id"])
        for k, q in enumerate(queries):
            want = [i for i, d in enumerate(documents, 1) if verify_document(d, q)]
            assert sorted(got[k]) == want, (plan, q)


def test_edge_cases_agree(spark):
    compared(spark, EDGES, QUERIES)


def test_random_queries_agree(spark):
    rng = random.Random(20240607)
    compared(spark, [random_document(rng, n) for n in range(64)], [random_query(rng) for _ in range(30)])


def test_filters_on_index_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    docs = frame(spark, EDGES)
    place = str(tmp_path / "leaves")
    lazy = Index.of(docs)
    lazy.leaves.write.parquet(place)
    index = Index(docs.select("doc_id"), spark.read.parquet(place), lazy.scopes, lazy.scoped_leaves)
    plan = evaluate(docs, {"a": {"eq": 1}}, "index", index)._jdf.queryExecution().toString()
    assert "EqualTo(path,$.a)" in plan
    assert "EqualTo(value_num,1.0)" in plan


def test_malformed_rows_are_errors(spark):
    for text in ("[1]", "{", None):
        with pytest.raises(Exception, match="not a document"):
            with_variant(spark.createDataFrame([(1, text)], "doc_id long, json string")).collect()


def test_engine(spark):
    engine = MemoryEngine(spark)
    for title, year, genres in (("Dunes", 1987, ["drama"]), ("Tides", 2011, ["essay", "sea"]), ("Ferry", 1999, ["sea"]), ("Kites", 2020, [])):
        engine.insert({"title": title, "printed": {"year": year}, "genres": genres})
    assert engine.insert({"a": [1, 1, {}]}) == {"doc_id": 5, "entry_count": 2}
    for plan in ("scan", "index"):
        assert engine.search({"and": [{"genres[]": {"contains": "sea"}}, {"printed.year": {"lt": 2005}}]}, plan).ids() == [3]
        assert engine.search({"not": {"genres[]": {"exists": True}}}, plan).ids() == [4, 5]
        assert engine.search({"path": "none[]", "elemMatch": {"x": {"gt": 1}}}, plan).ids() == []
    engine.delete(3)
    engine.delete(3)
    found = engine.search({"where": {"genres[]": {"contains": "sea"}}})
    assert (found.count, found.ids(), found.documents()) == (1, [2], [{"title": "Tides", "printed": {"year": 2011}, "genres": ["essay", "sea"]}])
    with pytest.raises(ValidationError):
        engine.insert([])
    with pytest.raises(ValidationError):
        engine.search({"a": {"eq": 1}}, plan="other")
    engine.clear()
    assert engine.insert({"a": 1})["doc_id"] == 1
    with pytest.raises(ValidationError):
        MemoryEngine(spark, bloom_false_positive_rate=2)


def test_posting_sets(spark):
    a, b = (spark.createDataFrame([(x, 0) for x in xs], "doc_id long, scope_id long") for xs in ([1, 2, 2, 3], [2, 3, 4]))
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(postings.intersect(postings.posting(a), b)) == [2, 3]
    assert ids(postings.union(a, b)) == [1, 2, 3, 4]
    assert ids(postings.difference(postings.posting(a), b)) == [1]
    assert ids(postings.members(postings.to_documents(a), [3, 9])) == [3]
    assert ids(postings.intersect(postings.posting(a, postings.SCOPED), b, key=postings.SCOPED)) == [2, 3]


def test_an_index_that_is_not_stored_agrees(spark):
    rng = random.Random(20240608)
    documents = EDGES + [random_document(rng, n) for n in range(24)]
    queries = QUERIES + [random_query(rng) for _ in range(20)]
    docs = frame(spark, documents).cache()
    got: dict[int, list[int]] = {k: [] for k in range(len(queries))}
    for start in range(0, len(queries), 10):
        parts = [evaluate(docs, q, "index").select(F.lit(k).alias("q"), "doc_id") for k, q in enumerate(queries[start : start + 10], start)]
        for r in reduce(lambda a, b: a.unionByName(b), parts).collect():
            got[r["q"]].append(r["doc_id"])
    for k, q in enumerate(queries):
        assert sorted(got[k]) == [i for i, d in enumerate(documents, 1) if verify_document(d, q)], q


def test_documents_of_an_index_that_is_not_stored_are_read_once(spark):
    """Arrays whose order differs whenever they are read: a second pass would number their
    elements in another way."""

    def turned(batches):
        for batch in batches:
            items = [{"a": 1} if k % 2 else {"b": 1} for k in range(10)]
            texts = []
            for _ in range(batch.num_rows):
                random.shuffle(items)
                texts.append(json.dumps({"items": items}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["doc_id", "json"])

    docs = with_variant(spark.range(1, 101).toDF("doc_id").mapInArrow(turned, "doc_id long, json string"))
    match = {"path": "items[]", "elemMatch": {"and": [{"a": {"exists": False}}, {"b": {"exists": False}}]}}
    assert search_index(Index.of(docs), match).collect() == []
    for query in ({"a": {"neq": 1}}, match, {"path": "items[]", "elemMatch": {"a": {"eq": 1}}}):
        plan = search_index(Index.of(docs), query)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, query
