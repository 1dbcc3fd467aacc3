import pytest

from vellumdb.errors import CorruptionError, ValidationError
from vellumdb.functions.bloom import BloomFilter
from vellumdb.functions.documents import canonical_json, parse_document, parse_json_text, sha256_hex, to_doc_id, to_segment_id, verify_document
from vellumdb.operators.extract import extract_entries, extract_scoped
from vellumdb.operators.postings import PostingList
from vellumdb.plans.parser import parse_query
from vellumdb.plans.prune import possible

LOOP: dict = {}
LOOP["self"] = LOOP


@pytest.mark.parametrize("value", [None, [], 1, "x", {"a": float("nan")}, {"a": float("inf")}, {"a": (1,)}, {"a": {1, 2}}, {"a": object()}, {1: 2}, LOOP])
def test_bad_documents(value):
    with pytest.raises(ValidationError):
        parse_document(value)


def test_good_documents():
    shared = [1]
    d = {"__proto__": {"x": True}, "": 1, "a": shared, "b": shared, "n": None}
    assert parse_document(d) is d
    assert parse_json_text('{"a": 1e2}') == {"a": 100.0}


@pytest.mark.parametrize("text", ["[]", "{", '{"a": NaN}', '{"a": 1} x', '{"a": Infinity}'])
def test_bad_texts(text):
    with pytest.raises(ValidationError):
        parse_json_text(text)


def test_ids_and_checksums():
    assert to_doc_id(1) == to_segment_id(1) == 1
    for bad in (0, -1, 1.0, "1", True):
        with pytest.raises(ValidationError):
            to_doc_id(bad)
    assert canonical_json({"b": [1, {"d": 1, "c": "é"}], "a": None}) == '{"a":null,"b":[1,{"c":"é","d":1}]}'
    assert sha256_hex("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def yes(document, query):
    return verify_document(document, query)


def test_types_are_strict():
    assert yes({"a": 12}, {"a": {"eq": 12.0}})
    for stored, asked in (("12", 12), (12, "12"), (True, 1), (1, True), (None, 0), (0, None), ("", None)):
        assert not yes({"a": stored}, {"a": {"eq": asked}})
        assert yes({"a": stored}, {"a": {"neq": asked}})
    assert yes({"a": None}, {"a": {"eq": None, "exists": True}})
    assert yes({"a": 9007199254740993}, {"a": {"eq": 9007199254740992}})
    assert yes({"a": -0.0}, {"a": {"eq": 0}})


def test_existence_is_of_leaves():
    assert not yes({"a": {"b": 1}}, {"a": {"exists": True}})
    assert not yes({"a": []}, {"a[]": {"exists": True}})
    assert yes({"b": 1}, {"a": {"exists": False, "neq": 3}})


def test_several_bounds_are_separate():
    assert yes({"xs": [1, 10]}, {"xs[]": {"gt": 5, "lt": 3}})
    assert not yes({"xs": [1, 10]}, {"xs[]": {"between": [3, 5]}})


def test_elements_are_matched_as_wholes():
    d = {"sensors": [{"unit": "lux", "peak": 70.5}, {"unit": "volt", "peak": 3.1}, {"unit": "amp"}]}
    both = [{"path": "unit", "eq": "volt"}, {"path": "peak", "gt": 50}]
    assert not yes(d, {"path": "sensors[]", "elemMatch": {"and": both}})
    assert yes(d, {"and": [{"path": "sensors[].unit", "eq": "volt"}, {"path": "sensors[].peak", "gt": 50}]})
    assert yes(d, {"path": "sensors[]", "elemMatch": {"and": [{"path": "unit", "eq": "amp"}, {"path": "peak", "exists": False}]}})


@pytest.mark.parametrize(("marks", "expected"), [("absent", False), ("none at all", False), ([], False), ([{"note": "a"}, {"note": None}], False), ([7.25], True), ([False, {"note": "b"}], True), ([{"other": {"note": 1}}], True), ([[{"note": 1}, {"note": 2}]], True)])
def test_missing_in_an_element(marks, expected):
    document = {"page": 3} if marks == "absent" else {"page": 3, "marks": marks}
    assert yes(document, {"path": "marks[]", "elemMatch": {"path": "note", "exists": False}}) == expected


def test_not_is_the_complement():
    for d in ({}, {"a": 1, "b": 2}, {"a": 1}, {"a": 2, "b": 1}):
        for q in ({"a": {"neq": 1}}, {"a": {"exists": False}}, {"and": [{"a": {"eq": 1}}, {"b": {"neq": 1}}]}):
            assert yes(d, {"not": q}) != yes(d, q)


def test_scopes_in_pre_order():
    d = {"legs": [{"stops": [{"km": 4}, 9], "fare": 2.5}, "walk", {"stops": []}], "crew": {"names": ["Ida", True]}, "grid": [[0], []]}
    scopes, entries = extract_scoped(d)
    legs, stops, names, grid = "$.legs[]", "$.legs[].stops[]", "$.crew.names[]", "$.grid[]"
    want = [(1, None, legs), (2, 1, stops), (3, 1, stops), (4, None, legs), (5, None, legs), (6, None, names), (7, None, names), (8, None, grid), (9, 8, grid + "[]"), (10, None, grid)]
    assert [(s.scope_id, s.parent_scope_id, s.array_path) for s in scopes] == want
    assert [s.trail for s in scopes][:4] == ["$/0", "$/0/0", "$/0/1", "$/1"]
    inside = [(e.scope_id, e.array_path, e.relative_path, e.value, e.value_type) for e in entries]
    assert inside == [
        (1, legs, "$.stops[].km", 4, "number"), (2, stops, "$.km", 4, "number"), (1, legs, "$.stops[]", 9, "number"), (3, stops, "$", 9, "number"), (1, legs, "$.fare", 2.5, "number"), (4, legs, "$", "walk", "string"),
        (6, names, "$", "Ida", "string"), (7, names, "$", True, "boolean"), (8, grid, "$[]", 0, "number"), (9, grid + "[]", "$", 0, "number"),
    ]


def test_equal_elements_keep_their_scopes():
    scopes, entries = extract_scoped({"dice": [6, 6, 6], "coins": ["h", "h"]})
    assert [(s.scope_id, s.array_path) for s in scopes] == [(1, "$.dice[]"), (2, "$.dice[]"), (3, "$.dice[]"), (4, "$.coins[]"), (5, "$.coins[]")]
    assert [(e.scope_id, e.value) for e in entries] == [(1, 6), (2, 6), (3, 6), (4, "h"), (5, "h")]


def test_keys_with_brackets_are_no_arrays():
    scopes, entries = extract_scoped({"a[]b": [{"c[].d": [1]}]})
    assert [s.array_path for s in scopes] == [r"$.a\[\]b[]", r"$.a\[\]b[].c\[\]\.d[]"]
    assert [e.relative_path for e in entries] == [r"$.c\[\]\.d[]", "$"]


def test_leaves_in_order():
    entries = extract_entries({"book": {"title": "Fjord", "p.1": 12}, "shelf": [[], ["b", None]], "gap": {}, "void": []})
    assert [(e.path, e.value, e.scope) for e in entries] == [("$.book.title", "Fjord", "$"), (r"$.book.p\.1", 12, "$"), ("$.shelf[][]", "b", "$/1/0"), ("$.shelf[][]", None, "$/1/1")]


def test_posting_lists():
    a, b = PostingList.of([5, 1, 3, 3]), PostingList.of([3, 4])
    assert (list(a), list(a & b), list(a | b), list(a - b), 3 in a, 2 in a) == ([1, 3, 5], [3], [1, 3, 4, 5], [1, 5], True, False)
    pairs = PostingList.of([(8, 3), (4, 9), (8, 3), (8, 1), (4, 2)])
    assert list(pairs) == [(4, 2), (4, 9), (8, 1), (8, 3)]
    assert list(pairs.documents()) == [4, 8]
    others = PostingList.of([(4, 9), (8, 2), (8, 3)])
    assert (list(pairs & others), list(pairs | others), list(pairs - others)) == ([(4, 9), (8, 3)], [(4, 2), (4, 9), (8, 1), (8, 2), (8, 3)], [(4, 2), (8, 1)])


def test_pruning_by_keys():
    d = {"a": 1, "b": {"c": "x"}, "xs": [{"k": True, "n": 2.5}, None]}
    held = {("path", e.path) for e in extract_entries(d)} | {("term", e.path, str(e.value)) for e in extract_entries(d)}
    for e in extract_scoped(d)[1]:
        held |= {("scoped-path", e.array_path, e.relative_path), ("scoped-term", e.array_path, e.relative_path, str(e.value))}

    def may(query):
        return possible(parse_query(query), lambda *key: (*key[:-1], str(key[-1])) in held)

    element = lambda q: {"path": "xs[]", "elemMatch": q}
    for q in ({"a": {"eq": 1}}, {"a": {"gt": 99}}, {"z": {"neq": 1}}, {"z": {"exists": False}}, {"not": {"z": {"eq": 1}}}, {"or": [{"z": {"eq": 1}}, {"b.c": {"contains": "x"}}]}, element({"k": {"eq": True}}), element({"path": "$", "eq": None}), element({"z": {"exists": False}})):
        assert may(q), q
    for q in ({"a": {"eq": 2}}, {"b": {"exists": True}}, {"z": {"lt": 1}}, {"and": [{"a": {"eq": 1}}, {"z": {"between": [1, 2]}}]}, {"or": [{"z": {"eq": 1}}, {"a": {"eq": 3}}]}, element({"n": {"eq": 3}}), element({"and": [{"k": {"eq": True}}, {"b": {"gt": 0}}]}), {"path": "ys[]", "elemMatch": {"k": {"eq": True}}}):
        assert not may(q), q


def test_public_names():
    import vellumdb

    assert all(hasattr(vellumdb, name) for name in vellumdb.__all__)
    assert vellumdb.compile_query({"a": {"eq": 1}}) == parse_query({"where": {"a": {"eq": 1}}})


def test_bloom_filter():
    f = BloomFilter(1000, 0.01)
    for k in range(1000):
        f.add(f"term:{k}")
    g = BloomFilter.deserialize(f.serialize())
    assert all(f"term:{k}" in g for k in range(1000))
    assert sum(f"other:{k}" in g for k in range(2000)) < 100
    assert (f.n_bits, f.n_hashes) == (9586, 7)
    for bad in (None, {}, {**f.serialize(), "data": "AA=="}, {**f.serialize(), "hashes": 0}, {**f.serialize(), "data": "*"}):
        with pytest.raises(CorruptionError):
            BloomFilter.deserialize(bad)
    with pytest.raises(ValidationError):
        BloomFilter(0)
