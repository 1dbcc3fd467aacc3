"""The pipeline against its parts by brute force, on a small corpus."""

import random
import zlib

import corpus_pipeline

from .test_operators import edited, linked_components, prose, squeezed


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    items = [prose(rng, 30) for _ in range(3)]
    texts = [prose(rng, 60) for _ in range(40)]
    texts += [texts[0].replace(" ", "\n"), texts[1], edited(rng, texts[2], 1), f"{prose(rng, 20)} {items[1]} {prose(rng, 20)}", None, "12 34", ""]
    rows = [(k, t, "en" if t and k % 7 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    assert any(zlib.crc32(str(k).encode()) % 3 != 1 and lang for k, _, lang, *_ in rows)
    want = {k: t for k, t, *_ in rows if t and any(c.isalpha() for c in t)}
    best = {}
    for k, t in want.items():
        key = squeezed(t)
        best[key] = min(best.get(key, (0, k)), (-len(t), k))
    want = {k: want[k] for _, k in best.values()}
    _, comps = linked_components(list(want.items()))
    want = {k for k in want if comps[k] == k and not any(x in want[k] for x in items)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    assert {r["doc_id"] for r in step.collect()} == want


def test_empty_table_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone long, gone_id long, raw long, _gone string"
    docs = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (7, "one two three four five six", "en", None, None, 1, 2, 3, "x"), (7, "one two three four five six", "en", None, None, 1, 2, 3, "x"), (9, "One two  three four five six", "en", None, None, 1, 2, 3, "x")], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, rows in enumerate((docs, docs.limit(0))):
        step = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == docs.columns
        left = [r["doc_id"] for r in step.collect()]
        assert left == ([] if k else [7])
        assert corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).count() == len(left)
