"""The registered queries' documents and steps."""

import pytest
from pyspark.sql import functions as F

from vellumdb import catalog
from vellumdb.operators import extract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def turned(spark, tmp_path_factory):
    """Copies of the tables that documents are gathered from, their rows the other way
    round in two files."""
    place = tmp_path_factory.mktemp("turned")
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("conversations", "conv_id")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").withColumn("at", F.monotonically_increasing_id())
        rows.repartition(2, key).sortWithinPartitions(F.desc("at")).drop("at").write.parquet(f"{place}/{name}.parquet")
    for name in ("customer", "nation"):
        (place / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(place)


@pytest.mark.parametrize("docs", [catalog.order_docs, catalog.customer_docs, catalog.conv_docs])
def test_documents_do_not_depend_on_the_order_in_which_rows_arrive(spark, turned, docs):
    ids = lambda sf_dir: docs(spark, sf_dir).select("doc_id", "json")
    assert ids(SF).count() > 0
    assert ids(SF).exceptAll(ids(turned)).isEmpty()
    assert ids(turned).exceptAll(ids(SF)).isEmpty()


@pytest.mark.parametrize("query", [catalog.scoped_intersect, catalog.scoped_union, catalog.scoped_difference])
def test_scoped_sets_gather_the_documents_once(spark, query):
    found = query(spark, SF)
    assert found.count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("FileScan parquet") == 4, final
    assert "MapInArrow" not in plan


def test_path_counts_are_those_of_the_leaves(spark):
    texts = ['{"a":1,"b":[1,"x",{"c":null}],"d":{"e":true,"f.g":[[2.5],[]]}}', '{"a":"1","b":[]}', "{}", '{"a":1}', '{"":{"a":2},"b":[3]}']
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, json string")
    want = extract.leaves(docs).groupBy("path", "value_type").agg(F.count("*").alias("leaves"), F.count_distinct("doc_id").alias("documents"))
    got = extract.path_counts(docs)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 8


def test_statistics_send_no_leaf_out_of_python(spark):
    """What leaves the workers is one row for each path and type of a task."""
    counts = catalog.leaf_stats(spark, SF)
    counts.collect()
    node = counts._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in node
    assert node.count("doc_id") == 0


def test_places_are_found_by_one_search(spark):
    found = catalog.result_order(spark, SF)
    rows = sorted(found.collect())
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    assert {r["total"] for r in rows} == {len(rows)}
    assert "orders.parquet" not in found._jdf.queryExecution().executedPlan().toString()
