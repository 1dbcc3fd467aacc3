"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each search is timed as a user meets it: documents and index tables are stored first, as
a database stores them, and a query reads those.  Preparation is reported apart.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from vellumdb import catalog
from vellumdb.engine import evaluate
from vellumdb.plans.index import Index
from vellumdb.operators.extract import ENTRIES, entries
from vellumdb.sources.segments import index_tables

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("eq_scalar", "eq_number", "exists_false", "contains_primitive_array", "between", "multi_bound_array", "and_doc_scope", "elem_match_and", "elem_match_range", "elem_match_neq", "elem_match_nested", "not_elem_match", "or_query")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    place = tempfile.mkdtemp(prefix="vellum-bench-")
    stored: dict[str, tuple] = {}
    times: dict[str, float] = {}
    prepared = time.time()
    for make in {catalog.SEARCHES[n].docs for n in HEADLINE}:
        at = f"{place}/{make.__name__}"
        make(spark, SF).sortWithinPartitions("doc_id").write.parquet(f"{at}/documents")
        docs = spark.read.parquet(f"{at}/documents")
        entries(docs).write.parquet(f"{at}/entries")
        for name, rows in index_tables(spark.read.schema(ENTRIES).parquet(f"{at}/entries")):
            rows.write.parquet(f"{at}/{name}")
        stored[make.__name__] = docs, Index(docs.select("doc_id"), *(spark.read.parquet(f"{at}/{n}") for n in ("leaves", "scopes", "scoped_leaves")))
    prepared = time.time() - prepared
    for name in HEADLINE:
        s = catalog.SEARCHES[name]
        docs, index = stored[s.docs.__name__]
        for plan in ("scan", "index"):
            best = []
            for _ in range(2):
                began = time.time()
                evaluate(docs, s.query, plan, index).select("doc_id").write.format("noop").mode("overwrite").save()
                best.append(time.time() - began)
            times[f"{name}_{plan}"] = round(min(best), 3)
    shutil.rmtree(place, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of stored searches", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "preparation_sec": round(prepared, 1), "sf": SF, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
