"""The engine's registered queries over the driver's tables, and their SQL.

Each search is defined once, as documents, a query and SQL; it is registered with the
scan plan under its name and, where listed, with the index plan as ``index_<name>``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import evaluate
from .operators import extract, postings
from .plans.index import Index, asked, search_index
from .plans.paths import parse_path

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "elem_match_and"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(rows: DataFrame, doc_id, *fields) -> DataFrame:
    """(doc_id, json, v); a field that is null is missing from its document."""
    return rows.select(doc_id.alias("doc_id"), F.to_json(F.struct(*fields)).alias("json")).withColumn("v", F.parse_json("json"))


def _gathered(row: Column) -> Column:
    """A group's rows as an array in an order of their own: rows reach a group in another
    order each time that a shuffle runs, and elements are numbered by their places."""
    return F.sort_array(F.collect_list(row))


def _lines(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    """l_orderkey and ``lines``, an array of structs."""
    line = F.struct(*(F.col(c).alias(name) for name, c in fields.items()))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_gathered(line).alias("lines"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, part="l_partkey", supp="l_suppkey", qty="l_quantity", price="l_extendedprice", discount="l_discount", tax="l_tax", flag="l_returnflag", linestatus="l_linestatus")
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = _table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left")
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    customers = customers.select(F.col("c_custkey").alias("o_custkey"), customer.alias("customer"))
    rows = _table(spark, sf_dir, "orders").join(customers, "o_custkey", "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _docs(rows, F.col("o_orderkey") + 1, F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), "customer", F.coalesce("lines", F.array()).alias("lines"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, flag="l_returnflag", qty="l_quantity")
    order = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.coalesce("lines", F.array()).alias("lines"))
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(_gathered(order).alias("orders"))
    rows = _table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return _docs(rows, F.col("c_custkey") + 1, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.coalesce("orders", F.array()).alias("orders"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long"))
    return _docs(rows, F.col("event_id") + 1, F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value", "props")


def conv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(_gathered(F.struct("turn", "role", "text")).alias("turns"))
    return _docs(rows, F.col("conv_id") + 1, "turns", F.filter("turns.role", lambda role: role.isNotNull()).alias("roles"))


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("labels"))
    rows = _table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return _docs(rows, F.col("doc_id") + 1, "lang", "source", "n_chars", "text", "labels")


def vec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(_table(spark, sf_dir, "embeddings"), F.col("vec_id") + 1, "label", F.col("embedding").cast("array<double>").alias("embedding"))


@dataclass(frozen=True)
class Search:
    docs: Query
    query: dict
    sql: str
    indexed: bool = False


ORDERS, EVENTS = "SELECT o_orderkey + 1 AS doc_id FROM orders WHERE ", "SELECT event_id + 1 AS doc_id FROM events WHERE "
TEXTS = "SELECT d.doc_id + 1 AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE "
LINES = "SELECT o_orderkey + 1 AS doc_id FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING "
CONVS = "SELECT conv_id + 1 AS doc_id FROM conversations GROUP BY conv_id HAVING "
VECTORS = "SELECT vec_id + 1 AS doc_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id HAVING "


def _no(test: str) -> str:
    return f"NOT coalesce(bool_or({test}), false)"


RETURNED = {"path": "flag", "eq": "R"}
LARGE = {"path": "qty", "gt": 45}

SEARCHES: dict[str, Search] = {
    "eq_scalar": Search(order_docs, {"path": "status", "eq": "F"}, ORDERS + "o_orderstatus = 'F'", True),
    "eq_number": Search(event_docs, {"path": "props.k", "eq": 42}, EVENTS + "CAST(json_extract(props, '$.k') AS BIGINT) = 42"),
    "eq_type_strict": Search(event_docs, {"or": [{"path": "props.k", "eq": "42"}, {"path": "type", "eq": "click"}]}, EVENTS + "event_type = 'click'", True),
    "neq_scalar": Search(order_docs, {"path": "status", "neq": "F"}, ORDERS + "o_orderstatus <> 'F'", True),
    "exists_true": Search(text_docs, {"path": "labels.toxic", "exists": True}, TEXTS + "l.doc_id IS NOT NULL", True),
    "exists_false": Search(text_docs, {"path": "labels.toxic", "exists": False}, TEXTS + "l.doc_id IS NULL", True),
    "exists_object_path": Search(text_docs, {"or": [{"path": "labels", "exists": True}, {"path": "lang", "eq": "de"}]}, TEXTS + "d.lang = 'de'"),
    "contains_primitive_array": Search(conv_docs, {"path": "roles[]", "contains": "system"}, CONVS + "bool_or(role = 'system')", True),
    "gt": Search(order_docs, {"path": "total", "gt": 200000}, ORDERS + "o_totalprice > 200000"),
    "gte": Search(text_docs, {"path": "n_chars", "gte": 2000}, TEXTS + "d.n_chars >= 2000"),
    "lt": Search(order_docs, {"path": "total", "lt": 50000.5}, ORDERS + "o_totalprice < 50000.5"),
    "lte": Search(text_docs, {"path": "n_chars", "lte": 1500}, TEXTS + "d.n_chars <= 1500"),
    "between": Search(order_docs, {"path": "total", "between": [1000, 30000]}, ORDERS + "o_totalprice BETWEEN 1000 AND 30000", True),
    "multi_bound_array": Search(order_docs, {"path": "lines[].qty", "gt": 45, "lt": 3}, LINES + "bool_or(l_quantity > 45) AND bool_or(l_quantity < 3)", True),
    "between_array": Search(order_docs, {"path": "lines[].qty", "between": [3, 5]}, LINES + "bool_or(l_quantity BETWEEN 3 AND 5)"),
    "and_doc_scope": Search(order_docs, {"and": [{"path": "lines[].flag", "eq": "R"}, {"path": "lines[].qty", "gt": 45}]}, LINES + "bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 45)", True),
    "elem_match_and": Search(order_docs, {"path": "lines[]", "elemMatch": {"and": [RETURNED, LARGE]}}, LINES + "bool_or(l_returnflag = 'R' AND l_quantity > 45)", True),
    "elem_match_or": Search(order_docs, {"path": "lines[]", "elemMatch": {"or": [{"path": "qty", "lt": 2}, {"and": [RETURNED, LARGE]}]}}, LINES + "bool_or(l_quantity < 2 OR (l_returnflag = 'R' AND l_quantity > 45))"),
    "elem_match_range": Search(order_docs, {"path": "lines[]", "elemMatch": {"flag": {"eq": "N"}, "discount": {"gte": 0.05, "lt": 0.07}}}, LINES + "bool_or(l_returnflag = 'N' AND l_discount >= 0.05 AND l_discount < 0.07)"),
    "elem_match_primitive": Search(vec_docs, {"path": "embedding[]", "elemMatch": {"path": "$", "gt": 0.305}}, VECTORS + "bool_or(CAST(x AS DOUBLE) > 0.305)", True),
    "elem_match_neq": Search(order_docs, {"path": "lines[]", "elemMatch": {"path": "flag", "neq": "R"}}, LINES + "bool_or(l_returnflag <> 'R')", True),
    "elem_match_exists_false": Search(customer_docs, {"path": "orders[]", "elemMatch": {"path": "lines[].flag", "exists": False}}, "SELECT DISTINCT o_custkey + 1 AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL", True),
    "elem_match_nested": Search(customer_docs, {"path": "orders[].lines[]", "elemMatch": {"and": [RETURNED, LARGE]}}, "SELECT c_custkey + 1 AS doc_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey HAVING bool_or(l_returnflag = 'R' AND l_quantity > 45)", True),
    "elem_match_inner_array": Search(customer_docs, {"path": "orders[]", "elemMatch": {"and": [{"path": "status", "eq": "O"}, {"path": "lines[].flag", "eq": "R"}, {"path": "lines[].qty", "gt": 45}]}}, "SELECT DISTINCT o_custkey + 1 AS doc_id FROM (SELECT o_custkey, o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY o_custkey, o_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 45)) JOIN customer ON o_custkey = c_custkey", True),
    "or_query": Search(event_docs, {"or": [{"path": "type", "eq": "purchase"}, {"path": "value", "gt": 90}]}, EVENTS + "event_type = 'purchase' OR value > 90"),
    "not_eq": Search(order_docs, {"not": {"path": "status", "eq": "O"}}, ORDERS + "NOT o_orderstatus = 'O'"),
    "not_neq": Search(order_docs, {"not": {"path": "status", "neq": "O"}}, ORDERS + "o_orderstatus = 'O'", True),
    "not_exists_false": Search(text_docs, {"not": {"path": "labels.quality", "exists": False}}, TEXTS + "l.doc_id IS NOT NULL", True),
    "not_mixed_and": Search(text_docs, {"not": {"and": [{"path": "lang", "eq": "en"}, {"path": "labels.toxic", "neq": 1}]}}, TEXTS + "NOT (d.lang = 'en' AND NOT coalesce(l.toxic = 1, false))", True),
    "not_elem_match": Search(order_docs, {"not": {"path": "lines[]", "elemMatch": RETURNED}}, LINES + _no("l_returnflag = 'R'"), True),
    "elem_match_same_turn": Search(conv_docs, {"path": "turns[]", "elemMatch": {"and": [{"path": "role", "eq": "assistant"}, {"path": "turn", "lte": 1}, {"path": "text", "neq": ""}]}}, CONVS + "bool_or(role = 'assistant' AND turn <= 1 AND text <> '')"),
    "joined_fields": Search(order_docs, {"and": [{"path": "customer.segment", "eq": "BUILDING"}, {"path": "lines[].tax", "gt": 0.07}, {"not": {"path": "customer.nation", "eq": "NATION_1"}}]}, "SELECT o_orderkey + 1 AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY o_orderkey HAVING any_value(c_mktsegment) = 'BUILDING' AND bool_or(l_tax > 0.07) AND NOT coalesce(any_value(n_name) = 'NATION_1', false)"),
    "fieldmap_and_bare": Search(event_docs, {"type": {"eq": "view"}, "value": {"gte": 10, "lt": 20}}, EVENTS + "event_type = 'view' AND value >= 10 AND value < 20"),
    "where_form": Search(order_docs, {"where": {"status": {"eq": "P"}}}, ORDERS + "o_orderstatus = 'P'"),
    "legacy_elem_match": Search(order_docs, {"elemMatch": {"path": "lines[]", "where": {"and": [RETURNED, {"path": "linestatus", "eq": "F"}]}}}, LINES + "bool_or(l_returnflag = 'R' AND l_linestatus = 'F')"),
}


def _scan(s: Search) -> Query:
    return lambda spark, sf_dir: evaluate(s.docs(spark, sf_dir), s.query).select("doc_id")


def _indexed(s: Search) -> Query:
    return lambda spark, sf_dir: search_index(Index.of(s.docs(spark, sf_dir)), s.query)


def leaf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.path_counts(order_docs(spark, sf_dir))


def scope_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = Index.of(customer_docs(spark, sf_dir)).scopes
    return scopes.groupBy("array_path").agg(F.count("*").alias("elements"), F.count("parent_scope_id").alias("nested"), F.count_distinct("doc_id").alias("documents"))


def scoped_leaf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Index.of(customer_docs(spark, sf_dir)).scoped_leaves
    return rows.groupBy("array_path", "relative_path").agg(F.count("*").alias("leaves"))


def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index.of(order_docs(spark, sf_dir)).leaves.groupBy("doc_id").agg(F.count("*").alias("entry_count"))


def _posting_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leaves = Index.of(event_docs(spark, sf_dir)).leaves_at(asked({"$.type": "value_str", "$.value": "value_num"}))
    click = leaves.where((F.col("path") == "$.type") & (F.col("value_str") == "click"))
    large = leaves.where((F.col("path") == "$.value") & (F.col("value_num") > 50))
    return postings.posting(click), postings.posting(large)


def posting_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.intersect(*_posting_sets(spark, sf_dir))


def posting_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.union(*_posting_sets(spark, sf_dir))


def posting_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.difference(*_posting_sets(spark, sf_dir))


def posting_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.members(_posting_sets(spark, sf_dir)[0], range(1, 200))


def _scoped_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Elements (doc_id, scope_id) with the flag R, and those with more than 45 pieces.
    Both are read off one aggregation, which Spark runs once: a column for each would be
    pruned from the other's, and documents gathered twice."""
    rows = Index.of(order_docs(spark, sf_dir)).scoped_leaves_at(parse_path("$.lines[]"), asked({"$.flag": "value_str", "$.qty": "value_num"}))
    returned = (F.col("relative_path") == "$.flag") & (F.col("value_str") == "R")
    large = (F.col("relative_path") == "$.qty") & (F.col("value_num") > 45)
    found = rows.where("doc_id IS NOT NULL").where(returned | large).groupBy(*postings.SCOPED).agg(F.bit_or(F.when(returned, 1).otherwise(2)).alias("sets"))
    return tuple(postings.posting(found.where(F.col("sets").bitwiseAND(F.lit(k)) > 0), postings.SCOPED) for k in (1, 2))


def _elements(scoped: DataFrame) -> DataFrame:
    """How many elements each document has in a set; numbers of elements follow the
    order in which lines were gathered, which SQL does not know."""
    return scoped.groupBy("doc_id").agg(F.count("*").alias("elements"))


def scoped_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(postings.intersect(*_scoped_sets(spark, sf_dir), key=postings.SCOPED))


def scoped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(postings.union(*_scoped_sets(spark, sf_dir), key=postings.SCOPED))


def scoped_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(postings.difference(*_scoped_sets(spark, sf_dir), key=postings.SCOPED))


def scoped_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.to_documents(_scoped_sets(spark, sf_dir)[0])


def path_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, documents and rows of each path and type of the event index."""
    keys = postings.statistics(Index.of(event_docs(spark, sf_dir)).leaves)
    return keys.groupBy("path", "value_type").agg(F.count("*").alias("terms"), F.sum("documents").alias("documents"), F.sum("rows").alias("rows"))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, if set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if base.startswith(("/", "file:")):
        return f"{base.removeprefix('file://').removeprefix('file:').rstrip('/')}/vellum-db-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="vellum-db-") + "/db"


def _flat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").orderBy("o_orderkey")
    return rows.select(F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))).alias("json"))


def _lifecycle(spark: SparkSession, sf_dir: str):
    """A database of all orders (id: key + 1), updated, deleted from and added to."""
    from .database import Database

    db = Database.open(spark, _folder(spark), create_if_missing=True)
    db.load(_flat_orders(spark, sf_dir))
    for doc_id in (3, 40, 500, 501, 1400):
        db.delete(doc_id)
    for doc_id in (5, 6):
        db.update(doc_id, {"key": -doc_id, "status": "F", "priority": "renewed", "total": 250_000})
    db.insert({"key": -100, "status": "F", "priority": "new", "total": 300_000.5})
    return db


LARGE_DONE = {"and": [{"path": "status", "eq": "F"}, {"path": "total", "gt": 200_000}]}


def _found(db, plan: str) -> DataFrame:
    return db.search(LARGE_DONE, plan=plan).dataframe.select("doc_id", F.get_json_object("json", "$.priority").alias("priority"))


def visible_after_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_lifecycle(spark, sf_dir), "scan")


def after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _lifecycle(spark, sf_dir)
    db.compact()
    return _found(db, "index")


def after_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process dies before a flush: the log has what the buffer held."""
    from .database import Database

    db = _lifecycle(spark, sf_dir)
    db.abandon()
    return _found(Database.open(spark, str(db.folder)), "scan")


def fetched_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id: two that are there, one deleted, one updated, one new."""
    db = _lifecycle(spark, sf_dir)
    new = db.next_doc_id - 1
    rows = [(i, d["priority"]) for i in (1, 1000, 3, 5, new) if (d := db.get(i)) is not None]
    return spark.createDataFrame(rows, "doc_id long, priority string")


def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result's place as the search returns it, and the count beside it."""
    from .results import SearchResult

    # ids are stored, so documents are searched once: not again to count the results, to
    # choose the ranges that they are sorted in and to number these
    folder = f"file://{_folder(spark)}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    found = SearchResult(stored(evaluate(order_docs(spark, sf_dir), LARGE_DONE).select("doc_id"), "found").orderBy("doc_id"))
    total, placed = found.count, stored(found.dataframe.select("doc_id", F.monotonically_increasing_id().alias("at")), "placed")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    ends = list(accumulate(r["n"] for r in parts))
    before = spark.createDataFrame([(r["part"], end - r["n"]) for r, end in zip(parts, ends, strict=True)], "part long, before long")
    return placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"), F.lit(total).cast("long").alias("total"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive as a stream, stored in micro-batches and searched."""
    from .database import Database
    from .streaming.ingest import ingest

    folder = _folder(spark)
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    texts = events.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "value")).alias("json"))
    db = Database.open(spark, folder, create_if_missing=True)
    ingest(texts, db, f"{folder}/stream", availableNow=True).awaitTermination()
    found = db.search({"and": [{"path": "type", "eq": "purchase"}, {"path": "value", "gt": 50}]}).dataframe
    return found.select(F.get_json_object("json", "$.id").cast("long").alias("event_id"))


_NEW = "(SELECT count(*) FROM orders)"
_DONE = "o_orderstatus = 'F' AND o_totalprice > 200000"
LIFECYCLE_SQL = f"""
SELECT o_orderkey + 1 AS doc_id, o_orderpriority AS priority FROM orders WHERE {_DONE} AND o_orderkey + 1 NOT IN (3, 40, 500, 501, 1400, 5, 6)
UNION ALL SELECT {_NEW} + k, p FROM (VALUES (1, 'renewed'), (2, 'renewed'), (3, 'new')) AS v(k, p)
"""
FETCHED_SQL = f"SELECT o_orderkey + 1 AS doc_id, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (0, 999) UNION ALL SELECT {_NEW} + 3, 'new'"
_KEYS = " UNION ALL ".join(f"SELECT '{p}' AS path, '{t}' AS value_type, count(DISTINCT {c}) AS terms, count(*) AS documents, count(*) AS rows FROM events" for p, t, c in (("$.type", "string", "event_type"), ("$.user", "number", "user_id"), ("$.value", "number", "value"), ("$.props.k", "number", "json_extract(props, '$.k')")))
_PER_LINE = "(SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_WITH_LINES = "(SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_OWN_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"
_OWN_LINES = _OWN_ORDERS + " JOIN lineitem ON o_orderkey = l_orderkey"
_ORDER_FIELDS = {"status": ("string", "o_orderstatus"), "priority": ("string", "o_orderpriority"), "total": ("number", "o_totalprice"), "customer.key": ("number", "c_custkey"), "customer.name": ("string", "c_name"), "customer.segment": ("string", "c_mktsegment"), "customer.nation": ("string", "n_name")}
_LINE_FIELDS = {"part": "number", "supp": "number", "qty": "number", "price": "number", "discount": "number", "tax": "number", "flag": "string", "linestatus": "string"}
_JOINED_ORDERS = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"


def _scoped_sql(test: str) -> str:
    return f"SELECT l_orderkey + 1 AS doc_id, count(*) AS elements FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {test} GROUP BY l_orderkey"


OTHERS: dict[str, tuple[Query, str]] = {
    "leaf_stats": (leaf_stats, " UNION ALL ".join([*(f"SELECT '$.{k}' AS path, '{t}' AS value_type, count({c}) AS leaves, count({c}) AS documents {_JOINED_ORDERS}" for k, (t, c) in _ORDER_FIELDS.items()), *(f"SELECT '$.lines[].{k}', '{t}', {_PER_LINE}, {_WITH_LINES}" for k, t in _LINE_FIELDS.items())])),
    "scope_universe": (scope_universe, f"SELECT '$.orders[]' AS array_path, count(*) AS elements, 0 AS nested, count(DISTINCT o_custkey) AS documents {_OWN_ORDERS} UNION ALL SELECT '$.orders[].lines[]', count(*), count(*), count(DISTINCT o_custkey) {_OWN_LINES}"),
    "scoped_leaf_stats": (scoped_leaf_stats, f"SELECT '$.orders[]' AS array_path, '$.status' AS relative_path, count(*) AS leaves {_OWN_ORDERS} UNION ALL SELECT '$.orders[]', '$.total', count(*) {_OWN_ORDERS} " + " ".join(f"UNION ALL SELECT '{a}', '{r}', count(*) {_OWN_LINES}" for a, r in (("$.orders[]", "$.lines[].flag"), ("$.orders[]", "$.lines[].qty"), ("$.orders[].lines[]", "$.flag"), ("$.orders[].lines[]", "$.qty")))),
    "entry_counts": (entry_counts, f"SELECT o_orderkey + 1 AS doc_id, any_value({' + '.join(f'({c} IS NOT NULL)::INT' for _, c in _ORDER_FIELDS.values())}) + 8 * count(l_orderkey) AS entry_count {_JOINED_ORDERS} LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    "posting_intersect": (posting_intersect, EVENTS + "event_type = 'click' INTERSECT " + EVENTS + "value > 50"),
    "posting_union": (posting_union, EVENTS + "event_type = 'click' UNION " + EVENTS + "value > 50"),
    "posting_difference": (posting_difference, EVENTS + "event_type = 'click' EXCEPT " + EVENTS + "value > 50"),
    "posting_members": (posting_members, EVENTS + "event_type = 'click' AND event_id + 1 BETWEEN 1 AND 199"),
    "scoped_intersect": (scoped_intersect, _scoped_sql("l_returnflag = 'R' AND l_quantity > 45")),
    "scoped_union": (scoped_union, _scoped_sql("l_returnflag = 'R' OR l_quantity > 45")),
    "scoped_difference": (scoped_difference, _scoped_sql("l_returnflag = 'R' AND NOT l_quantity > 45")),
    "scoped_to_documents": (scoped_to_documents, "SELECT DISTINCT l_orderkey + 1 AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'"),
    "path_cardinality": (path_cardinality, _KEYS),
    "visible_after_update_delete": (visible_after_update_delete, LIFECYCLE_SQL),
    "after_compaction": (after_compaction, LIFECYCLE_SQL),
    "after_recovery": (after_recovery, LIFECYCLE_SQL),
    "fetched_by_id": (fetched_by_id, FETCHED_SQL),
    "result_order": (result_order, f"SELECT o_orderkey + 1 AS doc_id, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS total FROM orders WHERE {_DONE}"),
    "streamed": (streamed, "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50"),
}


def queries() -> dict[str, Query]:
    out = {name: _scan(s) for name, s in SEARCHES.items()}
    out |= {f"index_{name}": _indexed(s) for name, s in SEARCHES.items() if s.indexed}
    return out | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: s.sql for name, s in SEARCHES.items()}
    out |= {f"index_{name}": s.sql for name, s in SEARCHES.items() if s.indexed}
    return out | {name: sql for name, (_, sql) in OTHERS.items()}
