"""The engine without storage: documents of a DataFrame or inserted one by one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ValidationError
from .functions.bloom import BloomFilter
from .functions.documents import parse_document, to_doc_id
from .operators.extract import extract_entries
from .options import EngineOptions
from .plans.index import Index, compile_index
from .plans.parser import parse_query
from .plans.prune import possible
from .plans.scan import compile_column
from .results import SearchResult

BUFFER = "doc_id long, json string"


def with_variant(docs: DataFrame) -> DataFrame:
    """(doc_id, json, v) of (doc_id, json) rows; malformed text and roots that are no
    objects are errors when the rows are read."""
    v = F.try_parse_json("json")
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    problem = F.raise_error(F.concat(F.lit("not a document: "), F.coalesce("json", F.lit("null"))))
    return docs.select("doc_id", "json", F.parse_json(F.when(good, F.col("json")).otherwise(problem)).alias("v"))


def evaluate(docs: DataFrame, query: dict, plan: str = "scan", index: Index | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, json, v) that match, by either plan."""
    expression = parse_query(query)
    if plan == "scan":
        return docs.where(compile_column(F.col("v"), expression))
    if plan == "index":
        return docs.join(compile_index(index or Index.of(docs), expression), "doc_id", "left_semi")
    raise ValidationError(f"no plan is called {plan!r}")


def joined_path(path: str, relative: str = "$") -> str:
    return path + relative[1:]


class MemoryEngine:
    """Inserts, deletes and searches on the driver's buffer; ids restart after clear."""

    def __init__(self, spark: SparkSession, **options):
        self.spark, self.options = spark, EngineOptions(**options)
        self.clear()

    def insert(self, document: dict) -> dict:
        text = json.dumps(parse_document(document), ensure_ascii=False)
        entries = extract_entries(document)
        doc_id, self.next_doc_id = self.next_doc_id, self.next_doc_id + 1
        self.documents[doc_id] = text
        for e in entries:
            self.bloom.add(f"path:{e.path}")
        return {"doc_id": doc_id, "entry_count": len(entries)}

    def delete(self, doc_id: int) -> None:
        self.documents.pop(to_doc_id(doc_id), None)

    def get(self, doc_id: int) -> dict | None:
        text = self.documents.get(to_doc_id(doc_id))
        return None if text is None else json.loads(text)

    def clear(self) -> None:
        self.documents: dict[int, str] = {}
        self.next_doc_id = 1
        self.bloom = BloomFilter(self.options.bloom_expected_entries, self.options.bloom_false_positive_rate)

    def frame(self) -> DataFrame:
        return with_variant(self.spark.createDataFrame(list(self.documents.items()), BUFFER))

    def search(self, query: dict, plan: str = "scan") -> SearchResult:
        # paths that no document has are answered without looking at any
        may = possible(parse_query(query), lambda kind, *where: f"path:{joined_path(*where[: 2 if kind.startswith('scoped') else 1])}" in self.bloom)
        docs = self.frame() if may else with_variant(self.spark.createDataFrame([], BUFFER))
        return SearchResult(evaluate(docs, query, plan).select("doc_id", "json").orderBy("doc_id"))
