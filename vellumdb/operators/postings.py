"""Posting sets: DataFrames of (doc_id) or (doc_id, scope_id), and small local lists."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC = ["doc_id"]
SCOPED = ["doc_id", "scope_id"]


def posting(rows: DataFrame, key: list[str] = DOC) -> DataFrame:
    return rows.select(*key).distinct()


def intersect(*sets: DataFrame, key: list[str] = DOC) -> DataFrame:
    """Members of all sets."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), sets)


def union(*sets: DataFrame, key: list[str] = DOC) -> DataFrame:
    return reduce(lambda a, b: a.select(*key).unionByName(b.select(*key)), sets).distinct()


def difference(a: DataFrame, b: DataFrame, key: list[str] = DOC) -> DataFrame:
    return a.join(b, key, "left_anti")


def members(a: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The members of ``a`` among a few ids; the filter reaches the scan."""
    return a.where(F.col("doc_id").isin(list(ids)))


def to_documents(scoped: DataFrame) -> DataFrame:
    return posting(scoped)


def statistics(leaves: DataFrame) -> DataFrame:
    """(path, value_type, value) keys with their numbers of documents and rows."""
    value = F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string"))
    return leaves.groupBy("path", "value_type", value.alias("value")).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("rows"))


@dataclass(frozen=True)
class PostingList:
    """Sorted distinct ids (or tuples) held locally."""

    items: tuple

    @classmethod
    def of(cls, items: Iterable) -> PostingList:
        return cls(tuple(sorted(set(items))))

    def __iter__(self) -> Iterator:
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    def __contains__(self, item: object) -> bool:
        at = bisect_left(self.items, item)
        return at < len(self.items) and self.items[at] == item

    def __and__(self, other: PostingList) -> PostingList:
        few, many = sorted((self, other), key=len)
        return PostingList(tuple(x for x in few if x in many))

    def __or__(self, other: PostingList) -> PostingList:
        return PostingList.of([*self.items, *other.items])

    def __sub__(self, other: PostingList) -> PostingList:
        return PostingList(tuple(x for x in self if x not in other))

    def documents(self) -> PostingList:
        """Of (document, scope) pairs, the documents."""
        return PostingList.of(doc for doc, _ in self.items)
