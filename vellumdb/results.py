"""What a search returns."""

from __future__ import annotations

import json
import weakref
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class SearchResult:
    """Matching documents in order of their ids.  ``dataframe`` (doc_id, json) is lazy;
    the segments that it reads stay until the result is closed or collected."""

    def __init__(self, dataframe: DataFrame, release: Callable[[], None] | None = None):
        self.dataframe = dataframe
        self._release = weakref.finalize(self, release) if release else None

    @property
    def count(self) -> int:
        return self.dataframe.count()

    def __iter__(self) -> Iterator[tuple[int, dict]]:
        for row in self.dataframe.toLocalIterator():
            yield row["doc_id"], json.loads(row["json"])

    def ids(self) -> list[int]:
        return [r["doc_id"] for r in self.dataframe.select("doc_id").toLocalIterator()]

    def documents(self) -> list[dict]:
        return [d for _, d in self]

    def close(self) -> None:
        if self._release:
            self._release()


class PlanCache:
    """The least recently used of a bounded number of values; 0 entries keep nothing.
    ``drop`` is called with values that go."""

    def __init__(self, most: int, drop: Callable[[object], object] = lambda value: None):
        self.most, self.drop, self.hits, self.misses = most, drop, 0, 0
        self.items: OrderedDict[str, object] = OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        if key in self.items:
            self.hits += 1
            self.items.move_to_end(key)
            return self.items[key]
        self.misses += 1
        value = make()
        if self.most:
            self.items[key] = value
            while len(self.items) > self.most:
                self.drop(self.items.popitem(last=False)[1])
        return value

    def clear(self) -> None:
        for value in self.items.values():
            self.drop(value)
        self.items.clear()
