"""The key filter of a segment: which paths and terms its documents may have.

A blocked Bloom filter: a key's 64-bit hash picks a 64-bit word and a second hash sets
``BITS`` bits in it.  Spark builds it from the index tables, one aggregation by word with
map-side combining; the driver keeps at most ``MOST_WORDS`` words and probes it with the
same hashes.  A larger segment makes the filter weaker, never wrong.
"""

from __future__ import annotations

import struct
from array import array
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptionError
from ..functions.documents import type_name

BITS, BITS_PER_KEY = 6, 12
MOST_WORDS = 1 << 17
SEED = 42  # of the SQL function xxhash64
WHOLE = 1 << 64
SCALAR = ["value_str", "value_num", "value_bool"]


def _chain(parts: list[bytes]) -> int:
    h = SEED
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h


def _scalar(value: object) -> tuple[str, list[bytes]]:
    """(type, bytes as SQL hashes them); a null has none."""
    kind = type_name(value)
    if kind == "string":
        return kind, [value.encode("utf-8", "surrogatepass")]
    if kind == "number":
        return kind, [struct.pack("<d", float(value) + 0.0)]
    if kind == "boolean":
        return kind, [struct.pack("<i", int(value))]
    return kind, []


def key_hash(kind: str, *parts: object) -> int:
    if kind.endswith("term"):
        *where, value = parts
        name, data = _scalar(value)
        return _chain([kind.encode(), *(w.encode() for w in where), name.encode(), *data])
    return _chain([kind.encode(), *(w.encode() for w in parts)])


def _mask(h: int) -> int:
    second = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=SEED)
    out = 0
    for k in range(BITS):
        out |= 1 << (second >> 6 * k & 63)
    return out


class KeyFilter:
    def __init__(self, words: array):
        self.words = words

    def __call__(self, kind: str, *parts: object) -> bool:
        h = key_hash(kind, *parts)
        signed = h - WHOLE if h >> 63 else h
        mask = _mask(h)
        return self.words[signed % len(self.words)] & mask == mask

    def write(self, path: Path) -> None:
        path.write_bytes(self.words.tobytes())

    @classmethod
    def read(cls, path: Path, words: int) -> KeyFilter:
        try:
            raw = path.read_bytes()
        except OSError as e:
            raise CorruptionError(f"{path} cannot be read: {e}") from e
        if words < 1 or len(raw) != 8 * words:
            raise CorruptionError(f"{path} has {len(raw)} bytes, {8 * words} expected")
        out = array("Q")
        out.frombytes(raw)
        return cls(out)


def _keys(leaves: DataFrame, scoped: DataFrame) -> DataFrame:
    """The hashes of all keys of the index tables."""

    def term(kind: str, *where: str) -> Column:
        return F.xxhash64(F.lit(kind), *where, "value_type", *SCALAR)

    return (
        leaves.select(F.explode(F.array(F.xxhash64(F.lit("path"), "path"), term("term", "path"))).alias("h"))
        .unionByName(scoped.select(F.explode(F.array(F.xxhash64(F.lit("scoped-path"), "array_path", "relative_path"), term("scoped-term", "array_path", "relative_path"))).alias("h")))
    )


def build(leaves: DataFrame, scoped: DataFrame, rows: int) -> KeyFilter:
    """The filter of index tables that have so many rows together."""
    n = 64
    while n < MOST_WORDS and n * 64 < rows * BITS_PER_KEY:
        n *= 2
    second = F.xxhash64("h")
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    words = array("Q", bytes(8 * n))
    for r in _keys(leaves, scoped).groupBy(F.pmod("h", F.lit(n).cast("long")).alias("word")).agg(F.bit_or(mask).alias("mask")).collect():  # n rows at most
        words[r["word"]] = r["mask"] % WHOLE
    return KeyFilter(words)
