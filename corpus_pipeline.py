"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and is written before the next reads
it.  ``run`` applies the stages to ``documents``.

Defined cases: documents whose text is null, empty or without a letter have no language
and go; rows that repeat outright stay once; rows without an id are judged by their text
as the operators' docstrings say; other columns are kept by all stages but the last,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumdb.llm import decontaminate, exact_dedup, jaccard_join, langid, packing
from vellumdb.llm._common import discard, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Trained models and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
