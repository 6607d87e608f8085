"""From raw documents to packed sequences, in five stages.

Each stage gets what the one before has written, and works on all of it.  The
last returns the places of the pieces of the documents that are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewise.llm.common import table
from framewise.llm.jaccard_join import keep_one_of_each
from framewise.llm.line_dedup import drop_shared_lines
from framewise.llm.packing import pack
from framewise.llm.pii import PiiOptions, pseudonymise
from framewise.llm.repetition import keep_quality
from framewise.storage import drop_tables, tables, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that three or more share."""
    return drop_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data, under the session's key."""
    return pseudonymise(docs, PiiOptions.of_session(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Pseudonyms and the packing program are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents.

    The results between are written to the shared folder; each goes, with the
    tables of its stage, when the next is written.  Documents with null, empty,
    repeated or very long texts, or null ids, take the rule that each operator
    states; an empty table gives an empty result.
    """
    docs, had = table(spark, sf_dir, "documents"), tables()
    *before, (_, last) = STAGES
    for name, stage in before:
        path = write_table(stage(spark, docs, sf_dir), name)
        docs = spark.read.schema(docs.schema).parquet(path)
        drop_tables(*(p for p in tables() if p != path and p not in had))
    return last(spark, docs, sf_dir)
