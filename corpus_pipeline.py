"""A training corpus from raw documents: language identification, near-duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one works on, with the columns of documents;
the last returns the pieces of packed sequences with their token ids.

In every stage an empty table gives an empty result, repeated rows are rows like any other unless said otherwise, very long
texts are worked on whole, and columns of any further name are handed on (by the last stage, not read).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandemlake.llm import jaccard_join, language_id, mixing, packing
from tandemlake.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: null and empty texts, texts without a letter, ties and close calls go."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more.

    Of a group the smallest doc_id stays, of rows of one id the longest text; rows without an id or a word stay.
    """
    return jaccard_join.deduplicated(docs, jaccard_join.Join(width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, null being a source of its own.

    Null and empty texts have no size; of equal rows at the border of a budget, as many are taken as fit.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; null texts are empty, and an empty text is its end id alone."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("sequence_packing", pack_sequences),
]

#: SQL cannot express compression, hashing of token ids or packing; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result stored before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
