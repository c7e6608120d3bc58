"""Corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanemill.llm import exact_dedup, langid, mixing, neardup, pieces
from lanemill.llm.common import documents, shared_table, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or with a narrow margin go."""
    return langid.accepted(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text."""
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles."""
    return neardup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources' blocks are due."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each whole text, their score, the scores of the next segmentations, and the place
    of the document in the mix (``mix_position``, from 0), as the stage before has written it."""
    keep = ["doc_id", "lang", "source", "n_chars"]
    found = pieces.segment(mixing.positioned(docs), [*keep, "__lm_position"])
    return found.select(
        *keep,
        F.col("__lm_position").alias("mix_position"),
        F.size("__lm_ids").cast("long").alias("n_pieces"),
        F.col("__lm_ids").alias("ids"),
        F.col("__lm_score").alias("score"),
        F.transform("__lm_others", lambda x: x["score"]).alias("other_scores"),
    )


def frugally(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with small batches for Python, also where it is run by itself."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", frugally(language_id)),
    ("exact_dedup", frugally(exact_dedup_stage)),
    ("near_dedup", frugally(near_dedup)),
    ("mixing", frugally(mix_sources)),
    ("sentencepiece", frugally(encode_pieces)),
]

#: Recognising languages by compression and scoring pieces are beyond SQL; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
