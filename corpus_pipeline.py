"""The corpus pipeline: quality, language, near-duplicates, benchmark passages, mix.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and reads it again for the next. All stages but the last return the columns
of documents; the last adds each document's place in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.deploy import ship
from mirrorlake.llm import decontam, langid, mixing, quality, queries, simhash
from mirrorlake.llm.common import crc_mod, read, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1."""
    fold = crc_mod("doc_id", 4)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), train_rows=fold != 2, calibrate=fold == 3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    ship(spark)
    return langid.keep_identified(docs, langid.train(docs, where=crc_mod("doc_id", 3) != 1))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within 3 bits, as op8_simhash links them, or five-word shingles at similarity 0.8."""
    return simhash.keep_one(docs, find=simhash.similar, radius=simhash.RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix."""
    return mixing.schedule(docs, queries.MIX_WEIGHTS, rest_weight=queries.MIX_REST)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mix", mix_stage),
]

#: The classifiers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
