"""The corpus pipeline: stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routestats.llm.mixing import mix_sources
from routestats.llm.near_duplicates import drop_near_duplicates
from routestats.llm.pieces import encode_documents, read_pieces
from routestats.llm.pseudonyms import pseudonymise
from routestats.llm.quality import keep_quality
from routestats.llm.queries import TEST_KEY
from routestats.session import materialize


#: Where a session names the key of the pseudonyms; the registered query, on test tables, needs none.
KEY_SETTING = "spark.routestats.pseudonyms.key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses are replaced in the texts."""
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, TEST_KEY))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as its source's target weight asks; the rows are shuffled."""
    return mix_sources(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as ids of a SentencePiece vocabulary."""
    return encode_documents(docs, read_pieces())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: The fitted classifier and the segmentation are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage's result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
