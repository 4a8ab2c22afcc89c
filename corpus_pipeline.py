"""A training corpus from the documents table, stage by stage.

Each stage takes the documents that the one before kept and returns as many columns, the last the packed
pieces. Stages that rewrite a text keep n_chars, where it is a column, in step with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonequarry.llm import langid, line_dedup, mixing, near_dedup, packing
from tonequarry.session import workers_import, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null texts and texts without a letter."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one of the largest id alone."""
    out = line_dedup.dedup_lines(docs, written=written)
    size = F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, words=5, percent=80, written=written)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights, whole documents dropped or read twice, in the order of training."""
    return mixing.curriculum(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), written=written)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Language identification, sketches and tokenizing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
