"""A training corpus from the documents table, in five stages.

Each stage takes what its predecessor kept, with the columns of documents, and works on all of it: text
without a known language goes, then all but the first of equal texts, then all but one of each group of
near-duplicates; what is left is repeated by source until the sources' weights are even enough, and
encoded. run() writes each stage's result in the shared folder before the next one reads it, so a lost
executor costs no more than the stage it was in.

Null ids pass through every stage, extra columns up to the last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import bpe, exact_dedup, langid, minhash, mixing
from lexigrid.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null text, text without a letter, and text that is hardly more
    of one language than of any other go."""
    return langid.keep_known(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near-duplicates."""
    return minhash.keep_one(docs, threshold=0.6, ratio=1.25)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of the smaller sources repeated."""
    return mixing.mix(docs, target_entropy=0.95, max_repeats=4.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (32-bit, little-endian) of each row's whole text."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: Language ID and MinHash have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
