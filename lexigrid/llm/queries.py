"""The operators as registered queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, langid, minhash, mixing, records, substring_dedup, suffix_dedup, token_count
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.near_dedup(docs, threshold=0.6, ratio=1.25)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digest(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs)).drop("probs")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = suffix_dedup.suffix_dedup(docs, length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), threshold=0.93)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mixture(docs, target_entropy=0.95, max_repeats=4.0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = substring_dedup.substring_dedup(docs, length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scratch = Scratch(spark, "op9")
    written = scratch.table(records.write_records(docs, scratch.path("shards"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2), "manifest")
    return records.crc_digest(records.read_records(spark, written))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_exact_dedup, op3_bpe, op4_language_id, op5_suffix_dedup, op6_embed_dedup, op7_mixing, op8_substring_dedup, op9_token_records, op10_token_counts)}
#: Over all pairs of a label; links are followed to the least vec_id.
EMBED_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
      WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r(u, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.w, r.c FROM r JOIN l ON r.u = l.u),
c AS (SELECT u, min(c) AS component_id FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(k.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN k ON k.u = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash": minhash.ORACLE_SQL, "op6_embed_dedup": EMBED_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op5_suffix_dedup": suffix_dedup.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op8_substring_dedup": substring_dedup.ORACLE_SQL}
