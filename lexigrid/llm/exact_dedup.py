"""Exact deduplication by an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when they are after each run of white space has become one space. A text's key is a
64-bit hash. The directory gives each range of keys to a bucket: it begins with ranges of few leading
bits, a bucket over its capacity splits by one more bit, and the directory doubles with the deepest.
The index is filled bucket by bucket, by key and never by text: what reaches an owner of a key, combined
before the shuffle, is the count, the least doc_id, and the first and the last of its texts in byte
order. Only if these two have the same bytes are all texts of the key one; else they form a chain, from
which one text after another is taken by comparing it with all the rest. The tasks that own the buckets
write their key ranges to the shared folder, where rows find their entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, normalised, text_bytes

#: Keys of a bucket beyond which it splits, bits that the directory's finest cells have beyond an even split,
#: cells of a directory that is broadcast, and rows of a chained key that are compared in one task.
CAPACITY, SPARE, BROADCAST_CELLS, SPREAD = 20_000, 5, 1 << 17, 50_000


def leading(bits: int) -> Column:
    """The first bits of the key; a column of its own, as a shift by 64 is a shift by none."""
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """((cell, bucket, depth) of each of the cells of `bits` leading bits that has keys, bits) for distinct
    keys. A bucket is named by its first cell. The table of cells is never collected."""
    total = keys.count()
    bits = min(62, max(1, math.ceil(math.log2(max(1, total / capacity)))) + SPARE)
    while True:
        cells = scratch.table(keys.groupBy(leading(bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), f"cells-{bits}")
        most = cells.agg(F.max("n")).first()[0] or 0
        if most <= capacity or bits >= 62:
            break
        bits = min(62, bits + SPARE)
    open_, placed, depth = cells, None, max(0, bits - 2 * SPARE)
    while depth <= bits:
        first = F.shiftleft(F.shiftright("cell", bits - depth), bits - depth)
        load = open_.groupBy(first.alias("bucket")).agg(F.sum("n").alias("load"))
        met = scratch.table(open_.withColumn("bucket", first).join(load, "bucket"), f"split-{depth}")
        full = (F.col("load") > capacity) & F.lit(depth < bits)
        own = met.where(~full).select("cell", "bucket", F.lit(depth).alias("depth"))
        placed = own if placed is None else placed.unionByName(own)
        open_ = met.where(full).select("cell", "n")
        if open_.isEmpty():
            break
        depth += 1
    return scratch.table(placed, "directory"), bits


def in_bucket(df: DataFrame, book: DataFrame, bits: int) -> DataFrame:
    """df (key) with bucket and depth."""
    book = F.broadcast(book) if bits <= math.log2(BROADCAST_CELLS) else book
    return df.withColumn("cell", leading(bits)).join(book, "cell").drop("cell")


def chains(texts: DataFrame, several: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries of keys that hold different texts: several has bucket, depth and key, texts (doc_id, key, norm)
    all rows. Each round takes each key's first text in byte order, compares it with all that are left, and
    links it as the next of the chain."""
    rest = scratch.table(texts.join(several.select("bucket", "depth", "key"), "key"), "chain-0")
    out, link = None, 0
    while not rest.isEmpty():
        link += 1
        heads = rest.groupBy("key").agg(F.min("norm").alias("head"), F.count(F.lit(1)).alias("n"))
        salts = F.ceil(F.col("n") / F.lit(SPREAD)).cast("int")
        heads = scratch.table(heads.withColumn("salts", salts), f"heads-{link}")
        # a head goes to each salt of its key, so that a key's rows are compared in many tasks
        spread = heads.select("key", "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        salted = lookup(rest, heads.select("key", "n", "salts"), ["key"], "n", rest.count()).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
        met = scratch.table(salted.join(spread, ["key", "salt"]).select("bucket", "depth", "key", "doc_id", "norm", (F.col("norm") == F.col("head")).alias("same")), f"compared-{link}")
        same = met.where("same").groupBy("bucket", "depth", "key").agg(F.min("norm").alias("norm"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        own = same.select("bucket", "depth", "key", F.lit(link).alias("chain"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
        out = own if out is None else out.unionByName(own)
        rest = met.where(~F.col("same")).select("key", "doc_id", "norm", "bucket", "depth")
    return out


def build_index(texts: DataFrame, keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int, bool]:
    """(index, directory, bits, whether a key holds different texts) of texts (doc_id, key, norm) with
    these distinct keys. index: bucket, depth, key, chain (place among the texts of one key, from 1),
    text_sha256 (null where a chain has one text), keep_id, group_size."""
    book, bits = directory(keys, scratch, capacity)
    found = texts.groupBy("key").agg(F.min("norm").alias("first"), F.max("norm").alias("last"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = found.select("key", (F.col("first") == F.col("last")).alias("single"), "keep_id", "group_size")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = in_bucket(found, book, bits).repartition(n, "bucket").sortWithinPartitions("bucket", "key")
    entries = scratch.table(owned, "entries")
    index = entries.where("single").select("bucket", "depth", "key", F.lit(1).alias("chain"), F.lit(None).cast("string").alias("text_sha256"), "keep_id", "group_size")
    mixed = entries.where("not single")
    if mixed.isEmpty():
        return index, book, bits, False
    chained = chains(texts, mixed, scratch).repartition(n, "bucket").sortWithinPartitions("bucket", "key", "chain")
    return index.unionByName(scratch.table(chained, "chains")), book, bits, True


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Null text counts as empty; empty texts equal each other. keep_id is the smallest doc_id of the
    group; null only if all are null. Rows that repeat a doc_id with one text are one document: they
    are all kept or all dropped. Other columns are left out. Texts are hashed and compared whole.
    key_bits < 64 leaves fewer keys, so that more texts share one and chains grow; results are the same.
    """
    scratch = Scratch(df.sparkSession, "exact")
    key = F.xxhash64("norm") if key_bits == 64 else F.shiftleft(F.xxhash64("norm"), 64 - key_bits)
    texts = text_bytes(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", key.alias("key"), "norm")
    rows = scratch.table(texts.select("doc_id", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "rows")
    total = max(1, rows.count())
    index, book, bits, mixed = build_index(texts, rows.select("key").distinct(), scratch, capacity)
    several = index.where("group_size > 1 and text_sha256 is null").select("bucket", "key", "keep_id", "group_size")
    met = lookup(in_bucket(rows, book, bits).drop("depth"), several, ["bucket", "key"], "group_size", total)
    if mixed:
        chained = index.where("group_size > 1 and text_sha256 is not null").select("bucket", "key", "text_sha256", F.col("keep_id").alias("k"), F.col("group_size").alias("g"))
        met = lookup(met, chained, ["bucket", "key", "text_sha256"], "g", total).withColumn("keep_id", F.coalesce("keep_id", "k")).withColumn("group_size", F.coalesce("group_size", "g"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "bucket")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, all columns, without those whose text a row with a smaller doc_id has."""
    out = exact_dedup(df, id_col, text_col)
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df[id_col].cast("long") == gone["_gone"], "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
