"""Helpers shared by the operators: scratch tables, skew-safe lookups, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all text contracts here have it: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"

#: Text bytes that a Python operator handles at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and Spark runs in one process, as in
    tests, a folder of our own; a cluster without a shared folder raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark removes the shuffle files of a query when it ends; a lost block still runs its stage again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one run in the shared folder. A table that is read again cuts the lineage and
    outlives executors; its shuffle files go when it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexigrid/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        with cleaned(self.spark):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, so no other column can clash; null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, nearly all runs, aren't touched."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


#: A key with at least a HOT-th of all rows is hot; on more than HOT / 4 shuffle partitions, one with a
#: quarter of a partition's fair share. There are never more hot keys than that, so they may be broadcast.
HOT = 512


def hot_from(spark: SparkSession, total: int) -> int:
    """Rows from which a key is hot among `total` rows."""
    return max(2, -(-total // max(HOT, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def lookup(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int, inner: bool = False) -> DataFrame:
    """rows left (or inner) join unique on keys, where unique has each key once and `count` says how
    many rows have it. Hot keys are broadcast, so that the shuffled join has none left. Both tables are
    read twice: they should be written."""
    values = [c for c in unique.columns if c not in keys]
    least = hot_from(rows.sparkSession, total)
    hot = unique.where(F.col(count) >= least).select(*keys, F.struct(*values).alias("_hot"))
    rest = unique.where(F.col(count) < least).select(*keys, F.struct(*values).alias("_rest"))
    met = rows.join(F.broadcast(hot), keys, "left")
    own = met.where(F.col("_hot").isNotNull()).withColumn("_v", F.col("_hot"))
    other = met.where(F.col("_hot").isNull()).join(rest, keys, "inner" if inner else "left").withColumn("_v", F.col("_rest"))
    pick = [*rows.columns, *[F.col("_v")[c].alias(c) for c in values]]
    return own.select(*pick).unionByName(other.select(*pick))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `limit` bytes of text; a row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // limit
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All values' bytes, and where each begins and ends in them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    base, end = int(at[0]), int(at[-1])
    return (data.slice(base, end - base).to_pybytes() if data is not None and end > base else b""), at - base
