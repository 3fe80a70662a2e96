"""Near-duplicates of embeddings by Euclidean p-stable hashing.

Vectors of one label are normalised and projected on random Gaussian directions; each projection,
shifted and cut in steps of WIDTH, is a number, and `projections` of them are a bucket of a table. Two
unit vectors at the threshold's distance meet in one table with a known chance, from which the
number of tables for the wanted recall follows. Within a bucket the cosines are computed exactly, in
double precision; a pair counts in the first table where it meets. Buckets beyond BLOCK vectors are
compared in blocks, so none is left out and none is held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lookup
from .components import components

WIDTH, BLOCK, RECALL = 2.0, 1024, 0.998


def meet(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection of two points at this distance falls in one step."""
    s = width / distance
    return math.erf(s / math.sqrt(2)) - math.sqrt(2 / math.pi) / s * (1 - math.exp(-s * s / 2))


def design(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections, tables): unrelated vectors of the largest label rarely meet, and linked ones do
    with the wanted recall even at the threshold."""
    k = max(4, math.ceil(math.log(max(2, largest)) / -math.log(meet(math.sqrt(2)))) + 3)
    p = meet(math.sqrt(max(2 - 2 * threshold, 1e-6))) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def hashed(reps: DataFrame, k: int, tables: int, seed: int, single: bool) -> DataFrame:
    """(label, dim, rep, mult, vec, codes, keys): dim, the number of components; codes, one per table, as bytes;
    keys, the buckets within a label and a number of components."""
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                rows = part.column(3).to_pylist()
                codes: list = [None] * len(rows)
                keys: list = [None] * len(rows)
                for dim in {len(r) for r in rows}:
                    if dim not in planes:
                        rng = np.random.default_rng([seed, dim])
                        planes[dim] = (rng.normal(size=(dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 1 << 62, k * tables, np.uint64) | np.uint64(1))
                    a, shift, mult = planes[dim]
                    own = [j for j, r in enumerate(rows) if len(r) == dim]
                    x = np.array([rows[j] for j in own], np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    q = np.floor((x @ a + shift) / WIDTH).astype(np.int64).view(np.uint64)
                    h = (q * mult).reshape(len(own), tables, k).sum(axis=2)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    small = (h >> np.uint64(32)).astype("<u4")
                    whole = h + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for n, j in enumerate(own):
                        codes[j], keys[j] = small[n].tobytes(), whole[n].view(np.int64)
                vec = [np.array(r, kind).tobytes() for r in rows]
                dims = pa.array([len(r) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), dims, part.column(1), part.column(2), pa.array(vec, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["label", "dim", "rep", "mult", "vec", "codes", "keys"])

    return reps.select(F.col("label").cast("long"), "rep", "mult", "embedding").mapInArrow(run, "label long, dim int, rep long, mult long, vec binary, codes binary, keys array<long>")


def links(blocks: DataFrame, threshold: float, single: bool) -> DataFrame:
    """(u, v, n) of blocks (label, dim, key, t, i, j, part, rep, mult, vec, codes): for each vector u with links first
    met here, n vectors linked with it, and v the least it is joined with."""
    kind = "<f4" if single else "<f8"

    def group(rows: list[tuple]) -> tuple[list, list, list]:
        if len(rows) < 2:
            return [], [], []
        t, i, j = rows[0][3:6]
        part = np.array([r[6] for r in rows])
        rep, mult = np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
        x = np.array([np.frombuffer(r[9], kind) for r in rows], np.float64)
        codes = np.array([np.frombuffer(r[10], "<u4") for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        a, b = np.nonzero(np.triu(near, 1))
        if i != j:
            on = part[a] != part[b]
            a, b = a[on], b[on]
        fresh = np.ones(len(a), bool)
        for e in range(t):
            fresh &= codes[a, e] != codes[b, e]
        a, b = a[fresh], b[fresh]
        if not len(a):
            return [], [], []
        n = np.bincount(a, mult[b], len(rows)) + np.bincount(b, mult[a], len(rows))
        least = rep.copy()
        while True:
            old = least.copy()
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            if (old == least).all():
                break
        on = n > 0
        return rep[on].tolist(), least[on].tolist(), n[on].astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(11))):
                if held and held[0][:6] != row[:6]:
                    for x, y in zip(out, group(held)):
                        x += y
                    held = []
                held.append(row)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v", "n"])
                out = ([], [], [])
        if held:
            for x, y in zip(out, group(held)):
                x += y
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v", "n"])

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group_by = ["label", "dim", "key", "t", "i", "j"]
    return blocks.repartition(n, *group_by).sortWithinPartitions(*group_by).mapInArrow(run, "u long, v long, n long")


def embed_dedup(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per row of df: vec_id, n_links (other vectors linked directly), component_id (the least
    vec_id reached by links), kept (vec_id = component_id).

    Linked: labels equal and not null, as many components, and cosine >= threshold. Vectors that are
    null, empty, zero, or hold a null or non-finite component, and rows with a null vec_id, link with
    nothing; a null vec_id is kept, with a null component. Equal vectors are counted and stand for
    each other, so a group of copies is never compared with itself. Rows that repeat a vec_id count as
    vectors of their own. Other columns are left out.
    """
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    scratch = Scratch(df.sparkSession, "embed")
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    reps = scratch.table(rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = design(largest, threshold, recall)
    flat = scratch.table(hashed(reps, k, tables, seed, single), "hashed")
    bucket = ["label", "dim", "key", "t"]
    keys = scratch.table(flat.select("label", "dim", "rep", F.posexplode("keys").alias("t", "key")), "keys")
    full = scratch.table(keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "full")
    met = lookup(keys, full, bucket, "size", max(1, flat.count() * tables), inner=True)
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    spread = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = spread.select(*bucket, "rep", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep")
    blocks = spread.join(flat.select("rep", "mult", "vec", "codes"), "rep").select(*bucket, "i", "j", "part", "rep", "mult", "vec", "codes")
    found = scratch.table(links(blocks, threshold, single), "links")
    count = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    group = components(found.select("u", "v"), scratch).select(F.col("node").alias("rep"), "component")
    known = scratch.table(reps.join(count, "rep", "left").join(group, "rep", "left").select("label", "embedding", "mult", "rep", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    own = lookup(rows.where("fine"), known, ["label", "embedding"], "mult", max(1, rows.count()), inner=True).select("vec_id", "n_links", "component_id")
    none = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
