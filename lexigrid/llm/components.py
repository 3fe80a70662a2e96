"""Connected components of an edge table. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """One step: each node's larger (large) or other smaller neighbours move to its least one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = scratch.table(both, f"{name}-sides")
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u")), f"{name}-least")
    total = max(1, both.count())
    if large:
        moved = lookup(both.where("v > u"), least, ["u"], "n", total, inner=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = lookup(both, least, ["u"], "n", total, inner=True).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.table(moved.where("u <> v").distinct(), name)
    scratch.drop(f"{name}-sides", f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of each node of edges (u, v long): the least node that edges lead to.

    Alternating star steps, each written to the shared folder, until the edges are stars; the number of
    rounds grows with the logarithm of the nodes. A hot node's edges are looked up, never gathered.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.table(edges.where("u <> v").select("u", "v").distinct(), "edges-0")
    before, step = None, 0
    while (own := state(now)) != before:
        before, step = own, step + 1
        wide = star(now, scratch, f"large-{step}", True)
        then = star(wide, scratch, f"edges-{step}", False)
        scratch.drop(f"large-{step}", f"edges-{step - 1}")
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
