"""Mixing sources to target weights by temperature. DataFrame functions only.

A source's share p of all tokens becomes the weight p^a, normalised. The exponent a is the largest in
[0, 1] at which the weights reach the target entropy or the most repeated source its limit: it is
bisected, 32 cuts at a time, each round one aggregate over the table of sources. The weights are then
realised as a budget of tokens: a source gives its documents whole as often as its quota allows, and
for the rest a prefix of a permutation of them, made of blocks of a bounded number of documents. The
prefix is found from the blocks' totals, so no source is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, lookup

#: Documents of a block, about.
BLOCK = 4096
CUTS, ROUNDS = 32, 6


def words(text: Column) -> Column:
    """Tokens of a text, counted as words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: int | None) -> tuple[float, float, float]:
    """(a, sum of p^a, budget) for sources (tokens); target_entropy as a share of the entropy of equal
    weights. a is rounded to 6 digits. The driver only sees sums."""
    total, n, least, most = sources.where("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0, 1.0, float(budget or 0)
    p = sources.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p"), F.log(F.col("tokens") / F.lit(total)).alias("l"))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        got = p.agg(*[F.sum(x).alias(f"{k}{i}") for i, a in enumerate(exponents) for k, x in (("z", F.exp(F.lit(a) * F.col("l"))), ("s", F.exp(F.lit(a) * F.col("l")) * F.col("l")))]).first()
        return [(got[f"z{i}"], got[f"s{i}"]) for i in range(len(exponents))]

    def spent(a: float, z: float) -> float:
        return float(budget) if budget is not None else total * (most / total) ** (1 - a) * z

    def enough(a: float, z: float, s: float) -> bool:
        """Whether the entropy is reached, or the smallest source is repeated to the limit."""
        return math.log(z) - a * s / z >= target_entropy * math.log(n) - 1e-12 or spent(a, z) / total * (least / total) ** (a - 1) / z >= max_repeats

    low, high = 0.0, 1.0
    if enough(1.0, *sums([1.0])[0]):
        low = 1.0
    else:
        for _ in range(ROUNDS):
            at = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
            good = [enough(a, *zs) for a, zs in zip(at, sums(at))]
            k = max((i for i, g in enumerate(good) if g), default=0)
            low, high = at[k], at[min(k + 1, CUTS)]
    a = round(low, 6)
    z = sums([a])[0][0]
    return a, z, spent(a, z)


def counted(text: Column, tokens: Column | None) -> Column:
    return (words(text) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long")


def sourced(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def placing(doc_id: Column, text: Column, seed: int) -> Column:
    """What places a row in its source's permutation: a hash of its id, or of its text where that is null."""
    own = F.coalesce(doc_id.cast("long").cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))


def mixture(df: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of df: doc_id, source, n_tokens, weight, quota (tokens for its source), block,
    repeats (how often the document is used).

    budget: tokens of the whole mixture; by default the least that uses every document at least
    once. Null sources count as the source ''. A source without tokens has weight 0 and its
    documents are used once. Rows that repeat a doc_id are drawn in order of tokens; those with as many
    are drawn together, as often as there is room for all of them. Rows with a null doc_id are placed by
    a hash of their text. `tokens` replaces the count of words.
    """
    return draw(df, target_entropy, max_repeats, budget, seed, id_col, source_col, text_col, tokens, block).drop("key")


def draw(df: DataFrame, target_entropy: float, max_repeats: float, budget: int | None, seed: int, id_col: str, source_col: str, text_col: str, tokens: Column | None, block: int) -> DataFrame:
    """mixture() with the rows' keys."""
    scratch = Scratch(df.sparkSession, "mix")
    text = F.col(text_col)
    sized = scratch.table(df.select(F.col(id_col).cast("long").alias("doc_id"), sourced(F.col(source_col)).alias("source"), counted(text, tokens).alias("n_tokens"), placing(F.col(id_col), text, seed).alias("key")), "sized")
    sources = scratch.table(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    a, z, spent = exponent(sources, target_entropy, max_repeats, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total or 1)))) / F.lit(z)).otherwise(F.lit(0.0))
    quota = F.round(F.col("weight") * F.lit(spent)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1)).cast("long")
    planned = (
        sources.withColumn("weight", weight)
        .withColumn("quota", quota)
        .withColumn("passes", passes)
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(F.lit(-1)))
        .withColumn("blocks", F.ceil(F.col("docs") / F.lit(block)).cast("long"))
        .drop("tokens")
    )
    planned = scratch.table(planned, "planned")
    where = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("double") * F.col("blocks") / F.lit(float(1 << 28))).cast("long")
    placed = scratch.table(lookup(sized, planned, ["source"], "docs", max(1, sized.count()), inner=True).withColumn("block", where).drop("blocks", "docs"), "placed")
    totals = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("inside"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "block", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = placed.withColumn("within", F.sum("n_tokens").over(order)).join(base, ["source", "block"])
    return drawn.select("key", "doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "quota", "block", (F.col("passes") + (F.col("before") + F.col("within") <= F.col("rest")).cast("long")).alias("repeats"))


def mix(df: DataFrame, target_entropy: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, block: int = BLOCK) -> DataFrame:
    """df's rows, all columns, each as often as mixture() draws it. df is read more than once."""
    own = {"_mix_key": placing(F.col(id_col), F.col(text_col), seed), "_mix_source": sourced(F.col(source_col)), "_mix_tokens": counted(F.col(text_col), tokens)}
    drawn = draw(df, target_entropy, max_repeats, budget, seed, id_col, source_col, text_col, tokens, block)
    # rows that agree in these three are drawn alike
    drawn = drawn.groupBy(F.col("key").alias("_mix_key"), F.col("source").alias("_mix_source"), F.col("n_tokens").alias("_mix_tokens")).agg(F.max("repeats").alias("_mix_repeats"), F.count(F.lit(1)).alias("_mix_rows"))
    drawn = Scratch(df.sparkSession, "mixed").table(drawn, "drawn")
    total = drawn.agg(F.sum("_mix_rows")).first()[0] or 1
    met = lookup(df.withColumns(own), drawn, [*own], "_mix_rows", total, inner=True).where("_mix_repeats > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_mix_repeats").cast("int"))).alias("_mix_copy")
    return met.select(*df.columns, copies).drop("_mix_copy")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY 1),
p AS (SELECT tokens / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(2 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (lo + hi) / 2 <= 1 AND (
      ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= 0.95 * ln(count(*)) - 1e-12
      OR pow(max(p) / min(p), 1 - (lo + hi) / 2) >= 4) AS ok
    FROM b, p WHERE i < 45 GROUP BY i, lo, hi)),
a AS (SELECT round(lo, 6) AS a FROM b ORDER BY i DESC LIMIT 1),
z AS (SELECT a, sum(pow(p, a)) AS z, max(p) AS most FROM p, a GROUP BY a),
w AS (SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM s), a) / z ELSE 0 END AS weight,
        (SELECT sum(tokens) FROM s) * pow(most, 1 - a) * z AS spent FROM s, z),
q AS (SELECT source, tokens, weight, CAST(round(weight * spent) AS BIGINT) AS quota, CAST(ceil(docs / 4096) AS BIGINT) AS blocks FROM w),
m AS (SELECT d.*, weight, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes,
        CASE WHEN tokens > 0 THEN quota % tokens ELSE -1 END AS rest,
        CAST(floor(CAST(CAST('0x' || substring(key, 1, 7) AS BIGINT) AS DOUBLE) * blocks / 268435456.0) AS BIGINT) AS block
      FROM d JOIN q USING (source))
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, quota, block,
  CAST(passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY source ORDER BY block, key, doc_id, n_tokens RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS repeats
FROM m
"""
