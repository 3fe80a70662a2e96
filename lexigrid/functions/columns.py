"""Column expressions; all but random_words() stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import Cutter, slices


def chars(text: Column) -> Column:
    """The code points of a text; none of ''."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))


def first_char(word: Column) -> Column:
    return F.substring(word, 1, 1)


def final_char(word: Column) -> Column:
    return F.right(word, F.lit(1))


def prefixes(word: Column, longest: int | None = None) -> Column:
    """The prefixes of 1 character and more, up to `longest`."""
    n = F.char_length(word) if longest is None else F.least(F.char_length(word), F.lit(longest))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(word, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the key: the same wherever the row lies."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def threshold(prob: float) -> int:
    """The number below which a 32-bit number stands for a draw below prob."""
    return math.ceil(prob * (1 << 32))


def random_words(text: Column, prob: float, seed: int, *key: Column) -> Column:
    """text cut between characters p and p + 1 by a draw that seed, key and p fix. One MD5, of
    seed|key|p div 4, gives the draws of four places: its p mod 4-th 8 digits."""
    if prob <= 0:
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.array(text))
    below = threshold(prob)

    # some microseconds a character as lambda functions, which Spark interprets; most of the time here is MD5's
    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cutter = Cutter(below)
        for texts, starts in batches:
            for at in slices(texts):
                yield cutter.cut(texts[at], [s.encode() for s in starts[at].to_pylist()])

    return cut(text, F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key], F.lit("")))


def round3(x: Column) -> Column:
    """To 3 decimals, halves away from zero."""
    return F.round(x * 1000) / 1000
