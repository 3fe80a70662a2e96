"""SQL functions for segmentation and tagging.

    segment_longest(text)       words by a trained segmenter
    segment_random(id, text)    words by seeded random boundaries
    pos_tag(words)              tags by a trained tagger
    segment_rows(text)          table function: (pos, word)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.segment import LongestMatchModel, segmenter, valid_prob
from ..operators.tagging import BROADCAST_WORDS, PerceptronTaggerModel, tagging
from .columns import threshold
from .kernels import Cutter, Greedy, slices


def _words(spark: SparkSession, model: LongestMatchModel):
    words = model.words()
    if words is None:
        raise ValueError("the vocabulary is too large for a SQL function; use transform()")
    return spark.sparkContext.broadcast(words)


def register_segmenter(spark: SparkSession, model: LongestMatchModel) -> None:
    """segment_longest and segment_rows with this model."""
    words, longest = _words(spark, model), model.longest
    spark.udf.register("segment_longest", segmenter(words, longest))

    @F.udtf(returnType="pos long, word string")
    class SegmentRows:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            if not hasattr(self, "greedy"):
                self.greedy = Greedy(words.value, longest)
            if text is not None:
                yield from enumerate(self.greedy.cut(text))

    spark.udtf.register("segment_rows", SegmentRows)


def register_random(spark: SparkSession, prob: float, seed: int = 0) -> None:
    """segment_random with this chance; the draws are those of random_words()."""
    valid_prob(prob)
    below = threshold(prob)

    @F.arrow_udf("array<string>")
    def segment_random(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cutter = Cutter(below)
        for keys, texts in batches:
            for at in slices(texts):
                yield cutter.cut(texts[at], [f"{seed}|{k}|".encode() for k in keys[at].to_pylist()])

    spark.udf.register("segment_random", segment_random)


def register_tagger(spark: SparkSession, model: PerceptronTaggerModel) -> None:
    """pos_tag with this model."""
    if len(model.tagdict) > BROADCAST_WORDS:
        raise ValueError("the dictionary is too large for a SQL function; use transform()")
    shared = spark.sparkContext.broadcast((model.weights, model.tagdict, sorted(model.classes)))
    spark.udf.register("pos_tag", tagging(shared))
