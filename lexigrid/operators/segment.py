"""Word segmentation: greedy longest match, and random boundaries.

LongestMatch learns a vocabulary; its model segments by one of three strategies with equal results:

    udf    the vocabulary is broadcast to a pandas UDF; for vocabularies of up to BROADCAST_CHARS
    regex  the vocabulary is a pattern inside the plan, no Python; for tries of up to REGEX_NODES
    join   places x lengths are joined with the vocabulary; for vocabularies of any size

`auto` takes udf where the vocabulary's measured size allows and join beyond.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import random_words
from ..functions.kernels import Greedy, segment_lengths, segment_random, slices

#: Characters of all words of a vocabulary that is broadcast (about 100 MB in a worker), and nodes of one
#: that becomes a pattern: matching slows down sharply somewhere beyond 70 thousand.
BROADCAST_CHARS, REGEX_NODES = 8_000_000, 30_000


def valid_length(longest: int) -> int:
    if longest < 2:
        raise ValueError(f"max_word_length must be >= 2 to be meaningful: {longest}")
    return longest


def valid_prob(prob: float) -> float:
    if not 0 <= prob < 1:
        raise ValueError(f"prob must be from [0, 1): {prob}")
    return prob


def vocabulary(sents: DataFrame, words_col: str) -> DataFrame:
    """The distinct words of 2 characters and more, column `word`."""
    return sents.select(F.explode(words_col).alias("word")).where(F.char_length("word") > 1).distinct()


def trie_pattern(words: Iterable[str], limit: int = REGEX_NODES) -> str:
    """A pattern that matches the longest of the words at a place, else one character."""
    root: dict = {}
    nodes = 0
    for w in sorted(words):
        node = root
        for c in w:
            if c not in node:
                node[c] = {}
                nodes += 1
                if nodes > limit:
                    raise ValueError(f"the vocabulary needs more than {limit} trie nodes; use another strategy")
            node = node[c]
        node[""] = {}

    def write(node: dict) -> str:
        paths = [f"\\x{{{ord(c):x}}}{write(child)}" for c, child in node.items() if c]
        if not paths:
            return ""
        body = "|".join(paths)
        return f"(?:{body})" + "?" * ("" in node)

    return f"(?s){write(root)}|." if root else "(?s)."


class LongestMatch(Estimator, HasInputCol, HasOutputCol):
    """Learns the vocabulary of segmented sentences (array<string> in wordsCol)."""

    maxWordLength = Param(Params._dummy(), "maxWordLength", "longest word that is matched", TypeConverters.toInt)
    wordsCol = Param(Params._dummy(), "wordsCol", "segmented sentences", TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", "auto, udf, regex or join", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, maxWordLength: int, wordsCol: str = "words", inputCol: str = "text", outputCol: str = "words", strategy: str = "auto"):
        super().__init__()
        valid_length(maxWordLength)
        self._set(**(dict(wordsCol="words", inputCol="text", outputCol="words", strategy="auto") | self._input_kwargs))

    def _fit(self, dataset: DataFrame) -> LongestMatchModel:
        found = vocabulary(dataset, self.getOrDefault("wordsCol"))
        return LongestMatchModel(found, self.getOrDefault("maxWordLength"), self.getOrDefault("strategy"))._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class LongestMatchModel(Model, HasInputCol, HasOutputCol):
    """Segments text: outputCol is array<string> that concatenates to the text; null for null."""

    def __init__(self, vocabulary: DataFrame, longest: int, strategy: str = "auto"):
        super().__init__()
        self.vocabulary, self.longest, self.strategy = vocabulary, valid_length(longest), strategy
        if strategy not in ("auto", "udf", "regex", "join"):
            raise ValueError(f"no such strategy: {strategy}")
        self._set(inputCol="text", outputCol="words")
        self._words: frozenset[str] | None = None

    def useful(self) -> DataFrame:
        """The words that can match."""
        return self.vocabulary.where(F.char_length("word").between(2, self.longest))

    def words(self) -> frozenset[str] | None:
        """The useful words, or None where they are too many to broadcast."""
        if self._words is None:
            size = self.useful().agg(F.sum(F.char_length("word") + 8)).first()[0] or 0
            if size > BROADCAST_CHARS:
                return None
            self._words = frozenset(r.word for r in self.useful().collect())
        return self._words

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, out = F.col(self.getInputCol()), self.getOutputCol()
        words = None if self.strategy == "join" else self.words()
        if words is None:
            if self.strategy not in ("auto", "join"):
                raise ValueError("the vocabulary is too large for this strategy")
            return self._joined(dataset)
        if self.strategy == "regex":
            return dataset.withColumn(out, F.regexp_extract_all(text, F.lit(trie_pattern(words)), 0))
        return dataset.withColumn(out, segmenter(dataset.sparkSession.sparkContext.broadcast(words), self.longest)(text))

    def _joined(self, dataset: DataFrame) -> DataFrame:
        """Distinct texts' places and lengths joined with the vocabulary; then a walk per text."""
        name, out = self.getInputCol(), self.getOutputCol()
        texts = dataset.select(F.col(name).alias("t")).where("t is not null").distinct().select("t", F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("h2"))
        n = F.char_length("t")
        places = texts.where(n > 1).select("t", "h", "h2", F.explode(F.sequence(F.lit(0), n - 2)).alias("p"))
        tries = places.select("h", "h2", "p", F.explode(F.sequence(F.lit(2), F.least(n - F.col("p"), F.lit(self.longest)))).alias("k"), "t").select("h", "h2", "p", "k", F.substr("t", F.col("p") + 1, F.col("k")).alias("word"))
        hits = tries.join(self.useful(), "word").groupBy("h", "h2", "p").agg(F.max("k").alias("k"))
        # a text's places are no more than its characters
        per = hits.groupBy("h", "h2").agg(F.collect_list(F.struct("p", "k")).alias("best"))

        @F.pandas_udf("array<string>")
        def walk(t: pd.Series, best: pd.Series) -> pd.Series:
            return pd.Series([segment_lengths(x, {} if b is None else {e["p"]: e["k"] for e in b}) for x, b in zip(t, best)])

        cut = texts.join(per, ["h", "h2"], "left").select("h", "h2", walk("t", "best").alias(out))
        base = dataset.drop(out) if out != name else dataset
        keyed = base.withColumn("_h", F.xxhash64(name)).withColumn("_h2", F.xxhash64(name, F.lit(1)))
        cut = cut.select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), F.col(out).alias("_cut"))
        joined = keyed.join(cut, ["_h", "_h2"], "left").withColumn(out, F.when(F.col(name).isNotNull(), F.col("_cut")))
        return joined.drop("_h", "_h2", "_cut")


def segmenter(words, longest: int):
    """A UDF text -> words with a broadcast vocabulary, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        greedy = Greedy(words.value, longest)
        for batch in batches:
            for at in slices(batch):
                out: list[str] = []
                ends: list[int | None] = [0]
                for t in batch[at].to_pylist():
                    if t is None:
                        ends[-1] = None  # a null offset is a null list
                    else:
                        greedy.add_words(t, out)
                    ends.append(len(out))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))

    return segment


class RandomSegmenterTransformer(Transformer, HasInputCol, HasOutputCol):
    """Cuts text at random places that a seed and the row's key columns fix."""

    prob = Param(Params._dummy(), "prob", "chance of a boundary between two characters", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, prob: float, keyCols: Sequence[str], seed: int = 0, inputCol: str = "text", outputCol: str = "words"):
        super().__init__()
        valid_prob(prob)
        self._set(**(dict(seed=0, inputCol="text", outputCol="words") | self._input_kwargs))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = [F.col(c) for c in self.getOrDefault("keyCols")]
        return dataset.withColumn(self.getOutputCol(), random_words(F.col(self.getInputCol()), self.getOrDefault("prob"), self.getOrDefault("seed"), *keys))


class LongestStringMatching:
    """The segmenter for lists in memory."""

    def __init__(self, *, max_word_length: int):
        self.max_word_length = valid_length(max_word_length)
        self._greedy = Greedy((), max_word_length)

    def fit(self, sents: Iterable[Iterable[str]]) -> None:
        self._greedy = Greedy((w for s in sents for w in s), self.max_word_length)

    def predict(self, sent_strs: Iterable[str]) -> list[list[str]]:
        return [*map(self._greedy.cut, sent_strs)]


class RandomSegmenter:
    """The random segmenter for lists in memory; without a seed, draws differ each time."""

    def __init__(self, *, prob: float, seed: int | None = None):
        self.prob, self.seed = valid_prob(prob), seed

    def fit(self, sents: Iterable[Iterable[str]]) -> None:
        raise NotImplementedError("No training needed for RandomSegmenter")

    def predict(self, sent_strs: Iterable[str]) -> list[list[str]]:
        rng = random.Random(self.seed)
        return [segment_random(s, self.prob, rng) for s in sent_strs]


