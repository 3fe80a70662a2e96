"""Part-of-speech tagging with a tag dictionary and an averaged perceptron.

Counting, thresholds and features are distributed. Tagging is row-local with the model broadcast: it
is bounded by (characters and tags) x classes, and the dictionary is measured before it is sent.
Training in the exact order is one chain of updates by definition, so `mode="exact"` goes through one
task: a single pass streams the words outside the dictionary, several gather the corpus and refuse more than `maxTokens`; `mode="mixing"` trains any corpus in place: each pass
every partition goes on from the common weights, and their means are the next ones (iterative
parameter mixing, McDonald, Hall and Mann 2010), which gives other weights.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import START, BatchTagger, Perceptron, Scorer, features, make_tagdict, train_pass
from ..sources import models

#: Words of a tag dictionary that is broadcast. Larger ones are looked up by a join beforehand.
BROADCAST_WORDS = 500_000
#: Words of a tag dictionary that a model may hold on the driver.
MOST_WORDS = 5_000_000
#: Sentences of which the open words are listed at once.
SENTENCES = 1000


def tag_counts(sents: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(word, tag, n) of sentences of (word, tag)."""
    one = sents.select(F.explode(tokens_col).alias("t"))
    return one.groupBy(F.col("t.word").alias("word"), F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def tag_dictionary(counts: DataFrame, frequency: int = 10, ambiguity: float = 0.95) -> DataFrame:
    """(word, tag): words seen `frequency` times or more of which one tag has at least the share
    `ambiguity`; of equally frequent tags the largest."""
    per = counts.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "tag")).alias("top"))
    return per.where((F.col("total") >= frequency) & (F.col("top.n") / F.col("total") >= ambiguity)).select("word", F.col("top.tag").alias("tag"))


def contexts(sents: DataFrame, words_col: str, keys: list[str]) -> DataFrame:
    """keys, pos (from 0), word, before2, before, after, after2: each token with its neighbours. They come
    from the sentence's own array, so there is no shuffle."""
    w = F.col(words_col)
    one = sents.select(*keys, w.alias("_w"), F.posexplode(w).alias("pos", "word"))
    at = lambda i: F.get("_w", i)
    p = F.col("pos")
    return one.select(
        *keys,
        p.cast("long").alias("pos"),
        "word",
        F.when(p == 0, F.lit("-START2-")).when(p == 1, F.lit("-START-")).otherwise(at(p - 2)).alias("before2"),
        F.when(p == 0, F.lit("-START-")).otherwise(at(p - 1)).alias("before"),
        F.coalesce(at(p + 1), F.lit("-END-")).alias("after"),
        F.coalesce(at(p + 2), F.lit("-END2-")).alias("after2"),
    )


def feature_columns(prev: str, prev2: str) -> list:
    """The 13 features of a row of contexts() with its two earlier tags, in order."""
    first = lambda c: F.substring(c, 1, 1)
    last = lambda c: F.right(F.col(c), F.lit(1))
    say = lambda text, c: F.concat(F.lit(text + " "), c)
    return [
        F.lit("bias"),
        say("i word's first char", first("word")),
        say("i word's final char", last("word")),
        say("i-1 word's first char", first("before")),
        say("i-1 word's final char", last("before")),
        say("i-1 tag", F.col(prev)),
        say("i-2 word's first char", first("before2")),
        say("i-2 word's final char", last("before2")),
        say("i-2 tag", F.col(prev2)),
        say("i+1 word's first char", first("after")),
        say("i+1 word's final char", last("after")),
        say("i+2 word's first char", first("after2")),
        say("i+2 word's final char", last("after2")),
    ]


def best_class(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tag, score of (keys, class, score): the highest score, of equal ones the largest class."""
    return scores.groupBy(*keys).agg(F.max(F.struct("score", "class")).alias("top")).select(*keys, F.col("top.class").alias("tag"), F.col("top.score").alias("score"))


def scoring(shared):
    """A UDF features -> best_class() of the sums of their weights, with broadcast weights of which each token meets
    some; in Arrow batches."""

    @F.arrow_udf("struct<tag:string,score:double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        classes = sorted({c for own in weights.values() for c in own}, reverse=True)  # so that argmax takes the largest
        for lists in batches:
            codes = lists.flatten().dictionary_encode()
            table = np.array([[weights.get(f, {}).get(c, np.nan) for c in classes] for f in codes.dictionary.to_pylist()]).reshape(-1, len(classes))
            own = table[codes.indices.to_numpy(zero_copy_only=False)]
            begin = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])[:-1]
            if not len(begin):
                yield pa.array([], pa.struct([("tag", pa.string()), ("score", pa.float64())]))
                continue
            # a class counts where a feature has a weight for it
            score = np.where(np.add.reduceat(~np.isnan(own), begin, dtype=int) > 0, np.add.reduceat(np.nan_to_num(own), begin), -np.inf)
            top = np.argmax(score, axis=1)
            yield pa.StructArray.from_arrays([pa.array(classes, pa.string()).take(pa.array(top)), pa.array(score[np.arange(len(top)), top])], ["tag", "score"])

    return best


class PerceptronTagger(Estimator, HasInputCol, HasOutputCol):
    """Trains on sentences of tokens (array<struct<word, tag>>) in the order of orderCol."""

    frequencyThreshold = Param(Params._dummy(), "frequencyThreshold", "least count of a dictionary word", TypeConverters.toInt)
    ambiguityThreshold = Param(Params._dummy(), "ambiguityThreshold", "least share of its tag", TypeConverters.toFloat)
    nIter = Param(Params._dummy(), "nIter", "passes", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the order of later passes", TypeConverters.toInt)
    orderCol = Param(Params._dummy(), "orderCol", "order of the first pass", TypeConverters.toString)
    tokensCol = Param(Params._dummy(), "tokensCol", "tagged sentences", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "exact or mixing", TypeConverters.toString)
    maxTokens = Param(Params._dummy(), "maxTokens", "tokens that exact mode gathers in its task, at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, frequencyThreshold: int = 10, ambiguityThreshold: float = 0.95, nIter: int = 5, seed: int = 0, orderCol: str = "sent_id", tokensCol: str = "tokens", inputCol: str = "words", outputCol: str = "tags", mode: str = "exact", maxTokens: int = 20_000_000):
        super().__init__()
        self._set(**(dict(frequencyThreshold=10, ambiguityThreshold=0.95, nIter=5, seed=0, orderCol="sent_id", tokensCol="tokens", inputCol="words", outputCol="tags", mode="exact", maxTokens=20_000_000) | self._input_kwargs))

    def _fit(self, dataset: DataFrame) -> PerceptronTaggerModel:
        get = self.getOrDefault
        tokens = get("tokensCol")
        sents = dataset.select(F.col(get("orderCol")).alias("_order"), F.col(tokens).alias("_tokens"))
        bad, total = sents.agg(F.max(F.when(F.exists("_tokens", lambda t: t["word"].isNull() | t["tag"].isNull()), 1)), F.sum(F.greatest(F.size("_tokens"), F.lit(0)))).first()
        if bad:
            raise ValueError("a word or tag is null")
        counts = tag_counts(sents, "_tokens")
        classes = sorted(r.tag for r in counts.select("tag").distinct().collect())
        words = tag_dictionary(counts, get("frequencyThreshold"), get("ambiguityThreshold"))
        found = words.limit(MOST_WORDS + 1).collect()
        if len(found) > MOST_WORDS:
            raise ValueError(f"the tag dictionary has more than {MOST_WORDS} words; raise frequencyThreshold")
        tagdict = {r.word: r.tag for r in found}
        if get("mode") == "mixing":
            weights = self._mixed(sents, tagdict, classes)
        elif get("mode") == "exact":
            # a single pass streams, so it has no such limit
            if get("nIter") > 1 and (total or 0) > get("maxTokens"):
                raise ValueError(f"{total} tokens are too many for one task; mode='mixing' trains them where they are")
            weights = self._exact(sents, tagdict, classes)
        else:
            raise ValueError(f"no such mode: {get('mode')}")
        return PerceptronTaggerModel(weights, tagdict, classes)._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())

    def _one_pass(self, sents: DataFrame, tagdict: dict[str, str], classes: list[str]) -> dict[str, dict[str, float]]:
        """The exact first pass, streamed in order through one task. Words of the dictionary change nothing, so only
        the others are moved, each with its context; an earlier tag that the dictionary hasn't is the guess before."""
        shared = sents.sparkSession.sparkContext.broadcast(tagdict)

        def open_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value.get
            for batch in batches:
                for at in range(0, batch.num_rows, SENTENCES):
                    part = batch.slice(at, SENTENCES)
                    sent, place, truth, values = [], [], [], []
                    lists = part.column("_tokens")
                    flat = lists.flatten()
                    words, tags = flat.field(0).to_pylist(), flat.field(1).to_pylist()
                    end = 0
                    for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
                        begin, end = end, end + (n or 0)
                        own = words[begin:end]
                        book = [known(w) for w in own]
                        for j, tag in enumerate(book):
                            if tag is None:
                                prev = book[j - 1] if j else START[0]
                                prev2 = book[j - 2] if j > 1 else START[1 - j]
                                # features() with tags left open ends where values of a tag would be
                                found = features(own, j, "", "")
                                found[5] = None if prev is None else found[5] + prev
                                found[8] = None if prev2 is None else found[8] + prev2
                                sent.append(i)
                                place.append(j)
                                truth.append(tags[begin + j])
                                values.append(found)
                    if sent:
                        at_rows = part.select(["_order", "_row"]).take(pa.array(sent))
                        yield pa.RecordBatch.from_arrays([*at_rows.columns, pa.array(place, pa.int32()), pa.array(truth, pa.string()), pa.array(values, pa.list_(pa.string()))], ["_order", "_row", "_place", "truth", "features"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Perceptron(classes=classes)
            row, guesses = None, {}
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("_row", "_place", "truth", "features")]
                for at, j, truth, feats in zip(*columns):
                    if at != row:
                        row, guesses = at, {}
                    if feats[5] is None:
                        feats[5] = f"i-1 tag {guesses[j - 1]}"
                    if feats[8] is None:
                        feats[8] = f"i-2 tag {guesses[j - 2]}"
                    guess = guesses[j] = model.predict(feats)
                    model.update(truth, guess, feats)
            model.average()
            yield pa.RecordBatch.from_pandas(as_rows(model.weights), schema=pa.schema([("feature", pa.string()), ("class", pa.string()), ("weight", pa.float64())]), preserve_index=False)

        numbered = sents.withColumn("_row", F.monotonically_increasing_id())
        kind = numbered.schema["_order"].dataType.simpleString()
        rows = numbered.mapInArrow(open_tokens, f"_order {kind}, _row long, _place int, truth string, features array<string>")
        chain = rows.repartition(1).sortWithinPartitions(F.asc_nulls_last("_order"), "_row", "_place")
        return from_rows(chain.mapInArrow(run, "feature string, class string, weight double").collect())

    def _exact(self, sents: DataFrame, tagdict: dict[str, str], classes: list[str]) -> dict[str, dict[str, float]]:
        if self.getOrDefault("nIter") == 1:
            return self._one_pass(sents, tagdict, classes)
        n_iter, seed = self.getOrDefault("nIter"), self.getOrDefault("seed")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            corpus = [[(t["word"], t["tag"]) for t in s] for s in frame.sort_values("_order", kind="stable")["_tokens"]]
            model, rng = Perceptron(classes=classes), random.Random(seed)
            for _ in range(n_iter):
                train_pass(model, tagdict, corpus)
                rng.shuffle(corpus)
            model.average()
            return as_rows(model.weights)

        rows = sents.groupBy(F.lit("all").alias("_all")).applyInPandas(run, "feature string, class string, weight double").collect()
        return from_rows(rows)

    def _mixed(self, sents: DataFrame, tagdict: dict[str, str], classes: list[str]) -> dict[str, dict[str, float]]:
        common: dict[str, dict[str, float]] = {}
        passes: list[dict[str, dict[str, float]]] = []
        for _ in range(self.getOrDefault("nIter")):
            start = sents.sparkSession.sparkContext.broadcast(common)

            def run(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
                model = Perceptron({f: dict(w) for f, w in start.value.items()}, classes)
                some = False
                for frame in batches:
                    some = some or len(frame) > 0
                    train_pass(model, tagdict, ([(t["word"], t["tag"]) for t in s] for s in frame.sort_values("_order")["_tokens"]))
                if some:
                    yield pd.concat([as_rows(model.weights), pd.DataFrame({"feature": [None], "class": [None], "weight": [1.0]})])

            rows = sents.mapInPandas(run, "feature string, class string, weight double").groupBy("feature", "class").agg(F.sum("weight").alias("weight")).collect()
            shards = next((r.weight for r in rows if r.feature is None), 1.0)
            common = {}
            for r in rows:
                if r.feature is not None:
                    own = common.setdefault(r.feature, {})
                    if r["class"] is not None:
                        own[r["class"]] = r.weight / shards
            passes.append(common)
        out: dict[str, dict[str, float]] = {}
        for p in passes:
            for f, own in p.items():
                mean = out.setdefault(f, {})
                for c, w in own.items():
                    mean[c] = mean.get(c, 0.0) + w / len(passes)
        return {f: {c: round(w, 3) for c, w in own.items() if round(w, 3)} for f, own in out.items()}


def as_rows(weights: dict[str, dict[str, float]]) -> pd.DataFrame:
    """A feature without weights has one row with a null class."""
    rows = [(f, c, w) for f, own in weights.items() for c, w in (own.items() or [(None, 0.0)])]
    return pd.DataFrame(rows, columns=["feature", "class", "weight"])


def from_rows(rows: Iterable) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        own = out.setdefault(r["feature"], {})
        if r["class"] is not None:
            own[r["class"]] = r["weight"]
    return out


def tagging(shared):
    """A UDF words -> tags with a broadcast (weights, dictionary, classes), in Arrow batches."""

    @F.arrow_udf("array<string>")
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(BatchTagger(*shared.value).tag, batches)

    return tag


class PerceptronTaggerModel(Model, HasInputCol, HasOutputCol):
    """Tags words (array<string>): outputCol is array<string> of the same length; null for null."""

    def __init__(self, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]):
        super().__init__()
        self.weights, self.tagdict, self.classes = weights, tagdict, set(classes)
        self._set(inputCol="words", outputCol="tags")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if len(self.tagdict) > BROADCAST_WORDS:
            return self._looked_up(dataset)
        shared = dataset.sparkSession.sparkContext.broadcast((self.weights, self.tagdict, sorted(self.classes)))

        return dataset.withColumn(self.getOutputCol(), tagging(shared)(self.getInputCol()))

    def _looked_up(self, dataset: DataFrame) -> DataFrame:
        """With each text's own part of the dictionary, joined to its distinct words."""
        name = self.getInputCol()
        spark = dataset.sparkSession
        words = models.tagdict_df(spark, self.tagdict)
        sents = dataset.select(F.col(name).alias("s")).where("s is not null").distinct().withColumn("h", F.xxhash64("s")).withColumn("h2", F.xxhash64("s", F.lit(1)))
        met = sents.select("h", "h2", F.explode(F.array_distinct("s")).alias("word")).join(words, "word").groupBy("h", "h2").agg(F.collect_list(F.struct("word", "tag")).alias("known"))
        shared = spark.sparkContext.broadcast((self.weights, sorted(self.classes)))

        @F.arrow_udf("array<string>")
        def tag(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            model = Scorer(*shared.value)
            for sents, known in batches:
                books = ({} if k is None else {e["word"]: e["tag"] for e in k} for k in known.to_pylist())
                yield pa.array([None if s is None else model.tag(s, k) for s, k in zip(sents.to_pylist(), books)], pa.list_(pa.string()))

        keyed = dataset.withColumn("h", F.xxhash64(name)).withColumn("h2", F.xxhash64(name, F.lit(1)))
        return keyed.join(met, ["h", "h2"], "left").withColumn(self.getOutputCol(), tag(name, "known")).drop("h", "h2", "known")

    def weights_df(self, spark: SparkSession) -> DataFrame:
        return models.weights_df(spark, self.weights)

    def tagdict_df(self, spark: SparkSession) -> DataFrame:
        return models.tagdict_df(spark, self.tagdict)

    def classes_df(self, spark: SparkSession) -> DataFrame:
        return models.classes_df(spark, self.classes)

    def save_json(self, path: str) -> None:
        models.save_json(path, self.weights, self.tagdict, self.classes)

    def to_json(self) -> str:
        return models.to_json(self.weights, self.tagdict, self.classes)

    @classmethod
    def from_json(cls, text: str) -> PerceptronTaggerModel:
        return cls(*models.from_json(text, ({}, {}, set())))

    def save_parquet(self, spark: SparkSession, path: str) -> None:
        models.save_parquet(spark, path, self.weights, self.tagdict, self.classes)

    @classmethod
    def load_json(cls, path: str) -> PerceptronTaggerModel:
        return cls(*models.load_json(path, ({}, {}, set())))

    @classmethod
    def load_parquet(cls, spark: SparkSession, path: str) -> PerceptronTaggerModel:
        return cls(*models.load_parquet(spark, path))


class AveragedPerceptronTagger:
    """The tagger for lists in memory. Training again goes on from the averaged weights and adds to
    the dictionary and the classes; the order of later passes is drawn from the seed."""

    def __init__(self, *, frequency_threshold: int = 10, ambiguity_threshold: float = 0.95, n_iter: int = 5, seed: int | None = None):
        self.frequency_threshold, self.ambiguity_threshold, self.n_iter = frequency_threshold, ambiguity_threshold, n_iter
        self._rng = random.Random(seed)
        self._model = Perceptron()
        self._tagdict: dict[str, str] = {}
        self._classes: set[str] = set()
        self._scorer = Scorer({}, ())

    def train(self, tagged_sents: Sequence[Sequence[tuple[str, str]]]) -> None:
        corpus = [list(s) for s in tagged_sents]
        words, tags = make_tagdict(corpus, self.frequency_threshold, self.ambiguity_threshold)
        self._tagdict |= words
        self._classes |= tags
        self._model.classes = sorted(self._classes)
        for _ in range(self.n_iter):
            train_pass(self._model, self._tagdict, corpus)
            self._rng.shuffle(corpus)
        self._model.average()
        self._scorer = Scorer(self._model.weights, self._classes)

    def tag(self, words: Sequence[str]) -> list[str]:
        return self._scorer.tag(words, self._tagdict)

    def save(self, path: str) -> None:
        models.save_json(path, self._model.weights, self._tagdict, self._classes)

    def load(self, path: str) -> None:
        """Replaces what the file has; the counter of instances stays."""
        self._model.weights, self._tagdict, self._classes = models.load_json(path, (self._model.weights, self._tagdict, self._classes))
        self._model.classes = sorted(self._classes)
        self._scorer = Scorer(self._model.weights, self._classes)

    @property
    def weights(self) -> dict[str, dict[str, float]]:
        return {f: dict(own) for f, own in self._model.weights.items()}

    @property
    def tagdict(self) -> dict[str, str]:
        return dict(self._tagdict)

    @property
    def classes(self) -> set[str]:
        return set(self._classes)
