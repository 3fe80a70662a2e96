"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, with Python workers, and once for the figure, into the noop sink. Then the published
workloads: segmentation with a vocabulary of 1000 random words and sentences of 10 of them, tagging of sentences
of 4 to 12 words, each on Spark (many sentences in memory) and with the lists' facades, as mean, least and most of
several runs; fit and training times; and the facades' segmentation over growing sizes.
"""

from __future__ import annotations

import json
import os
import random
import string
import sys
import time
from statistics import mean

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigrid.operators import AveragedPerceptronTagger, LongestMatch, LongestStringMatching, PerceptronTagger  # noqa: E402
from lexigrid.plans import catalogue  # noqa: E402
from lexigrid.sources.corpus import documents, lines, tagged, words_of  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
#: Registered queries that are timed as they are.
HEADLINE = ("trie_nodes", "trie_longest_match", "lsm_vocab", "lsm_segment", "rand_seeded", "pos_tagdict", "pos_features", "pos_tag")


def timed(make) -> float:
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = documents(spark, SF_DIR)
    found: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda name=name: catalogue.QUERIES[name](spark, SF_DIR)
        timed(run)
        found[name] = round(timed(run), 3)
    # the published figures are for a trained model on sentences in memory
    sents = lines(docs, ["doc_id"]).repartition(CPUS * 4).cache()
    model = LongestMatch(maxWordLength=10).fit(docs.select(words_of(F.col("text")).alias("words")))
    rates["lsm_predict"] = rate(found, "lsm_predict", sents, lambda df: model.transform(df))
    turns = tagged(catalogue._turns(spark, SF_DIR)).withColumn("sent_id", F.col("conv_id") * 1000 + F.col("turn")).repartition(CPUS * 4).cache()
    tagger = PerceptronTagger(frequencyThreshold=10, ambiguityThreshold=0.95, nIter=1).fit(turns)
    rates["pos_predict"] = rate(found, "pos_predict", turns, lambda df: tagger.transform(df))
    published, scaling = workloads(spark)
    print(json.dumps({"published": published, "lsm_scaling_sentences_per_sec": scaling, "metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sentences_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


def rate(found: dict[str, float], name: str, sents: DataFrame, predict) -> float:
    """Sentences a second, of sentences in memory."""
    n = sents.count()
    timed(lambda: predict(sents))
    found[name] = round(timed(lambda: predict(sents)), 3)
    return round(n / found[name], 1)


def several(run, runs: int = 5) -> list[float]:
    """Seconds of each run, after one to warm up."""
    run()
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return out


def summary(n: int, seconds: list[float]) -> dict[str, float]:
    """Sentences a second by the mean of the runs; mean, least and most seconds."""
    return {"sentences": n, "per_sec": round(n / mean(seconds), 1), "mean_s": round(mean(seconds), 4), "min_s": round(min(seconds), 4), "max_s": round(max(seconds), 4)}


def segmentation(n_words: int, sentences: int, seed: int = 1) -> tuple[list[tuple[str, ...]], list[str]]:
    """Training sentences of 5 words, and unsegmented ones of 10."""
    rng = random.Random(seed)
    words: dict[str, None] = {}
    while len(words) < n_words:
        words["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10)))] = None
    train = [tuple(rng.choices([*words], k=5)) for _ in range(n_words // 5)]
    known = sorted({w for s in train for w in s})
    return train, ["".join(rng.choices(known, k=10)) for _ in range(sentences)]


def tagging(sentences: int, seed: int = 1) -> list[list[tuple[str, str]]]:
    """Sentences of 4 to 12 words of 2000, each with one to three of 20 tags, one of which is the usual one."""
    rng = random.Random(seed)
    tags = [f"T{i:02d}" for i in range(20)]
    book = [("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))), rng.sample(tags, rng.randint(1, 3))) for _ in range(2000)]
    pick = lambda own: own[0] if rng.random() < 0.8 else rng.choice(own)
    return [[(w, pick(own)) for w, own in rng.choices(book, k=rng.randint(4, 12))] for _ in range(sentences)]


def workloads(spark: SparkSession, many: int = 800_000) -> tuple[dict[str, dict], dict[str, float]]:
    out: dict[str, dict] = {}
    train, few = segmentation(1000, 1000)
    facade = LongestStringMatching(max_word_length=10)
    out["lsm_fit_lists"] = summary(len(train), several(lambda: facade.fit(train)))
    out["lsm_predict_lists"] = summary(len(few), several(lambda: facade.predict(few)))
    fit = LongestMatch(maxWordLength=10).fit(spark.createDataFrame([(list(s),) for s in train], "words array<string>"))
    texts = spark.createDataFrame([(t,) for t in segmentation(1000, many // 8)[1]], "text string")
    texts = texts.crossJoin(spark.range(8).select()).repartition(CPUS * 2).cache()
    texts.count()
    out["lsm_predict_spark"] = summary(many, several(lambda: fit.transform(texts).write.format("noop").mode("overwrite").save()))
    gold = tagging(2000)
    tagger = AveragedPerceptronTagger(frequency_threshold=5, ambiguity_threshold=0.9, n_iter=3, seed=0)
    out["pos_train_lists"] = summary(len(gold), several(lambda: AveragedPerceptronTagger(frequency_threshold=5, ambiguity_threshold=0.9, n_iter=3, seed=0).train(gold), 2))
    tagger.train(gold)
    sents = [[w for w, _ in s] for s in tagging(2000, 2)]
    out["pos_tag_lists"] = summary(len(sents), several(lambda: [tagger.tag(s) for s in sents]))
    rows = spark.createDataFrame([(i, [{"word": w, "tag": t} for w, t in s]) for i, s in enumerate(gold)], "sent_id long, tokens array<struct<word string, tag string>>")
    estimator = PerceptronTagger(frequencyThreshold=5, ambiguityThreshold=0.9, nIter=3)
    out["pos_train_spark"] = summary(len(gold), several(lambda: estimator.fit(rows), 1))
    model = estimator.fit(rows)
    words = spark.createDataFrame([(s,) for s in ([w for w, _ in s] for s in tagging(many // 80, 2))], "words array<string>")
    words = words.crossJoin(spark.range(20).select()).repartition(CPUS * 2).cache()
    n = words.count()
    out["pos_tag_spark"] = summary(n, several(lambda: model.transform(words).write.format("noop").mode("overwrite").save(), 3))
    scaling = {}
    for size in (100, 250, 500, 1000, 2000, 5000):
        train, few = segmentation(size, size)
        facade = LongestStringMatching(max_word_length=10)
        facade.fit(train)
        scaling[str(size)] = summary(size, several(lambda f=facade, s=few: f.predict(s)))["per_sec"]
    return out, scaling


if __name__ == "__main__":
    main()
