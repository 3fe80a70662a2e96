import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexigrid.functions.columns import random_words, round3
from lexigrid.functions.kernels import Perceptron, make_tagdict, segment_greedy, tag_words, train_pass
from lexigrid.functions.sql import register_random, register_segmenter, register_tagger
from lexigrid.operators import LongestMatch, LongestMatchModel, PerceptronTagger, PerceptronTaggerModel, RandomSegmenterTransformer, SequenceSet
from lexigrid.operators.segment import trie_pattern
from lexigrid.sources import corpus
from lexigrid.streaming import read_text_stream, write_transformed
from lexigrid.streaming.apply import word_counts


def column(df, name):
    return [r[name] for r in df.collect()]


def test_sequence_set(spark):
    s = SequenceSet(spark.createDataFrame([("ab",), ("abc",), ("b",), ("ab",), (None,), ("日本",), ("",)], "seq string"))
    assert s.count() == 5 and not s.is_empty() and s.clear().is_empty()
    p = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("",), (None,), ("日本語",), ("x",)], "seq string")
    assert {r.seq: r.is_member for r in s.contains(p).collect()} == {"a": False, "ab": True, "abcd": False, "": True, None: False, "日本語": False, "x": False}
    assert {r.seq: r.has_prefix for r in s.has_prefix(p).collect()} == {"a": True, "ab": True, "abcd": False, "": True, None: False, "日本語": False, "x": False}
    assert {r.seq: r.match_len for r in s.longest_match(p, 5).collect()} == {"a": 0, "ab": 2, "abcd": 3, "": 0, None: 0, "日本語": 2, "x": 0}
    assert {r.seq: r.match_len for r in s.longest_match(p, 2).collect()}["abcd"] == 2
    nodes = {r.prefix: (r.is_terminal, r.num_children) for r in s.prefix_table().collect()}
    assert nodes == {"": (True, 3), "a": (False, 1), "ab": (True, 1), "abc": (True, 0), "b": (True, 0), "日": (False, 1), "日本": (True, 0)}
    new = spark.createDataFrame([(1, "ab"), (2, "zz"), (3, "zz"), (4, None)], "o int, seq string")
    assert {r.o: r.is_new for r in s.insert_flags(new, ["o"]).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert s.insert(new).count() == 6


def test_sequence_set_of_arrays_and_empty(spark):
    s = SequenceSet(spark.createDataFrame([([1, 2],), ([1, 2, 3],)], "seq array<int>"))
    p = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],)], "seq array<int>")
    assert sorted(column(s.longest_match(p, 9), "match_len")) == [0, 0, 3]
    assert sorted(column(s.has_prefix(p), "has_prefix")) == [False, True, True]
    e = SequenceSet.empty(spark)
    q = spark.createDataFrame([("",), ("a",)], "seq string")
    assert {r.seq: r.has_prefix for r in e.has_prefix(q).collect()} == {"": True, "a": False}
    assert e.is_empty() and e.prefix_table().isEmpty()


TEXTS = ["thatisadog", "", "😀a\n b", "abcabx", None, "aaaa" * 50, "thatisadog"]


def test_segment_strategies_agree(spark):
    words = ["this", "is", "that", "abc", "ab", "😀a", "aaa", "b", "verylongword"]
    sents = spark.createDataFrame([(words,), (["ab", "cd"],)], "words array<string>")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    expected = {i: None if t is None else segment_greedy(t, {w for w in [*words, "cd"] if len(w) > 1}, 4) for i, t in enumerate(TEXTS)}
    for strategy in ("auto", "udf", "regex", "join"):
        model = LongestMatch(maxWordLength=4, strategy=strategy).fit(sents)
        assert {r.i: r.words for r in model.transform(texts).collect()} == expected, strategy
    assert sorted(column(model.vocabulary, "word")) == sorted({w for w in [*words, "cd"] if len(w) > 1})
    with pytest.raises(ValueError):
        LongestMatch(maxWordLength=1)
    with pytest.raises(ValueError):
        trie_pattern(["abcdef"], limit=3)


def test_random_segmenter(spark):
    texts = spark.createDataFrame(list(enumerate(["hello world", "", "x", None, "日本語😀!" * 9, "ab\0cd\0" * 5])), "i int, text string")
    same = RandomSegmenterTransformer(prob=0.0, keyCols=["i"]).transform(texts)
    assert {r.i: r.words for r in same.collect()} == {0: ["hello world"], 1: [], 2: ["x"], 3: None, 4: ["日本語😀!" * 9], 5: ["ab\0cd\0" * 5]}
    cut = RandomSegmenterTransformer(prob=0.5, keyCols=["i"], seed=2)
    a = {r.i: r.words for r in cut.transform(texts).collect()}
    assert a == {r.i: r.words for r in cut.transform(texts.repartition(3)).collect()}
    assert all("".join(w) == t.text for t in texts.collect() if t.text is not None for w in [a[t.i]] if len(w) != 1 or t.text) and len(a[4]) > 5
    register_random(spark, 0.5, 2)
    b = texts.select("i", F.expr("segment_random(i, text)").alias("words"))
    assert {r.i: r.words for r in b.collect()} == a
    for bad in (-0.1, 1.0, math.nan):
        with pytest.raises(ValueError):
            RandomSegmenterTransformer(prob=bad, keyCols=["i"])
    assert column(texts.where("i = 0").select(random_words(F.col("text"), 0.999999, 1, F.col("i")).alias("w")), "w") == [list("hello world")]


def test_rounding_column(spark):
    df = spark.createDataFrame([(0.0005,), (-0.0005,), (0.0014999,)], "x double")
    assert column(df.select(round3(F.col("x")).alias("r")), "r") == [0.001, -0.001, 0.001]


SENTS = [
    [("Ann", "N"), ("runs", "V"), ("home", "N")],
    [("the", "D"), ("dog", "N"), ("runs", "V")],
    [],
    [("a", "D"), ("run", "N"), ("home", "A"), (".", "P")],
] * 4


def tagged(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SENTS)], "sent_id int, tokens array<struct<word:string,tag:string>>").repartition(3)


def test_tagger_exact_and_saved(spark, tmp_path):
    model = PerceptronTagger(frequencyThreshold=4, ambiguityThreshold=0.9, nIter=1).fit(tagged(spark))
    local = Perceptron(classes={"N", "V", "D", "A", "P"})
    train_pass(local, model.tagdict, SENTS)
    local.average()
    assert model.weights == local.weights and model.classes == set(local.classes)
    words = spark.createDataFrame([(0, ["Ann", "xx", "home"]), (1, []), (2, None)], "i int, words array<string>")
    expected = {0: tag_words(["Ann", "xx", "home"], local, model.tagdict), 1: [], 2: None}
    assert {r.i: r.tags for r in model.transform(words).collect()} == expected
    assert {r.i: r.tags for r in model._looked_up(words).collect()} == expected
    model.save_json(str(tmp_path / "m.json"))
    model.save_parquet(spark, str(tmp_path / "m"))
    for other in (PerceptronTaggerModel.load_json(str(tmp_path / "m.json")), PerceptronTaggerModel.load_parquet(spark, str(tmp_path / "m"))):
        assert (other.weights, other.tagdict, other.classes) == (model.weights, model.tagdict, model.classes)
    register_tagger(spark, model)
    assert {r.i: r.t for r in words.select("i", F.expr("pos_tag(words)").alias("t")).collect()} == expected


def test_tagger_modes_and_limits(spark):
    mixed = PerceptronTagger(frequencyThreshold=99, nIter=2, mode="mixing").fit(tagged(spark))
    assert mixed.weights and mixed.classes == {"N", "V", "D", "A", "P"}
    with pytest.raises(ValueError, match="too many"):
        PerceptronTagger(maxTokens=3).fit(tagged(spark))
    bad = spark.createDataFrame([(1, [("a", None)])], "sent_id int, tokens array<struct<word:string,tag:string>>")
    with pytest.raises(ValueError, match="null"):
        PerceptronTagger().fit(bad)


def test_sql_and_stream(spark, tmp_path):
    model = LongestMatchModel(spark.createDataFrame([("ab",), ("cd",)], "word string"), 3)
    register_segmenter(spark, model)
    assert column(spark.sql("select segment_longest('abxcd') as w"), "w") == [["ab", "x", "cd"]]
    assert [tuple(r) for r in spark.sql("select * from segment_rows('abxcd')").collect()] == [(0, "ab"), (1, "x"), (2, "cd")]
    spark.createDataFrame([(1, "abcd"), (2, "xab")], "i int, text string").write.parquet(str(tmp_path / "in"))
    stream = read_text_stream(spark, str(tmp_path / "in"), "i int, text string")
    write_transformed(stream, model, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.i: r.words for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: ["ab", "cd"], 2: ["x", "ab"]}


def test_word_counts_by_event_time(spark, tmp_path):
    """The window is written when the watermark has passed its end; a row that comes after that is dropped."""
    model = LongestMatchModel(spark.createDataFrame([("ab",), ("cd",)], "word string"), 3, "regex")
    at = lambda m: datetime(2024, 1, 1, 0, m)
    schema = "ts timestamp, text string"
    (tmp_path / "in").mkdir()
    stream = read_text_stream(spark, str(tmp_path / "in"), schema, 1)
    counted = word_counts(stream, model, "ts", late="5 minutes")
    query = counted.writeStream.format("memory").queryName("lexigrid_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in ([(at(1), "abcd"), (at(2), "abx")], [(at(40), "cd")], [(at(3), "ab")], [(at(59), "x")]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        got = {(r.window.start.minute, r.word): r.n for r in spark.table("lexigrid_counts").collect()}
    finally:
        query.stop()
    assert got == {(0, "ab"): 2, (0, "cd"): 1, (0, "x"): 1, (40, "cd"): 1}


def test_slash_tagged_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The/at dog/nn 1/2/cd ./.\n\n  佢/r/keoi5/ 去/v/heoi3/ bare\n", encoding="utf-8")
    rows = [[tuple(t) for t in r.tokens] for r in corpus.slash_tagged(spark, str(tmp_path)).orderBy("line").collect()]
    assert rows == [[("The", "at"), ("dog", "nn"), ("1/2", "cd"), (".", ".")], [("佢", "r"), ("去", "v"), ("bare", None)]]


def test_registered_trainer_equals_the_plain_one(spark, sf):
    from lexigrid.plans import catalogue

    sents = {}
    for r in corpus.tagged(catalogue._turns(spark, sf)).collect():
        sents[r.conv_id * 1_000_000 + r.turn] = [tuple(t) for t in r.tokens]
    order = [sents[k] for k in sorted(sents)]
    tagdict, classes = make_tagdict(order, 20, 0.97)
    plain = Perceptron(classes=classes)
    train_pass(plain, tagdict, order)
    plain.average()
    expected = {(f, c, w) for f, own in plain.weights.items() for c, w in (own.items() or [(None, None)])}
    assert {tuple(r) for r in catalogue.pos_train(spark, sf).select("feature", "class", "weight").collect()} == expected


def test_generated_corpora(spark):
    vocabulary = corpus.generated_vocabulary(spark, 30)
    sents = corpus.generated_sentences(spark, vocabulary, 30, 12)
    assert all("".join(r.words) == r.text and 5 <= len(r.words) <= 20 for r in sents.collect()) and sents.count() == 12
    made = corpus.generated_tagged(spark, [["D", "N"], ["N", "V", "N"]], {"D": ["a"], "N": ["x", "y"], "V": ["go"]}, 10)
    assert all([t.tag for t in r.tokens] in (["D", "N"], ["N", "V", "N"]) for r in made.collect())
    assert corpus.usable(made).count() <= 10
    first, rest = corpus.split(made, "sent_id")
    assert (first.count(), rest.count()) == (8, 2)


def test_longest_match_of_arrays(spark):
    members = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "b", "c"],), ([None, "x"],), ([],)], "seq array<string>")
    probes = spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["b", "a"]), (3, []), (4, None), (5, ["a", "b", "c", "d"]), (6, [None, "x", "y"]), (7, ["a", "b", "z"]), (8, ["x", None])], "i int, w array<string>")
    s = SequenceSet.of(members, "seq")
    found = s.longest_match(probes, 9, "w")
    assert found.columns == ["i", "w", "match_len"] and {r.i: r.match_len for r in found.collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 3, 6: 2, 7: 2, 8: 0}
    assert {r.i: r.match_len for r in s.longest_match(probes, 2, "w").collect()}[5] == 2


def test_long_arrays_prefixes_are_not_moved(spark):
    # 300 words of 20 letters: their prefixes have 900,000 letters together
    probes = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.lpad(F.concat_ws("-", "id", k), 20, "x")).alias("w"))
    s = SequenceSet.of(probes.select(F.slice("w", 1, 250).alias("seq")), "seq")
    found = s.longest_match(probes, 1 << 30, "w")
    assert column(found, "match_len") == [250] * 20
    # a prefix as a value of its own would be a slice by a column
    assert "_start" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_generated_sentences_broadcast_nothing(spark):
    made = corpus.generated_sentences(spark, corpus.generated_vocabulary(spark, 30), 30, 12)
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_one_exact_pass_has_no_limit(spark):
    for threshold in (4, 99):
        model = PerceptronTagger(frequencyThreshold=threshold, ambiguityThreshold=0.9, nIter=1, maxTokens=3).fit(tagged(spark))
        plain = Perceptron(classes=model.classes)
        train_pass(plain, model.tagdict, SENTS)
        plain.average()
        assert model.weights == plain.weights


def test_tokens_are_scored_where_they_are(spark, sf):
    from lexigrid.operators.tagging import best_class
    from lexigrid.plans import catalogue

    found = catalogue.pos_score(spark, sf)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    met = catalogue._gold(spark, sf).join(catalogue._counted(spark, sf), "feature").groupBy("conv_id", "turn", "pos", "class").agg(F.sum("weight").alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best_class(met, ["conv_id", "turn", "pos"]).collect()))


def test_flags_within_arrays(spark):
    df = spark.createDataFrame([(2, ["b", "a", "b", None]), (1, ["a", "m"]), (3, []), (4, None), (None, ["b", "z"])], "d int, w array<string>")
    s = SequenceSet.of(spark.createDataFrame([("m",)], "seq string"), "seq")
    found = {(r.d, r.pos): (r.word, r.is_new) for r in s.insert_flags_within(df, "d", "w", "pos", "word").collect()}
    assert found == {(2, 0): ("b", False), (2, 1): ("a", False), (2, 2): ("b", False), (2, 3): (None, False), (1, 0): ("a", True), (1, 1): ("m", False), (None, 0): ("b", True), (None, 1): ("z", True)}
