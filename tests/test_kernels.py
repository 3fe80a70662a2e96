import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexigrid.functions import kernels
from lexigrid.functions.kernels import BatchTagger, Cutter, Greedy, Perceptron, Scorer, features, make_tagdict, round3, segment_greedy, tag_words, train_pass
from lexigrid.operators import AveragedPerceptronTagger, LongestStringMatching, RandomSegmenter

TEXT = st.text(alphabet="abcé日😀 \n", max_size=30)
WORDS = st.sets(st.text(alphabet="abcé日😀", min_size=1, max_size=5), max_size=12)


@given(TEXT, WORDS, st.integers(2, 5))
def test_greedy_is_lossless_and_maximal(text, words, longest):
    out = segment_greedy(text, words, longest)
    assert "".join(out) == text
    at = 0
    for w in out:
        assert len(w) == 1 or (len(w) <= longest and w in words)
        assert not any(text[at : at + k] in words for k in range(len(w) + 1, min(longest, len(text) - at) + 1))
        at += len(w)


@pytest.mark.parametrize(
    ("longest", "words", "text", "expected"),
    [
        (6, {"ab", "abcd"}, "abcx", ["ab", "c", "x"]),
        (6, {"abc", "ab", "cde"}, "abcde", ["abc", "d", "e"]),
        (3, {"hello"}, "hello", list("hello")),
        (4, {"😀a"}, "😀a\n b", ["😀a", "\n", " ", "b"]),
        (4, {"你好", "世界"}, "你好世界", ["你好", "世界"]),
        (4, {"ab"}, "", []),
    ],
)
def test_greedy_cases(longest, words, text, expected):
    assert segment_greedy(text, words, longest) == expected


def test_list_segmenters():
    m = LongestStringMatching(max_word_length=4)
    assert m.predict(["hello"]) == [list("hello")]
    m.fit([("xy", "a")])
    m.fit([["zw", "b"]])
    assert m.predict(["xyzw", ""]) == [["x", "y", "zw"], []]
    with pytest.raises(ValueError, match="max_word_length must be >= 2"):
        LongestStringMatching(max_word_length=1)
    for bad in (-0.1, 1.0, 1.5, float("nan")):
        with pytest.raises(ValueError, match="prob must be from"):
            RandomSegmenter(prob=bad)
    with pytest.raises(NotImplementedError):
        RandomSegmenter(prob=0.5).fit([["a"]])
    assert RandomSegmenter(prob=0.0).predict(["abc", "", "x"]) == [["abc"], [], ["x"]]
    cut = RandomSegmenter(prob=0.5, seed=3).predict(["hello world"] * 5)
    assert cut == RandomSegmenter(prob=0.5, seed=3).predict(["hello world"] * 5)
    assert all("".join(w) == "hello world" for w in cut)


def test_rounding_is_half_away_from_zero():
    assert [round3(x) for x in (0.0005, -0.0005, 0.0025, 1.0004999, 0.0)] == [0.001, -0.001, 0.003, 1.0, 0.0]


def test_untrained_scores_tie_to_the_largest_class():
    assert Perceptron(classes=["A", "C", "B"]).predict(["bias"]) == "C"
    assert Perceptron().predict(["bias"]) == ""


def test_sentinels():
    f = features(["x-", "yz"], 0, "-START-", "-START2-")
    assert f[0] == "bias" and f[3:5] == ["i-1 word's first char -"] + ["i-1 word's final char -"]
    assert f[9:11] == ["i+1 word's first char y", "i+1 word's final char z"] and f[11] == "i+2 word's first char -"
    assert features([""], 0, "p", "q")[1:3] == ["i word's first char ", "i word's final char "]


def test_averaging_drops_zeros_and_keeps_the_feature():
    m = Perceptron(classes=["A", "B"])
    m.update("A", "B", ["f"])
    m.update("B", "A", ["f"])
    m.weights["f"] = {"A": 0.0, "B": 0.0}
    m.totals = {}
    m.stamps = {("f", "A"): 2, ("f", "B"): 2}
    m.average()
    assert m.weights == {"f": {}} and m.i == 2
    fresh = Perceptron({"f": {"A": 1.0}}, ["A"])
    fresh.average()  # no instance: nothing to average
    assert fresh.weights == {"f": {"A": 1.0}}


def test_tagdict_thresholds_and_ties():
    sents = [[("a", "X")] * 3 + [("a", "Y"), ("b", "X"), ("c", "P"), ("c", "Q")]]
    assert make_tagdict(sents, 4, 0.75) == ({"a": "X"}, {"X", "Y", "P", "Q"})
    assert make_tagdict(sents, 2, 0.5)[0] == {"a": "X", "c": "Q"}


def slow_weights(sents, tagdict, classes):
    """One pass with weights summed over every instance, without lazy totals."""
    w, total, n = {}, {}, 0
    for sent in sents:
        words, tags = [x for x, _ in sent], []
        for i, (word, gold) in enumerate(sent):
            if word in tagdict:
                tags.append(tagdict[word])
                continue
            prev = tags[-1] if tags else "-START-"
            prev2 = tags[-2] if len(tags) > 1 else "-START-" if tags else "-START2-"
            feats = features(words, i, prev, prev2)
            score = {c: sum(w.get((f, c), 0) for f in feats) for c in classes}
            guess = max(classes, key=lambda c: (score[c], c))
            for key, x in w.items():
                total[key] = total.get(key, 0) + x
            n += 1
            if guess != gold:
                for f in feats:
                    w[f, gold] = w.get((f, gold), 0) + 1
                    w[f, guess] = w.get((f, guess), 0) - 1
            tags.append(guess)
    # the first instance's weights count from the next on, the last ones not at all
    return {key: round3(total.get(key, 0) / n) for key in w if round3(total.get(key, 0) / n)}


def test_training_equals_a_slow_version():
    rng = random.Random(5)
    sents = [[(rng.choice(["the", "cat", "runs", "x.", "Ann", "is"]), rng.choice("NVDP")) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    tagdict, tags = make_tagdict(sents, 20, 0.35)
    m = Perceptron(classes=tags)
    train_pass(m, tagdict, sents)
    raw = {f: dict(own) for f, own in m.weights.items()}
    assert all(sum(own.values()) == 0 and all(x == int(x) for x in own.values()) for own in raw.values())
    m.average()
    assert {(f, c): x for f, own in m.weights.items() for c, x in own.items()} == slow_weights(sents, tagdict, sorted(tags))
    assert len(tag_words(["the", "zzz"], m, tagdict)) == 2


def test_list_tagger_round_trip(tmp_path):
    t = AveragedPerceptronTagger(frequency_threshold=1, ambiguity_threshold=0.9, n_iter=2, seed=1)
    assert t.classes == set() and t.tagdict == {} and t.weights == {} and t.tag([]) == []
    t.train([[("dogs", "N"), ("bark", "V")], [("cats", "N"), ("sleep", "V")], [("bark", "N"), ("hurts", "V")]])
    assert t.tagdict["dogs"] == "N" and "bark" not in t.tagdict and t.classes == {"N", "V"}
    assert t.tag(["dogs", "sleep"]) == ["N", "V"]
    path = str(tmp_path / "m.json")
    t.save(path)
    other = AveragedPerceptronTagger()
    other.load(path)
    assert (other.weights, other.tagdict, other.classes) == (t.weights, t.tagdict, t.classes)
    assert other.tag(["bark", "dogs"]) == t.tag(["bark", "dogs"])
    before = set(t.tagdict)
    t.train([[("new", "A")]])
    assert before < set(t.tagdict) and t.classes == {"N", "V", "A"}


@pytest.mark.parametrize(
    ("content", "error"),
    [("{", OSError), ('{"weights": 3}', ValueError), ('{"weights": {"f": {"c": "x"}}}', ValueError), ('{"tagdict": {"a": 1}}', ValueError), ('{"classes": {}}', ValueError)],
)
def test_bad_model_files(tmp_path, content, error):
    t = AveragedPerceptronTagger(frequency_threshold=1, n_iter=1)
    t.train([[("a", "X")]])
    path = tmp_path / "m.json"
    path.write_text(content)
    with pytest.raises(error):
        t.load(str(path))
    assert t.tagdict == {"a": "X"}


def test_missing_keys_and_files(tmp_path):
    t = AveragedPerceptronTagger(frequency_threshold=1, n_iter=1)
    t.train([[("a", "X")]])
    for content in ("[1]", "{}", '{"classes": ["X", "Y"]}'):
        (tmp_path / "m.json").write_text(content)
        t.load(str(tmp_path / "m.json"))
        assert t.tagdict == {"a": "X"}
    assert t.classes == {"X", "Y"}
    with pytest.raises(FileNotFoundError, match="Can't locate tagger model"):
        t.load(str(tmp_path / "none.json"))
    with pytest.raises(OSError, match="Failed to create file"):
        t.save(str(tmp_path / "no" / "m.json"))


@given(st.text(alphabet="abc日😀", max_size=30), st.sets(st.text(alphabet="abc日😀", min_size=1, max_size=6), max_size=12), st.integers(2, 6))
def test_greedy_by_heads_is_the_same(text, words, longest):
    assert Greedy(words, longest).cut(text) == segment_greedy(text, {w for w in words if len(w) > 1}, longest)


def test_scorer_is_the_same_to_the_last_bit():
    """Weights whose sums depend on their order, words that are empty or in the dictionary, ties, no classes."""
    rng = random.Random(4)
    tags, chars = ["A", "B", "C", "日"], ["a", "b", "日", "-", ""]
    words = [x + y for x in chars for y in chars]
    model = Perceptron(classes=tags)
    for _ in range(400):
        w = rng.choices(words, k=rng.randint(1, 5))
        for f in features(w, rng.randrange(len(w)), rng.choice(tags), rng.choice(tags)):
            model.weights.setdefault(f, {})[rng.choice([*tags, "gone"])] = rng.choice([0.1, 0.2, 0.3, -0.3, 1.7, 1e-17])
    scorer, tagdict = Scorer(model.weights, tags), {"ab": "X", "ba": "A"}
    sents = [rng.choices(words, k=rng.randint(0, 7)) for _ in range(400)]
    expected = [tag_words(w, model, tagdict) for w in sents]
    assert [scorer.tag(w, tagdict) for w in sents] == expected
    batch = pa.array([None, *sents, None], pa.list_(pa.string()))
    tagger = BatchTagger(model.weights, tagdict, tags)
    assert tagger.tag(batch).to_pylist() == [None, *expected, None]
    assert tagger.tag(batch.slice(5, 100)).to_pylist() == expected[4:104]
    tagger.TOKENS = 7
    assert tagger.tag(batch).to_pylist() == [None, *expected, None]
    assert BatchTagger({}, {"ab": "X"}, ()).tag(pa.array([["a", "ab"], []])).to_pylist() == [["", "X"], []]
    assert BatchTagger({}, {}, ()).tag(pa.array([[], None], pa.list_(pa.string()))).to_pylist() == [[], None]
    assert Scorer({}, ()).tag(["a", "ab"], tagdict) == tag_words(["a", "ab"], Perceptron(), tagdict) == ["", "X"]


@given(st.lists(st.none() | st.text("ab é日😀\0\n", max_size=30), max_size=8), st.integers(0, 1 << 32))
def test_cutter_equals_a_plain_version(texts, below):
    def plain(t, prefix):
        draw = lambda p: int(hashlib.md5(prefix + b"%d" % (p // 4)).hexdigest()[p % 4 * 8 :][:8], 16)
        cuts = [0, *(p for p in range(1, len(t)) if draw(p) < below), len(t)]
        return [t[a:b] for a, b in zip(cuts, cuts[1:])] if t else []

    keys = [b"7|%d|" % i for i in range(len(texts))]
    assert Cutter(below).cut(pa.array(texts, pa.string()), keys).to_pylist() == [None if t is None else plain(t, k) for t, k in zip(texts, keys)]


def test_batches_are_handled_in_slices(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE_BYTES", 10)
    texts = pa.array(["abc", None, "", "日本語", "x" * 50, "ab", "c"])
    found = [texts[at].to_pylist() for at in kernels.slices(texts)]
    assert [t for part in found for t in part] == texts.to_pylist() and found == [["abc", None, ""], ["日本語"], ["x" * 50], ["ab", "c"]]
    assert [*kernels.slices(texts[:0])] == []


def test_segmenters_hold_no_more_than_a_slice(spark, monkeypatch):
    from lexigrid.operators.segment import segmenter

    monkeypatch.setattr(kernels, "SLICE_BYTES", 10)
    words = type("Shared", (), {"value": frozenset({"ab"})})
    parts = [*segmenter(words, 2).func(iter([pa.array(["abc", None, "", "cab" * 9, "ab"])]))]
    assert len(parts) > 1 and [w for p in parts for w in p.to_pylist()] == [["ab", "c"], None, [], ["c", "ab"] * 9, ["ab"]]
