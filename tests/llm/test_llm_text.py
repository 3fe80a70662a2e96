"""Row-local operators and what their workers run, against the libraries and plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexigrid.llm import bpe, langid, records, suffix_dedup, token_count, winnow

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "é", "'", "'s", "s", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "1", "²", "<|endoftext|>", "<|", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "!", "日", "😀", "re", "ll", "Zq", "\x00", "ß", "́", "\r\n", "—", "the", " the", "ation"]


def strings(n, longest=14, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", "a" * 5000, " " * 700, "日本" * 900, "qx" * 800]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "Hello, world's end", "x", 1), (1, None, "x", 2), (2, "", None, 3), (None, "日本 <|endoftext|> ok", "y", 4), (0, "Hello, world's end", "x", 5), (7, "word " * 40_000, "y", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_codec_equals_the_library():
    lib, own = Tokenizer.from_file(BYTE_BPE), bpe.Codec(BYTE_BPE, memo=50)
    texts = strings(2500)
    data = [t.encode() for t in texts]
    got = own.encode_all(b"".join(data), np.cumsum([0, *map(len, data)]))
    for t, ids in zip(texts, got):
        expected = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, t
        assert own.decode(ids) == lib.decode(expected, skip_special_tokens=False)
    cut = np.array([0, 200, 50_256, 30_000], "<u4").tobytes()
    assert own.decode(cut) == lib.decode([0, 200, 50_256, 30_000], skip_special_tokens=False)


def test_codec_handles_a_slice_in_blocks(monkeypatch):
    own = bpe.Codec(BYTE_BPE)
    texts = ["", *strings(300, seed=3), ""]
    data = [t.encode() for t in texts]
    whole = own.encode_all(b"".join(data), np.cumsum([0, *map(len, data)]))
    for block in (1, 7):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert own.encode_all(b"".join(data), np.cumsum([0, *map(len, data)])) == whole
    monkeypatch.undo()
    slice_ = b"a few short words " * (2**22 // 18)
    tracemalloc.start()
    own.encode_all(slice_, np.array([0, len(slice_)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_bpe_operator(spark, docs):
    lib = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.digest(bpe.encode(docs, BYTE_BPE, decoded=True)).collect():
        text = {0: "Hello, world's end", 7: "word " * 40_000, None: "日本 <|endoftext|> ok"}.get(r.doc_id, "")
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs, BYTE_BPE).count() == 6 and bpe.encode(docs.limit(0), BYTE_BPE).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id = 0").withColumnRenamed("ids", "other"), BYTE_BPE), BYTE_BPE)
    assert {r.decoded for r in back.collect()} == {"Hello, world's end"}


def test_counter_equals_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_count.Counter(PIECES, memo=300)
    texts = strings(2500, seed=1)
    assert own.count(texts) == [len(x) for x in lib.encode(texts)]
    rng = random.Random(2)
    long = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 700))) for letters in ("abcdeéinthst日", ["in", "the", "re", "st", "ation", "a"], "日本的一是不") for _ in range(60)]
    assert own.count(long) == [len(x) for x in lib.encode(long)]


def test_merges_wait_for_pairs_that_come_first():
    """A made piece may take part in a merge of a lower rank, which then comes before its pair's other places."""

    class Toy(token_count.Counter):
        def __init__(self):
            a, b, ab, aba, abab = range(5)
            merges = {(a, b): (5, ab), (ab, a): (3, aba), (ab, ab): (1, abab), (aba, b): (9, abab)}
            at = sorted(merges)
            self.keys, self.rank, self.new = (np.array(x, np.int64) for x in ([(p << 32) | q for p, q in at], [merges[p][0] for p in at], [merges[p][1] for p in at]))
            self.safe, self.char = np.array([False, True, True, True]), {"a": a, "b": b}
            self.table = merges

        def plain(self, word):
            s = [self.char[c] for c in word]
            while found := [(self.table[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in self.table]:
                _, i = min(found)
                s[i : i + 2] = [self.table[s[i], s[i + 1]][1]]
            return len(s)

    toy, rng = Toy(), random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["abab" * 9]
    assert toy._synchronous(words).tolist() == [toy.plain(w) for w in words]


def test_count_operator(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_count.count_tokens(docs, PIECES).collect()
    assert len(got) == 6 and token_count.count_tokens(docs.limit(0), PIECES).count() == 0
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got}[7] == (200_000, len(lib.encode("word " * 40_000)))
    assert {(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (1, 2)} == {(0, 0)}


def test_records_round_trip(spark, docs, tmp_path):
    lib = Tokenizer.from_file(BYTE_BPE)
    manifest = records.write_records(docs, f"file://{tmp_path}/out", BYTE_BPE, end_id=2, shards=3).cache()
    got = sorted(records.read_records(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 0, 1, 2, 7]
    start = 0
    for r in got:
        text = {0: "Hello, world's end", 7: "word " * 40_000, None: "日本 <|endoftext|> ok"}.get(r.doc_id, "")
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += r.n_tokens
    path = max(manifest.collect(), key=lambda r: r.n_docs).path
    shuffled = list(records.read_shuffled(path, seed=3))
    in_order = {(i, x.tobytes()) for i, x in shuffled}
    assert in_order <= {(r.doc_id, r.ids) for r in got} and len(shuffled) == max(r.n_docs for r in manifest.collect())
    where = path.removeprefix("file://") + ".rec"
    data = bytearray(open(where, "rb").read())
    data[30] ^= 1
    open(where, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(records.read_shuffled(path, seed=3))
    empty = records.write_records(docs.limit(0), f"file://{tmp_path}/none", BYTE_BPE).cache()
    assert records.read_records(spark, empty).count() == 0
    assert records.masked(zlib.crc32(b"x")) != zlib.crc32(b"x")


def test_language_id_learns_and_keeps_its_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "123 !?", "en", "s", 0), (None, "the of and", None, "s", 0), (900_003, "", "fr", "s", 0)], docs.schema)
    both = docs.unionByName(odd).withColumn("score", docs.doc_id)
    model = langid.fit(both, per_lang=60, steps=120)
    got = langid.predict(both, model).collect()
    assert len(got) == both.count()
    gold = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 20
    assert sum(r.lang_pred == gold.get(r.doc_id) for r in held if r.doc_id in gold) / sum(r.doc_id in gold for r in held) > 0.95
    und = {r.doc_id: (r.lang_pred, r.score) for r in got if r.lang_pred == "und"}
    assert und == {900_001: ("und", 0.0), 900_002: ("und", 0.0), 900_003: ("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_known(both, model)
    assert kept.columns == both.columns and 900_002 not in {r.doc_id for r in kept.select("doc_id").collect()} and kept.count() > 190
    bare = langid.fit(docs.limit(0))
    assert bare.langs == [] and {r.lang_pred for r in langid.predict(odd, bare).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    m = langid.train([b"abc def" * 9, b"xyz" * 30], ["a", "b"], hidden=3, steps=2, batch=4, stretch=12)
    for c in (m.forward, m.backward):
        c.x, c.u = c.x.astype(np.float64), c.u.astype(np.float64)
    m.v = m.v.astype(np.float64)
    block, mask, gold = rng.integers(97, 105, (7, 3)).astype(np.uint8), np.ones((7, 3)), np.array([0, 1, 0])
    mask[5:, 1] = 0

    def loss():
        states = []
        for cell, order in ((m.forward, range(7)), (m.backward, range(6, -1, -1))):
            h, at = np.zeros((3, 3)), {}
            for t in order:
                h = at[t] = cell.step(block[t], h)[0] * mask[t]
            states.append(at)
        total = 0.0
        for t in range(7):
            p = np.exp(m.v @ np.vstack([states[0][t], states[1][t]]) + m.b)
            total -= (np.log((p / p.sum(axis=0))[gold, np.arange(3)]) * mask[t]).sum()
        return total / mask.sum()

    grad = langid.gradient(m, block, mask, gold)
    for name, x, i in (("u0", m.forward.u, (1, 2)), ("u1", m.backward.u, (4, 0)), ("x0", m.forward.x, (4, int(block[2, 0]))), ("v", m.v, (0, 1))):
        old = x[i]
        x[i] = old + 1e-4
        up = loss()
        x[i] = old - 1e-4
        down = loss()
        x[i] = old
        assert abs((up - down) / 2e-4 - grad[name][i]) < 1e-6


def plain_probabilities(m, text):
    """The network straight from its definition, one byte after another."""
    k = m.forward.u.shape[1]
    s = lambda x: 1 / (1 + np.exp(-x))

    def states(cell, data):
        h, out = np.zeros(k), []
        for byte in data:
            x, a = cell.x[:, byte].astype(float), cell.u.astype(float) @ h
            z, r = s(x[:k] + a[:k]), s(x[k : 2 * k] + a[k : 2 * k])
            n = np.tanh(x[2 * k :] + r * a[2 * k :])
            h = z * h + (1 - z) * n
            out.append(h)
        return out

    total = np.zeros(len(m.langs))
    for i in range(0, len(text), langid.STRETCH):
        part = text[i : i + langid.STRETCH]
        for f, b in zip(states(m.forward, part), states(m.backward, part[::-1])[::-1]):
            p = np.exp(m.v.astype(float) @ np.r_[f, b] + m.b[:, 0])
            total += p / p.sum()
    return total / len(text)


def test_predictions_equal_a_plain_forward_pass():
    m = langid.train([b"aaaa bbb", b"xyxy zz", b"qqq"] * 3, ["a", "x", "q"], steps=30, batch=16, stretch=8)
    texts = [b"aab", b"zz xy" * 60, b"q", bytes(range(256))]
    got = m.predict(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    for p, t in zip(got, texts):
        assert np.allclose(p, plain_probabilities(m, t), atol=1e-4)
    m.b[:] = [[5e4], [0], [-5e4]]
    sure = m.predict(b"abc", np.array([0, 3]))[0]
    assert np.allclose(sure, [1, 0, 0])


def test_all_languages_are_learned_and_numbers_are_no_letters(spark):
    rng = random.Random(0)
    rows = [(i, "".join(chr(0x4E00 + 40 * (i % 70) + rng.randrange(6)) for _ in range(40)), f"l{i % 70:02d}") for i in range(70 * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, steps=25)
    assert len(model.langs) == 70 and model.forward.u.shape[1] > 6
    odd = spark.createDataFrame([(1, "²½Ⅷ①"), (2, "²½Ⅷ①ª"), (3, "_"), (4, "๑๒")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, False, True, True]
    with pytest.raises(ValueError, match="languages"):
        langid.fit(df, most=60)


def test_prediction_is_over_whole_texts():
    m = langid.train([b"aaaa bbb", b"xyxy zz"] * 3, ["a", "x"], steps=60, batch=16, stretch=8)
    texts = [b"", b"aab" * 300, b"xyz", b"a" * 129]
    p = m.predict(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    assert p[0].sum() == 0 and np.allclose(p[1:].sum(axis=1), 1, atol=1e-4)
    alone = [m.predict(t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(p, alone, atol=1e-4)


@pytest.mark.parametrize("length", [2, 5, 9, 40, 130])
def test_block_sorter_finds_all_repeats(length):
    rng = random.Random(length)
    for n in (length, length * 3, 700):
        for letters in (b"a", b"ab", b"abcdefgh"):
            base = bytes(rng.choice(letters) for _ in range(n))
            data = base + bytes(rng.choice(letters) for _ in range(n // 2)) + base[n // 3 :] + b"\xff" * length
            at = np.array(sorted(rng.sample(range(len(data) - length + 1), min(len(data) - length + 1, 400))))
            seen = Counter(data[i : i + length] for i in at.tolist())
            assert suffix_dedup.BlockSorter(length).classes(data, at).tolist() == [seen[data[i : i + length]] > 1 for i in at.tolist()]


def test_covers_meet_every_difference():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_anchors_depend_on_the_window_alone(monkeypatch):
    monkeypatch.setattr(winnow, "PART", 64)
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(500)) * 2
    for kind, text in ((winnow.ByteText, data), (winnow.WordText, re.sub(b"(.)", rb"\1  ", data))):
        t = kind(text)
        a, lo, hi, g = winnow.anchors(t, 4, 20)
        of = {}
        for x, l, h, y in zip(*(v.tolist() for v in (a, lo, hi, g))):
            for o in range(l, h + 1):
                of[x - o] = (o, y)
        assert sorted(of) == list(range(t.n - 19))
        seen = {}
        for p, anchor in of.items():
            assert seen.setdefault(b" ".join(t.text(p, p + 20).split()), anchor) == anchor


def test_keep_known_is_relative_to_the_number_of_languages(spark):
    """Of 40 languages, 0.29 for one is clear; an even share of each isn't."""

    class Model:
        langs = [f"l{i}" for i in range(40)]

        def predict(self, data, at):
            import numpy as np

            out = np.full((len(at) - 1, 40), 0.025)
            for i, (a, b) in enumerate(zip(at, at[1:])):
                if data[a:b] == b"clear":
                    out[i], out[i, 3] = 0.71 / 39, 0.29
            return out

    docs = spark.createDataFrame([(1, "clear"), (2, "even"), (3, None), (4, "1 2")], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_known(docs, Model()).collect()] == [1]
    assert langid.keep_known(docs, Model(), min_score=0.3).count() == 0


def test_registered_queries_equal_the_libraries_on_the_whole_table(spark, sf):
    from lexigrid.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib, pieces = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {d: lib.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    digest = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    got = {tuple(r) for r in queries.op3_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(d, len(x), digest(x), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    expected, start = set(), 0
    for d in sorted(ids):
        x = [*ids[d], 2]
        expected.add((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert {tuple(r) for r in queries.op9_token_records(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == expected
    counts = {d: len(pieces.encode(t)) for d, t in texts.items()}
    got = {tuple(r) for r in queries.op10_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {(d, len(t.encode()), counts[d], counts[d] > 4096) for d, t in texts.items()}


def test_registered_language_id(spark, sf):
    """Held-out accuracy over the whole table; `und` just where no letter is; nothing held out is learned from."""
    from lexigrid.llm import queries

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang is not None]
    assert {r.doc_id for r in got if r.held_out} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got)
