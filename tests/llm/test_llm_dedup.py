"""Deduplication, mixing and the pipeline against plain versions."""

import hashlib
import os
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexigrid.llm import embed_dedup, exact_dedup, minhash, mixing, queries, substring_dedup, suffix_dedup  # noqa: E402
from lexigrid.llm.common import Scratch, lookup  # noqa: E402
from lexigrid.llm.components import components  # noqa: E402


def passages(seed=0):
    """Texts that share passages in all ways: copies, near copies, periods, one that many have."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = common[rng.randint(0, 8) : rng.randint(20, 30)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, "x y " * 80), (201, "x y " * 50), (202, "z" * 900), (203, ""), (204, None), (None, rows[1][1]), (None, None)]
    rows += [rows[3], (5, "a text of its own under an id that is there already " * 2)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """With other columns named as ours are inside."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n long, key string, d long").repartition(3)


@pytest.mark.parametrize("many", [20_000, 2])
def test_suffix_dedup(spark, many):
    rows = passages()
    out = suffix_dedup.suffix_dedup(frame(spark, rows), length=24, many=many).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out), key=order)
    assert got == sorted(brute.suffix(rows, 24), key=order)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("many", [20_000, 2])
def test_substring_dedup(spark, many):
    rows = passages(1)
    out = substring_dedup.substring_dedup(frame(spark, rows), length=6, many=many).collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out), key=order)
    assert got == sorted(brute.substring(rows, 6), key=order)


def test_repeated_rows_cost_no_more_than_their_number(spark):
    """5000 rows of one text, with and without ids; the least id there is is one."""
    text = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(90))
    rows = [(None, text)] * 2500 + [(7, text)] * 2500 + [(-(1 << 63), other), (-(1 << 63), other), (9, "new " + other), (None, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    a, b = len(text), len(other)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r["count"]) for r in suffix_dedup.suffix_dedup(df).groupBy("doc_id", "n_bytes", "n_removed").count().collect()}
    assert got == {(None, a, a, 2500), (7, a, a, 2500), (-(1 << 63), b, 0, 2), (9, b + 4, 0, 1), (None, b, 0, 1)}
    got = {(r.doc_id, r.n_words, r.n_removed, r["count"]) for r in substring_dedup.substring_dedup(df).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert got == {(None, 400, 0, 2500), (7, 400, 0, 2500), (-(1 << 63), 90, 0, 2), (9, 91, 90, 1), (None, 90, 0, 1)}


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:30_000] + ["x"] + words[30_000:])), (3, "q" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {1: 0, 2: 60_000, 3: 0}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got[1][0] == got[1][1] and got[2][0] - got[2][1] in (1, 2, 3) and got[3] == (500_000, 500_000)
    assert {r.doc_id: r.class_id for r in minhash.near_dedup(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_tables(spark):
    none = frame(spark, passages()[:1]).limit(0)
    assert suffix_dedup.suffix_dedup(none, length=24).count() == 0
    assert substring_dedup.substring_dedup(none, length=6).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash.near_dedup(none).count() == 0
    assert mixing.mixture(none.withColumn("source", none.key)).count() == 0


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_dedup(spark, key_bits):
    """With keys of 3 bits nearly all texts share one with others, so only the comparison in chains parts them."""
    rows = [*passages(2), (300, "A  b\t c"), (301, "A b c"), (302, " A b c"), (303, "A b c"), (304, "A b c\x00"), (305, "é" * 70_000), (306, "é" * 70_000)]
    rows = rows if key_bits == 64 else rows[:9] + rows[-7:]
    out = exact_dedup.exact_dedup(frame(spark, rows), capacity=4, key_bits=key_bits).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    expected = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out))) == sorted(map(repr, expected))
    assert len({r.bucket for r in out}) > (4 if key_bits == 64 else 1)
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "key", "d"]
    assert {r.doc_id for r in kept.collect()} - {None} == {k for _, k, *_ in expected} - {None}


def test_chains_decide(spark, monkeypatch):
    """Were the texts of a key not compared, all of them would be one group."""
    rows = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    assert {r.group_size for r in exact_dedup.exact_dedup(rows, key_bits=1).collect()} == {4}
    monkeypatch.setattr(exact_dedup, "chains", lambda texts, several, scratch: several.selectExpr("bucket", "depth", "key", "1 as chain", "'' as text_sha256", "keep_id", "group_size"))
    assert {r.group_size for r in exact_dedup.exact_dedup(rows, key_bits=1).collect()} != {4}


def test_directory_splits_overfull_buckets(spark):
    top = lambda *bits: (int("".join(map(str, bits)).ljust(64, "0"), 2) + (1 << 63)) % (1 << 64) - (1 << 63)
    some = [top(0, 0, 0, 0) + i for i in range(3)] + [top(0, 0, 0, 1) + i for i in range(3)] + [top(0, 1), top(1, 0), top(1, 1)]
    keys = spark.createDataFrame([(k,) for k in some], "key long")
    book, bits = exact_dedup.directory(keys, Scratch(spark, "test"), capacity=4)
    got = {r.key: (r.bucket >> (bits - 4), r.depth) for r in exact_dedup.in_bucket(keys, book, bits).collect()}
    assert len(got) == len(some) and got[some[0]] == (0, 4) and got[some[3]] == (1, 4) and got[top(0, 1)] == (4, 2) and got[top(1, 0)] == got[top(1, 1)] == (8, 1)
    book, bits = exact_dedup.directory(spark.createDataFrame([(top(1) + i,) for i in range(40)], "key long"), Scratch(spark, "test"), capacity=1)
    assert bits == 62 and book.count() == 10  # keys that agree in so many bits share a cell
    book, _ = exact_dedup.directory(keys.limit(0), Scratch(spark, "test"))
    assert book.count() == 0


def plain_classes(texts, threshold, ratio):
    """doc_id -> least doc_id reached by links, over all pairs of shingle sets."""
    sets = {}
    for d, t in texts:
        w = re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower()).strip(" ").split(" ")
        if w != [""] and d is not None:
            sets.setdefault(d, set()).update({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)})
    least = {d: d for d, _ in texts}
    for _ in texts:
        for a in sets:
            for b in sets:
                small, large = sorted((len(sets[a]), len(sets[b])))
                if large <= ratio * small and len(sets[a] & sets[b]) >= threshold * small - 1e-9:
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[d]] == least[d] for d in sets):
            break
    return least


@pytest.mark.parametrize("small", [24, 2])
def test_near_dedup(spark, small):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 80))]
        for j in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(len(w))] = f"e{rng.randrange(5000)}"
            rows.append((i * 10 + j, " ".join(w)))
    rows += [(200, "one two"), (201, "One  two"), (202, "three"), (203, ""), (204, None), (None, "one two"), (300, rows[0][1]), (300, rows[0][1])]
    out = minhash.near_dedup(frame(spark, rows), small=small).collect()
    got = {r.doc_id: (r.class_id, r.kept) for r in out}
    expected = plain_classes(rows, 0.6, 1.25)
    assert got == {d: (c, d is None or d == c) for d, c in expected.items()} and len(out) == len(expected)
    assert all(r.n_links > 0 or r.class_id == r.set_id for r in out)


@pytest.mark.parametrize("options", [{}, {"block": 1}])
def test_large_buckets_link_members_of_different_leaders(spark, options):
    """1 - 3 - 4 - 2 is a chain in one bucket; of 1 and 2, the first, neither is linked with both 3 and 4."""
    starts = {1: 0, 3: 30, 4: 60, 2: 90}
    docs = spark.createDataFrame([(d, " ".join(f"w{i}" for i in range(a, a + 102))) for d, a in starts.items()], "doc_id long, text string")
    keys = spark.createDataFrame([(7, d, 100) for d in starts], "key long, node long, n long")
    scratch = Scratch(spark, "test")
    sets = minhash.shingles(docs).selectExpr("doc_id as node", "100L as n", "shingles as s")
    keys, sets = scratch.table(keys, "given"), scratch.table(sets, "sets")
    found = minhash.linked(keys, sets, scratch, 0.6, 1.25, small=2, **options).collect()
    assert sorted((r.x, r.y, r.both) for r in found) == [(1, 3, 70), (2, 4, 70), (3, 4, 70)]


def test_links_of_a_large_group_are_all_counted(spark):
    """40 near copies, no two equal, are more than SMALL in their buckets; each is linked with all others."""
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join([*base[: 4 * d], f"e{d}", *base[4 * d + 1 :]])) for d in range(40)]
    out = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in out} == {(d, 0, 39) for d in range(40)}


def plain_links(texts, threshold=0.6):
    """(smaller set's doc_id, larger's, their sizes) of all linked pairs of different sets."""
    sets = {}
    for d, t in sorted((d, t) for d, t in texts if d is not None):
        w = re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").lower()).strip(" ").split(" ")
        if w != [""]:
            sets.setdefault(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]), d)
    holders = {}
    for s in sets:
        for x in s:
            holders.setdefault(x, []).append(s)
    out = set()
    for a in sets:
        for b, both in Counter(b for x in a for b in holders[x]).items():
            if (len(a), sets[a]) < (len(b), sets[b]) and both >= threshold * len(a) - 1e-9:
                out.add((sets[a], sets[b], len(a), len(b)))
    return out


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_all_links_of_a_table_are_found_at_any_ratio_of_sizes(spark, sf, folder):
    docs = spark.read.parquet(f"{os.path.dirname(sf)}/{folder}/documents.parquet").select("doc_id", "text")
    expected = plain_links([tuple(r) for r in docs.collect()])
    _, _, close, wide, twins = minhash.all_links(docs, Scratch(spark, "recall"), 0.6, 1.25)
    links = close.select("x", "y").union(twins.join(wide, "x").select("node", "y"))
    got = {tuple(sorted((r.x, r.y))) for r in links.collect()}
    near = {tuple(sorted(x[:2])) for x in expected if x[3] <= 1.25 * x[2]}
    far = {tuple(sorted(x[:2])) for x in expected} - near
    assert got <= near | far and len(got) == links.count()
    assert len(got & near) >= 0.95 * len(near) and got & far == far and len(far) > 10


def test_a_short_document_in_many_long_ones_is_named_but_joins_no_class(spark):
    """A tenth of a long document is a hot passage, which is also a document of its own."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage[:36]]))]
    rows += [(d, " ".join([f"e{d}", *passage[30:40]])) for d in (3, 4)]  # one size and the same shared shingles
    rows += [(10 + i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(200)), *passage, *(f"w{rng.randrange(10**6)}" for _ in range(160))])) for i in range(60)]
    out = {r.doc_id: r for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_links, out[1].container_id, out[1].class_id, out[2].class_id) == (63, 10, 1, 1)
    assert out[3].n_links == out[4].n_links == 62 and out[4].class_id == 3 and out[4].container_id == 1
    assert all(out[d].kept and out[d].n_links == 4 and out[d].container_id is None for d in out if d >= 10)


def test_banding_is_tuned_to_the_sizes():
    bounds = minhash.size_bounds(1.5)
    assert all(b > a for a, b in zip(bounds, bounds[1:]))
    strict, loose = minhash.tuned(bounds, 0.95, 1.05), minhash.tuned(bounds, 0.5, 2.0)
    assert strict[20][1] > loose[20][1]
    for s in (0.2, 0.5, 0.9):
        bands, rows = minhash.banding(s)
        assert bands * rows <= minhash.SIDE and 1 - (1 - s**rows) ** (bands * minhash.PARTS) >= minhash.LEAST


def test_embed_dedup(spark):
    rng = np.random.default_rng(0)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(90):
        rows.append((i, (base[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.25])).astype(np.float32).tolist(), i % 2))
    rows += [(100 + i, rows[4][1], 0) for i in range(5)] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [1.0] * 15 + [None], 0), (203, [float("nan")] * 16, 0), (204, rows[4][1], None), (None, rows[4][1], 0), (205, [], 1), (206, rows[4][1][:8], 0)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, n long, rep long")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: (lab, len(v or [])) for i, v, lab in rows}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93} for i in unit}
    least = {i: i for i, *_ in rows}
    for _ in rows:
        for i, near in links.items():
            for j in near:
                least[i] = least[j] = min(least[i], least[j])
    for block in (1024, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embed_dedup(df, block=block, recall=0.999999).collect()}
        assert got == {i: (len(links.get(i, ())), c, i == c) for i, c in least.items()}
    assert embed_dedup.embed_dedup(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 60), (101, 60), (102, 101), (7, 7), (60, 100)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 60 for i in (60, 100, 101, 102)} | {i: 200 for i in range(200, 231)}


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(600)] + [(k, k) for k in range(2, 90)], "k int, x int")
    unique = spark.createDataFrame([(1, 600, "hot")] + [(k, 1, "c") for k in range(2, 50)], "k int, n int, v string")
    got = lookup(rows, unique, ["k"], "n", 688)
    assert got.count() == 688 and got.where("v = 'hot'").count() == 600 and got.where("v is null").count() == 40
    assert lookup(rows, unique, ["k"], "n", 688, inner=True).count() == 648


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(400)] + [(7, "w w", "a"), (None, None, "d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, block int")
    out = mixing.mixture(df, block=16).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"a", "b", "c", "", "d"} and by["d"][0].repeats == 1
    for s, own in by.items():
        quota, spent = own[0].quota, sum(r.repeats * r.n_tokens for r in own)
        assert s == "d" or (quota - max(r.n_tokens for r in own) <= spent <= quota and min(r.repeats for r in own) >= 1 and max(r.repeats for r in own) <= 5)
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    weights = np.array([own[0].weight for s, own in by.items() if s != "d"])
    assert abs(weights.sum() - 1) < 1e-6
    entropy = -(weights * np.log(weights)).sum() / np.log(len(weights))
    most = max(max(r.repeats for r in own) for own in by.values())
    assert abs(entropy - 0.95) < 1e-3 or most >= 4
    few = mixing.mixture(df, budget=500).collect()
    assert sum(r.repeats * r.n_tokens for r in few) <= 502 and min(r.repeats for r in few) == 0
    kept = mixing.mix(df)
    assert kept.columns == df.columns and kept.count() == sum(r.repeats for r in out)


def test_mix_keeps_to_its_budget_with_repeated_and_null_ids(spark):
    rows = [(7 if i % 2 else None, f"{i} " * (1 + i % 5), "a" if i % 3 else "b", i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, key int")
    for budget in (100, 700, 2500):
        drawn = mixing.mixture(df, budget=budget).collect()
        mixed = mixing.mix(df, budget=budget).collect()
        assert sum(r.n_tokens * r.repeats for r in drawn) == sum(len(r.text.split()) for r in mixed) <= budget + 1
    assert mixing.mix(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "w", "b"), (3, None, None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_tokens for r in mixing.mixture(long).collect()} == {1: 400_000, 2: 1, 3: 0}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    ours = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    rel = con.sql(queries.ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert ours == sorted(map(repr, (tuple(r[i] for i in order) for r in rel.fetchall())))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "1 2", None, None, 0), (900_003, docs.where("doc_id = 3").first().text, "fr", None, 0), (None, "some words of no id", "en", "src1", 0)], docs.schema)
    now, names = docs.unionByName(odd), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_copies", "near_duplicates", "source_mixture", "token_ids"]
    scratch, seen = Scratch(spark, "stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.table(stage(spark, now, sf), name)
        seen[name] = now
        if name != "token_ids":
            assert now.columns == docs.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["language_id"].isdisjoint({900_001, 900_002}) and None in ids["language_id"]
    texts = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in seen["language_id"].collect() if r.doc_id is not None}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert ids["exact_copies"] == set(first.values()) | {None}
    least = plain_classes([(r.doc_id, r.text) for r in seen["exact_copies"].where("doc_id is not null and length(text) < 1500").collect()], 0.6, 1.25)
    assert {d for d, c in least.items() if d == c} >= {d for d in ids["near_duplicates"] if d in least}
    assert ids["source_mixture"] == ids["near_duplicates"] == ids["token_ids"]
    assert seen["token_ids"].count() == seen["source_mixture"].count()
    assert all(len(r.ids) == 4 * r.n_tokens for r in seen["token_ids"].collect())


def test_embeddings_of_two_labels_never_share_a_bucket(spark, monkeypatch):
    """Also not where all buckets have one hash; vectors of other lengths don't meet either. Recall is that of all pairs."""
    monkeypatch.setattr(embed_dedup, "design", lambda *_: (1, 3))
    rng = np.random.default_rng(3)
    base = rng.normal(size=12)
    rows = [(i, (base[: 8 + 4 * (i % 3 == 0)] + rng.normal(size=8 + 4 * (i % 3 == 0)) * 0.01).tolist(), i % 2) for i in range(48)]
    out = embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    group = {}
    for i, v, lab in rows:
        group.setdefault((lab, len(v)), []).append(i)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (len(own) - 1, min(own)) for own in group.values() for i in own}


def test_pipeline_runs_whole_and_on_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("doc_id < 14")
    odd = spark.createDataFrame([(500, None, None, None, 0), (501, "", "en", "s", 0), (502, some.first().text, "en", "s", 0), (None, "words of no id at all", "en", "s", 0)], docs.schema)
    some.unionByName(odd).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    found = {r.doc_id for r in out}
    assert {500, 501, 502}.isdisjoint(found) and found <= {None, *range(14)} and len(found) > 5
    assert all(r.n_tokens > 0 and len(r.ids) == 4 * r.n_tokens for r in out)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pairs_checked_in_cells_are_those_checked_one_by_one(spark, monkeypatch):
    """A third of the pairs have one larger set, which is spread over several cells."""
    monkeypatch.setattr(minhash, "SPREAD", 20)
    scratch = Scratch(spark, "cells")
    sets = scratch.table(spark.range(400).selectExpr("id as node", "3L as n", "3L as k", "array(id % 7, 100 + id % 5, 200 + id % 3) as s"), "sets")
    pairs = scratch.table(spark.range(2000).selectExpr("id % 97 as x", "100 + if(id % 3 = 0, 0, id % 290) as y").distinct(), "pairs")
    setting = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    got = {tuple(r) for r in minhash.checked_in_cells(pairs, sets, sets, scratch, 0.6).collect()}
    assert got == {tuple(r) for r in minhash.checked(pairs, sets, scratch, "plain", 0.6).collect()} and len(got) > 100
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == setting


def test_of_larger_sets_only_shingles_that_are_asked_for_are_moved(spark, monkeypatch):
    """Long documents of one size share most of their text; one passage of theirs is also a document, in other words too."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, hot = [word() for _ in range(200)], [word() for _ in range(22)]
    rows = [(i, " ".join([*common, *hot, *(word() for _ in range(20))])) for i in range(12)]
    rows += [(100, " ".join(hot)), (101, " ".join([*hot[:18], *(word() for _ in range(4))])), (102, " ".join([*hot[:8], *(word() for _ in range(14))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved, check = [], minhash.checked_in_cells

    def spy(pairs, small, sets, *rest):
        moved.append([{r.x for r in pairs.collect()}, *(sum(len(r.s) for r in t.select("s").collect()) for t in (small, sets))])
        return check(pairs, small, sets, *rest)

    monkeypatch.setattr(minhash, "checked_in_cells", spy)
    _, _, _, far, twins = minhash.all_links(docs, Scratch(spark, "moved"), 0.6, 1.25)
    got = {tuple(sorted((r.x, r.y))) for r in twins.join(far, "x").select(twins["node"].alias("x"), "y").collect()}
    assert got == {tuple(sorted(x[:2])) for x in plain_links(rows) if x[3] > 1.25 * x[2]} and len(got) == 24
    assert moved[0][0] == {100, 101} and sum(moved[0][1:]) < 400
