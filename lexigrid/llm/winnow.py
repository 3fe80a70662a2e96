"""Winnowed anchors: where a window of a text may also occur elsewhere, without moving texts.

Of each window of `length` elements (bytes or words) the k-gram with the least hash is the anchor,
the leftmost of equals. It depends on the window's content alone, so equal windows have equal
anchors at equal places. Successive windows mostly share an anchor; such a run of windows is one
record

    d, h      the row: doc_id (null: the least long) and a hash of its text
    a         the element where the anchor begins
    lo, hi    the windows of the run begin hi to lo elements before a
    g         the anchor's hash
    c         hash of the run's whole text, lo and hi

so two windows can only be equal if their records agree in g. Records that agree in c too, so in 128
bits of hashes, are copies and are counted, not compared; one record per distinct (g, c) is an entry.
The texts of entries are fetched only for anchors that have several. An anchor with very many entries is
split by more of the text around it: its runs are cut in runs of a few windows, and their common
elements are the new anchor; see finer().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, lookup, raw, slices

ANCHORS = "d long, h long, a long, lo int, hi int, g long, c long"
#: Entries of one anchor beyond which it is split, and the windows of a run in each step of that. In the last
#: step a run is one window, so that all its equals are copies and no anchor is left with several entries.
MANY, STEPS = 20_000, (16, 1)
#: Copies of a row that are written by one task.
COPIES = 1000
NO_ID = -(1 << 63)
#: Elements of a text that are hashed at once; longer texts are taken in overlapping parts.
PART = 1 << 20
MASK = np.uint64((1 << 21) - 1)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse mod 2^64, for hashes of any range from sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)])
        return self.up[:n], self.down[:n]


BYTES, WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
BYTE_HASH = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


class ByteText:
    """A text as bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.n = len(data)

    def hashes(self, i: int, j: int) -> np.ndarray:
        return BYTE_HASH[np.frombuffer(self.data, np.uint8, j - i, i)]

    def text(self, i: int, j: int) -> bytes:
        return self.data[i:j]


class WordText:
    """A text as words between white space."""

    def __init__(self, data: bytes):
        self.data = data
        b = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~IS_SPACE[b]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.n = len(self.start)

    def hashes(self, i: int, j: int) -> np.ndarray:
        at, to = self.start[i:j], self.end[i:j]
        if not len(at):
            return np.zeros(0, np.uint64)
        # parts of the bytes, so that a long text's table of powers stays small
        base = int(at[0])
        if int(to[-1]) - base > PART * 16:
            half = (i + j) // 2
            if half > i:
                return np.r_[self.hashes(i, half), self.hashes(half, j)]
            return np.array([xxhash.xxh3_64_intdigest(self.data[base : int(to[-1])])], np.uint64)
        s = sums(BYTE_HASH[np.frombuffer(self.data, np.uint8, int(to[-1]) - base, base)], BYTES)
        down = BYTES.get(len(s))[1]
        return splitmix((s[to - base] - s[at - base]) * down[at - base])

    def text(self, i: int, j: int) -> bytes:
        return self.data[self.start[i] : self.end[j - 1]] if j > i else b""


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: the least from the window's start to a block's end, and on."""
    m = len(a)
    b = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    b[:m] = a
    b = b.reshape(-1, w)
    right = np.minimum.accumulate(b, axis=1).ravel()
    left = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: m - w + 1], right[w - 1 : m])


def anchors(text: ByteText | WordText, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(a, lo, hi, g) of the runs of a text's windows."""
    found = []
    for at in range(0, text.n - length + 1, PART):
        to = min(text.n, at + PART + length - 1)
        s = sums(text.hashes(at, to), WORDS)
        g = splitmix((s[k:] - s[:-k]) * WORDS.get(len(s) - k)[1])
        least = sliding_min((g & ~MASK) | np.arange(len(g), dtype=np.uint64), length - k + 1)
        a = (least & MASK).astype(np.int64)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        last = np.r_[first[1:], len(a)] - 1
        own = a[first]
        found.append((own + at, own - last, own - first, g[own].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def find_anchors(texts: DataFrame, kind: type, k: int, length: int) -> DataFrame:
    """The records of texts (d, h, text), in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = raw(b.column(2))
            at = at.tolist()
            rows, who = [], []
            for i in range(b.num_rows):
                if at[i + 1] - at[i] < length:
                    continue
                t = kind(data[at[i] : at[i + 1]])
                a, lo, hi, g = anchors(t, k, length)
                if len(a):
                    c = [xxhash.xxh3_64_intdigest(t.text(x, y), z) for x, y, z in zip((a - hi).tolist(), (a - lo + length).tolist(), (hi * length + lo).tolist())]
                    rows.append((a, lo, hi, g, np.array(c, np.uint64).view(np.int64)))
                    who.append(i)
            if rows:
                each = np.repeat(who, [len(r[0]) for r in rows])
                a, lo, hi, g, c = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), b.column(1).take(pa.array(each)), pa.array(a), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(g), pa.array(c)], ["d", "h", "a", "lo", "hi", "g", "c"])

    return texts.mapInArrow(run, ANCHORS)


def with_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d, h, text): the row's doc_id, the same with the least long where it is null, and a hash of its
    text, another one where the id is null."""
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    h = F.when(own.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text))
    return df.select(own.alias("id"), F.coalesce(own, F.lit(NO_ID)).alias("d"), h.alias("h"), text.alias("text"))


def unique_rows(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(texts with m, whether a row is repeated): rows with one (d, h) once, m the number of them. Without
    repeats, as a rule, that is one pass over (d, h); with them, the texts are written."""
    repeats = scratch.table(texts.groupBy("d", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "repeats")
    if repeats.isEmpty():
        return texts.withColumn("m", F.lit(1).cast("long")), False
    alone = texts.join(repeats, ["d", "h"], "left_anti").withColumn("m", F.lit(1).cast("long"))
    once = texts.join(F.broadcast(repeats) if repeats.count() <= 10_000 else repeats, ["d", "h"], "left_semi").groupBy("d", "h").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("m"))
    return scratch.table(alone.unionByName(once), "unique"), True


def every_copy(out: DataFrame, repeated: bool) -> DataFrame:
    """Rows of results, with m, as often as the input had them."""
    if not repeated:
        return out.drop("m")
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = out.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))))
    each = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("m") - F.col("_part") * COPIES).cast("int")))
    return parts.repartition(n).withColumn("_copy", each).drop("m", "_part", "_copy")


def candidates(texts: DataFrame, scratch: Scratch, kind: type, k: int, length: int, other_doc: bool) -> tuple[DataFrame, DataFrame]:
    """(records, entries): the records whose anchor occurs again (in another document if other_doc),
    and one row per (g, c) of them."""
    found = scratch.table(find_anchors(texts.select("d", "h", "text"), kind, k, length), "anchors")
    again = F.col("first") < F.col("last") if other_doc else F.col("n") > 1
    grams = found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *([F.min("d").alias("first"), F.max("d").alias("last")] if other_doc else [])).where(again).select("g", "n")
    grams = scratch.table(grams, "grams")
    records = scratch.table(lookup(found, grams, ["g"], "n", max(1, found.count()), inner=True).drop("n"), "records")
    scratch.drop("anchors", "grams")
    records = records.withColumn("g0", F.col("g")).withColumn("c0", F.col("c"))
    return records, scratch.table(distinct_runs(records, F.count(F.lit(1))), "entries")


def distinct_runs(records: DataFrame, copies: Column) -> DataFrame:
    """An entry for each (g, c) of records: copies, n (records), and the first record."""
    first = F.min(F.struct("d", "h", "a", "lo", "hi", "g0", "c0")).alias("first")
    return records.groupBy("g", "c").agg(copies.alias("copies"), F.count(F.lit(1)).alias("n"), first).select("g", "c", "copies", "n", "first.*")


def resolved(records: DataFrame, entries: DataFrame, texts: DataFrame, scratch: Scratch, kind: type, length: int, compare: Callable, later: bool, many: int = MANY, steps: tuple[int, ...] = STEPS, name: str = "") -> DataFrame:
    """(d, h, g0, c0, a, lo, hi) of the runs of `records` (these, g, c and copies) whose windows are repeated: as often
    as they like or, if later, in a smaller d. compare(contexts) gives (g, c, o1, o2) for entries of the same anchor."""
    total = max(1, records.count())
    alone = F.sum((F.col("copies") == 1).cast("long"))
    per = entries.groupBy("g").agg(F.count(F.lit(1)).alias("several"), alone.alias("alone")).where("several > 1" + " and alone > 0" * (not later)).select("g", "several")
    per = scratch.table(per, f"several{name}")
    keep = ["d", "h", "g0", "c0", "a", "lo", "hi"]
    rows = records.drop("copies")
    if later:
        met = scratch.table(lookup(rows, entries.select("g", "c", "n", F.col("d").alias("least")), ["g", "c"], "n", total, inner=True), f"met{name}")
        known, own = met.where("d > least"), met.where("d = least")
    else:
        known, own = lookup(rows, entries.where("copies > 1").select("g", "c", "n"), ["g", "c"], "n", total, inner=True), entries.where("copies = 1")
    open_ = scratch.table(lookup(entries, per, ["g"], "several", max(1, entries.count()), inner=True), f"open{name}")
    found = scratch.table(compare(contexts(open_.where(F.col("several") <= many), texts, kind, length)), f"found{name}")
    # an entry's result is for its first record or, if later, for all of the same document
    new = own.join(found, ["g", "c"]).select("d", "h", "g0", "c0", "a", F.col("o1").cast("int").alias("lo"), F.col("o2").cast("int").alias("hi"))
    out = known.select(*keep).unionByName(new)
    big = open_.where(F.col("several") > many)
    if big.isEmpty() or not steps:
        return out
    name = f"{name}-{len(steps)}"
    parts = scratch.table(finer(big, texts, kind, length, steps[0]), f"parts{name}")
    own_entries = scratch.table(distinct_runs(parts, F.sum("copies")), f"entries{name}")
    inner = scratch.table(resolved(parts, own_entries, texts, scratch, kind, length, compare, later, many, steps[1:], name), f"inner{name}").select("g0", "c0", "lo", "hi")
    back = own.select("d", "h", F.col("g0").alias("g1"), F.col("c0").alias("c1"), "a", F.col("g").alias("g0"), F.col("c").alias("c0"))
    return out.unionByName(back.join(inner, ["g0", "c0"]).select("d", "h", F.col("g1").alias("g0"), F.col("c1").alias("c0"), "a", "lo", "hi"))


def fetch(open_: DataFrame, texts: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """Rows that emit(text, entry) yields for the entries of each text, which is fetched by (d, h).
    A document's list of entries is no longer than its text."""
    mine = open_.groupBy("d", "h").agg(F.collect_list(F.struct("g", "c", "a", "lo", "hi", "copies")).alias("entries"))
    return texts.join(mine, ["d", "h"]).select("d", "h", "entries", "text").mapInArrow(emit, schema)


def contexts(open_: DataFrame, texts: DataFrame, kind: type, length: int) -> DataFrame:
    """The text of each open entry's run: g, c, d, lo, hi, copies, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out, size = [], 0
            for d, entries, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                t = kind(text.encode())
                for e in entries:
                    part = t.text(e["a"] - e["hi"], e["a"] - e["lo"] + length)
                    out.append((e["g"], e["c"], d, e["lo"], e["hi"], e["copies"], part))
                    size += len(part)
                    if size > SLICE_BYTES:
                        yield rows(out)
                        out, size = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["g", "c", "d", "lo", "hi", "copies", "part"])

    return fetch(open_, texts, run, "g long, c long, d long, lo int, hi int, copies long, part binary")


def finer(open_: DataFrame, texts: DataFrame, kind: type, length: int, step: int) -> DataFrame:
    """Entries cut in runs of up to `step` windows, places o div step equal: g0, c0 (the entry), d, h, a, lo, hi,
    copies, g (hash of what all windows of such places have in common), c (of the run's text)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["g0", "c0", "d", "h", "a", "lo", "hi", "copies", "g", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[tuple] = []
            for d, h, entries, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("d", "h", "entries", "text"))):
                t = kind(text.encode())
                plain = (lambda i, j, t=t: b" ".join(t.text(i, j).split())) if kind is WordText else t.text
                for e in entries:
                    a = e["a"]
                    for j in range(e["lo"] // step, e["hi"] // step + 1):
                        lo, hi = max(e["lo"], j * step), min(e["hi"], (j + 1) * step - 1)
                        core = plain(a - j * step, a - (j + 1) * step + 1 + length)
                        g = xxhash.xxh3_64_intdigest(core, (e["g"] + j) % (1 << 64)) - (1 << 63)
                        c = xxhash.xxh3_64_intdigest(plain(a - hi, a - lo + length), hi * length + lo) - (1 << 63)
                        out.append((e["g"], e["c"], d, h, a, lo, hi, e["copies"], g, c))
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return fetch(open_, texts, run, "g0 long, c0 long, d long, h long, a long, lo int, hi int, copies long, g long, c long")


def by_anchor(found: DataFrame, resolve: Callable, schema: str, block_bytes: int = SLICE_BYTES) -> DataFrame:
    """resolve(rows) for blocks of whole anchors' rows of contexts(); rows is a list of dicts of
    columns' lists, one block of about block_bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in slices(batches, "part", block_bytes):
            if size > block_bytes:
                done = pa.Table.from_batches(held)
                g = b.column(0).to_numpy()
                stop = int(np.argmax(g != done["g"][-1].as_py())) if g[-1] != done["g"][-1].as_py() else len(g)
                held.append(b.slice(0, stop))
                b = b.slice(stop)
                if b.num_rows == 0:
                    size += b.nbytes
                    continue
                yield from resolve(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield from resolve(pa.Table.from_batches(held))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, schema)


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def by_document(found: DataFrame) -> DataFrame:
    """(d, h, spans) of (d, h, first, last): a document's runs of window starts."""
    return found.groupBy("d", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def union_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) covered by windows that begin at first..last."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
