"""Removal of repeated byte strings with a suffix array that is built block by block.

Windows of `length` bytes that may occur elsewhere are found by winnowed anchors (see winnow); all
other suffixes are unique in their first `length` bytes. The suffixes of one anchor form a bucket;
buckets are sorted one block at a time, so memory is bounded. In a block suffixes are ordered by their
first M bytes (doubling from 8) and by the M bytes that end their window. Ties beyond that are
resolved by ranks of a difference cover: of the places p with p mod V in D, sorted beforehand;
any two suffixes reach such places after the same number of bytes, less than V, and the ranks of
those places with the two orders above decide on the whole window without reading it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, raw, slices
from .winnow import MANY, ByteText, by_anchor, by_document, candidates, every_copy, resolved, runs, union_spans, unique_rows, with_row

#: Bytes of an anchor's gram, at most.
GRAM = 48
#: Difference covers: every residue mod V is a difference of two members.
COVERS = {31: (1, 5, 11, 24, 25, 27), 21: (0, 1, 4, 14, 16), 13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each (a, b) among all, equal for equal pairs."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


class BlockSorter:
    """Order of the windows of a block of texts."""

    def __init__(self, length: int):
        self.length = length
        self.v = next(v for v in COVERS if 2 * v <= length // 2 or v == 1)
        self.m = 1
        while self.m < 2 * self.v:
            self.m *= 2
        if self.m > length:
            self.m = 1
        cover = COVERS[self.v]
        self.sampled = np.isin(np.arange(self.v), cover)
        self.delta = np.array([[next(d for d in range(self.v) if self.sampled[(i + d) % self.v] and self.sampled[(j + d) % self.v]) for j in range(self.v)] for i in range(self.v)])

    def classes(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """For each window start in `at`, whether another of them has an equal window. Windows lie
        inside the data."""
        n, m, v, length = len(data), self.m, self.v, self.length
        pad = np.zeros(n + m + 8, np.uint64)
        pad[:n] = np.frombuffer(data, np.uint8)
        span, rank = 1, pad + np.uint64(1)
        rank[n:] = 0
        while span < min(m, 4):
            rank[: len(rank) - span] = (rank[: len(rank) - span] << np.uint64(9 * span)) | rank[span:]
            span *= 2
        rank = np.unique(rank, return_inverse=True)[1]
        while span < m:
            rank[: n + 8] = pair_rank(rank[: n + 8], rank[span : span + n + 8])
            rank[n + 8 :] = 0
            span *= 2
        tie = pair_rank(rank[at], rank[at + length - m])
        order = np.argsort(tie, kind="stable")
        at_, tie = at[order], tie[order]
        size = np.bincount(tie)[tie]
        live = size > 1
        out = np.zeros(len(at), bool)
        if not live.any():
            return out
        order, at_, tie = order[live], at_[live], tie[live]
        # ranks of the cover's places over `covered` bytes, length - m <= covered <= length - v + 1
        place = np.flatnonzero(self.sampled[np.arange(n) % v])
        full = np.zeros(n + length + 1, np.int64)
        full[place] = rank[place] + 1
        covered = m
        while covered < length - m:
            step = min(covered, length - v + 1 - covered) // v * v
            full[place] = pair_rank(full[place], full[place + step]) + 1
            covered += step
        while len(at_):
            head = np.r_[True, tie[1:] != tie[:-1]]
            lead = at_[head][np.cumsum(head) - 1]
            d = self.delta[lead % v, at_ % v]
            same = full[lead + d] == full[at_ + d]
            count = np.bincount(tie[same], minlength=int(tie[-1]) + 1)[tie]
            out[order[same & (count > 1)]] = True
            order, at_, tie = order[~same], at_[~same], tie[~same]
            if len(tie):
                more = np.bincount(tie)[tie] > 1
                order, at_, tie = order[more], at_[more], tie[more]
        return out


def repeated(found: DataFrame, length: int) -> DataFrame:
    """(g, c, o1, o2): of each lone entry of contexts(), the runs of places whose windows occur again."""

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sorter = BlockSorter(length)
        parts = t["part"].combine_chunks()
        data, start = raw(parts if isinstance(parts, pa.Array) else pa.concat_arrays(parts.chunks))
        span = (t["hi"].to_numpy() - t["lo"].to_numpy()).astype(np.int64) + 1
        begin = np.r_[0, np.cumsum(span)]
        at = np.arange(begin[-1]) - np.repeat(begin[:-1] - start[:-1], span)
        again = sorter.classes(data, at)
        g, c, hi, copies = t["g"].to_numpy(), t["c"].to_numpy(), t["hi"].to_numpy().astype(np.int64), t["copies"].to_numpy()
        again[np.repeat(copies > 1, span)] = False
        # one false between entries parts their runs
        wide = np.zeros(begin[-1] + len(span), bool)
        entry = np.repeat(np.arange(len(span)), span)
        wide[np.arange(begin[-1]) + entry] = again
        first, last = runs(wide)
        e = np.searchsorted(begin[:-1] + np.arange(len(span)), first, "right") - 1
        off = begin[:-1][e] + e
        o2, o1 = hi[e] - (first - off), hi[e] - (last - off)
        yield pa.RecordBatch.from_arrays([pa.array(g[e]), pa.array(c[e]), pa.array(o1), pa.array(o2)], ["g", "c", "o1", "o2"])

    return by_anchor(found, resolve, "g long, c long, o1 long, o2 long")


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(d, h, spans): runs of window starts that occur elsewhere in distinct texts."""
    k = max(1, min(gram, length // 2))
    records, entries = candidates(texts, scratch, ByteText, k, length, other_doc=False)
    found = resolved(records, entries, texts, scratch, ByteText, length, lambda parts: repeated(parts, length), later=False, many=many)
    return scratch.table(by_document(found.select("d", "h", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))), "spans")


def suffix_dedup(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, many: int = MANY) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, spans (array of start, end: the
    maximal removed runs of bytes), kept (binary: the remaining bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    or another row, judged on the texts as given; copies of a row count. Null text counts as empty;
    texts under `length` bytes are kept whole; null doc_ids are ordinary rows. Other columns are left
    out.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    scratch = Scratch(df.sparkSession, "suffix")
    texts, repeats = unique_rows(with_row(df, id_col, text_col), scratch)
    spans = repeated_spans(texts, scratch, length, gram, many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for d, m, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                data = text.encode()
                starts, ends = [], []
                if m > 1 and len(data) >= length:  # a row that is there twice goes whole
                    starts, ends = [0], [len(data)]
                elif found.is_valid:
                    first, last = (x.to_numpy() for x in found.values.flatten())
                    starts, ends = (x.tolist() for x in union_spans(first, last, length))
                kept = b"".join(data[x:y] for x, y in zip([0, *ends], [*starts, len(data)]))
                out.append((m, d, len(data), len(data) - len(kept), len(starts), [{"start": x, "end": y} for x, y in zip(starts, ends)], kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["m", "doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    met = texts.join(spans, ["d", "h"], "left").select("id", "m", "text", "spans")
    return every_copy(met.mapInArrow(cut, "m long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"), repeats)


#: For strings of 400 bytes, in hexadecimal.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, t, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400),
k AS MATERIALIZED (SELECT doc_id, p, md5(substring(t, 2 * p + 1, 800)) AS h FROM p),
r AS (SELECT doc_id, p FROM k SEMI JOIN (SELECT h FROM k GROUP BY h HAVING count(*) > 1) USING (h)),
e AS (SELECT doc_id, p, CASE WHEN p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400 THEN 1 ELSE 0 END AS fresh FROM r),
s AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM e),
g AS (SELECT doc_id, s, min(p) AS a, max(p) + 400 AS b FROM s GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
y AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(t, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substring(any_value(t), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
      FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, t))) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""
