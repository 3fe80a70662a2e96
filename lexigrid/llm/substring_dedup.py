"""Removal of repeated passages by seed and extend, on words.

Documents are joined on winnowed anchors (see winnow). From the anchor each match is extended to the
left and to the right, word by word, for all occurrences of the anchor at once: step by step they part
into classes that still agree, so no pairs are made. Where the extensions to both sides give
`length` words together, the first document of the class keeps the passage, and the others, with
larger doc_id, lose the window; windows that overlap merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .winnow import MANY, WordText, by_anchor, by_document, candidates, every_copy, resolved, runs, union_spans, unique_rows, with_row

#: Words of an anchor's gram, at most.
GRAM = 16


def refine(classes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The classes parted by a word; ids count from 0."""
    return np.unique((classes.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)[1]


def extend(parts: list[list[bytes]], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(entry, o1, o2): windows that begin o2 to o1 words before the entry's anchor and also occur in
    an entry of the same group with a smaller doc."""
    ids: dict[bytes, int] = {}
    words = [[ids.setdefault(w, len(ids)) for w in p] for p in parts]
    n, reach = len(parts), int(hi.max()) if len(hi) else 0
    left = np.full((n, max(1, reach)), len(ids), np.int64)
    right = np.full((n, length), len(ids), np.int64)
    for i, w in enumerate(words):
        h = int(hi[i])
        left[i, :h] = w[:h][::-1]
        tail = w[h : h + length]
        right[i, : len(tail)] = tail
    r = [np.unique(group, return_inverse=True)[1]]
    for j in range(length):
        r.append(refine(r[-1], right[:, j]))
    own, out = r[0], np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        if o:
            own = refine(own, left[:, o - 1])
        on = np.flatnonzero((lo <= o) & (o <= hi))
        if len(on):
            same = refine(own[on], r[length - o][on])
            least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, doc[on])
            out[on, o] = least[same] < doc[on]
    found = []
    for i in np.flatnonzero(out.any(axis=1)).tolist():
        found += [(i, a, b) for a, b in zip(*(x.tolist() for x in runs(out[i])))]
    return found


def repeated(found: DataFrame, length: int) -> DataFrame:
    """(g, c, o1, o2) of the entries in contexts()."""

    def resolve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [p.split() for p in t["part"].to_pylist()]
        got = extend(parts, t["g"].to_numpy(), t["lo"].to_numpy().astype(np.int64), t["hi"].to_numpy().astype(np.int64), t["d"].to_numpy(), length)
        if got:
            e, o1, o2 = (np.array(x, np.int64) for x in zip(*got))
            yield pa.RecordBatch.from_arrays([pa.array(t["g"].to_numpy()[e]), pa.array(t["c"].to_numpy()[e]), pa.array(o1), pa.array(o2)], ["g", "c", "o1", "o2"])

    return by_anchor(found, resolve, "g long, c long, o1 long, o2 long")


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(d, h, spans): runs of window starts that a document with a smaller id has too."""
    k = max(1, min(gram, length // 2))
    records, entries = candidates(texts.where("id is not null"), scratch, WordText, k, length, other_doc=True)
    found = resolved(records, entries, texts, scratch, WordText, length, lambda parts: repeated(parts, length), later=True, many=many)
    return scratch.table(by_document(found.select("d", "h", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))), "spans")


def substring_dedup(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, many: int = MANY) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, spans (array of start, end: the maximal
    removed runs of words), kept (the kept words, joined by one space).

    A word goes if a window of `length` words that covers it also occurs in a row with a smaller
    doc_id, judged on the texts as given. Null text has no words; rows of under `length` words are
    kept whole; rows with a null doc_id come in no order, so they are kept whole and remove nothing;
    rows with one doc_id remove nothing from each other. Other columns are left out.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    scratch = Scratch(df.sparkSession, "substring")
    texts, repeats = unique_rows(with_row(df, id_col, text_col), scratch)
    spans = repeated_spans(texts, scratch, length, gram, many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for d, m, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                words = text.encode().split()
                starts, ends = [], []
                if found.is_valid:
                    first, last = (x.to_numpy() for x in found.values.flatten())
                    starts, ends = (x.tolist() for x in union_spans(first, last, length))
                kept = [w for x, y in zip([0, *ends], [*starts, len(words)]) for w in words[x:y]] if starts else words
                out.append((m, d, len(words), len(words) - len(kept), [{"start": x, "end": y} for x, y in zip(starts, ends)], b" ".join(kept).decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["m", "doc_id", "n_words", "n_removed", "spans", "kept"])

    met = texts.join(spans, ["d", "h"], "left").select("id", "m", "text", "spans")
    return every_copy(met.mapInArrow(cut, "m long, doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"), repeats)


#: For windows of 50 words.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
k AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, p FROM k JOIN f USING (h) WHERE doc_id > m),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM r),
c AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT c.doc_id, count(*) AS n_words, count(x.i) AS n_removed, coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (x.i IS NULL), '') AS kept
      FROM c LEFT JOIN x ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""
