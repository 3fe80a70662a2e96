"""Token counts by rank-synchronous merging in ragged arrays.

For BPE files of the sentencepiece library. A text gets the leading space and visible spaces that the
model's normaliser asks for; it is split where no piece of the vocabulary spans two characters. The
distinct pre-tokens that a worker hasn't met are laid in one flat array of symbols with the place
where each sequence begins. In each round every sequence looks up the ranks of its pairs and merges all
occurrences of its lowest, from left to right, all sequences at once; finished ones leave. Where a merge
makes a pair of a rank as low, that pair comes next, and the rest of its sequence waits. What survives is counted: one token for a piece, the UTF-8 length for a character
that the vocabulary hasn't (byte fallback).

Pre-tokens of many characters, as of texts without spaces, are split further between characters that
no piece holds next to each other.
"""

from __future__ import annotations

import re
from collections import Counter as Counts
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

SPACE_SIGN = "▁"
#: Pre-tokens that a worker remembers; characters of those that are remembered and not split further.
MEMO, LONG = 500_000, 48
NONE = np.iinfo(np.int64).max


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Counter:
    """Counts tokens as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in model if k == 2)))
        norm = dict(fields(next(v for k, v in model if k == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError(f"{path}: only BPE with byte fallback and the identity normaliser that keeps spaces is counted here")
        self.prefix = " " if norm.get(3, 1) else ""
        pieces = []
        for i, v in enumerate(v for k, v in model if k == 1):
            p = dict(fields(v))
            if p.get(3, 1) in (4, 5):
                raise ValueError(f"{path}: user-defined or unused pieces aren't counted here")
            if p.get(3, 1) == 1:
                pieces.append((-float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), i, p[1].decode()))
        self.char = {p: i for _, i, p in pieces if len(p) == 1}
        ids = {p: i for _, i, p in pieces}
        rank = {s: r for r, s in enumerate(sorted({s for s, _, _ in pieces}))}
        order = {p: rank[s] for s, _, p in pieces}  # pieces of one score have one rank; the place decides
        merges = {}
        for p in ids:
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    merges[ids[p[:k]], ids[p[k:]]] = (order[p], ids[p])
        keys = np.array([(a << 32) | b for a, b in merges], np.int64)
        at = np.argsort(keys)
        self.keys, self.rank, self.new = keys[at], np.array([r for r, _ in merges.values()], np.int64)[at], np.array([n for _, n in merges.values()], np.int64)[at]
        # a piece that takes part in a merge of no higher rank than the one that makes it
        least: dict[int, int] = {}
        for pair, (r, _) in merges.items():
            for x in pair:
                least[x] = min(r, least.get(x, r))
        self.safe = np.array([self_r < least.get(n, NONE) for self_r, n in zip(self.rank.tolist(), self.new.tolist())], bool)
        # splits: before a run of spaces that follows another character, and around characters that no longer piece has
        joined = {c for p in ids if len(p) > 1 for c in p}
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in ids):
            raise ValueError(f"{path}: a piece has a space inside")
        self.joined = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in joined)
        self.split = re.compile(f"[{alone}]| *[^{alone} {SPACE_SIGN}]+| +|{SPACE_SIGN}")
        self.own_sign = re.compile(f"[ {SPACE_SIGN}]*[^{alone} {SPACE_SIGN}]+|[ {SPACE_SIGN}]+|[{alone}]")
        self.memo: dict[str, int] = {}
        self.size = memo

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE_SIGN in text:
            return self.own_sign.findall(self.prefix + text)
        return self.split.findall(self.prefix + text)

    def fragments(self, word: str) -> list[str]:
        """A pre-token cut wherever no piece holds the two characters."""
        w, joined = word.replace(" ", SPACE_SIGN), self.joined
        at = [0, *(i for i in range(1, len(w)) if w[i - 1 : i + 1] not in joined), len(w)]
        return [w[a:b] for a, b in zip(at, at[1:])]

    def count(self, texts: list[str]) -> list[int]:
        parts = [*map(self.pretokens, texts)]
        memo = self.memo
        new = {*()}.union(*parts).difference(memo) if parts else set()
        if len(memo) + len(new) > self.size:
            memo.clear()
            new = {*()}.union(*parts)
        short = [w for w in new if len(w) <= LONG]
        memo.update(zip(short, self._synchronous(short).tolist()))
        for w in new:
            if len(w) > LONG:
                cut = Counts(self.fragments(w))
                memo[w] = int(self._synchronous([*cut]) @ np.array([*cut.values()]))
        out = [sum(map(memo.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > LONG:
                del memo[w]
        if len(memo) > self.size:
            memo.clear()
        return out

    def _symbols(self, word: str) -> list[int]:
        """Piece ids of characters; those the vocabulary hasn't as minus their UTF-8 length."""
        char = self.char
        return [char[c] if c in char else -len(c.encode()) for c in word.replace(" ", SPACE_SIGN)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index of the merge) of each pair."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), at

    def _in_order(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray, merge: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of pairs of equal rank that are merged from left to right, those up to the first of each sequence
        whose merge makes a pair of no higher rank, which comes before the others."""
        risky = np.flatnonzero(~self.safe[merge])
        early = np.zeros(len(at), bool)
        if not len(risky):
            return ~early
        made, n = self.new[merge], len(sym)
        here = at[risky]
        right, left = np.minimum(here + 2, n - 1), np.maximum(here - 1, 0)
        after = np.where((here + 2 < n) & (seq[right] == seq[here]), sym[right], -1)
        joined = np.append(False, at[1:] == at[:-1] + 2)[risky]
        before = np.where(joined, made[risky - 1], np.where((here > 0) & (seq[left] == seq[here]), sym[left], -1))
        early[risky] = np.minimum(self._ranks(made[risky], after)[0], self._ranks(before, made[risky])[0]) <= rank[risky]
        passed = np.cumsum(early) - early
        own = np.append(True, seq[at[1:]] != seq[at[:-1]])
        return passed == passed[own][np.cumsum(own) - 1]

    def _synchronous(self, words: list[str]) -> np.ndarray:
        counts = np.zeros(len(words), np.int64)
        if not words:
            return counts
        symbols = [*map(self._symbols, words)]
        size = np.array([*map(len, symbols)])
        sym = np.array([s for w in symbols for s in w], np.int64)
        seq = np.repeat(np.arange(len(words)), size)
        rank, merge = self._pairs(sym, seq, np.arange(len(sym)))
        while len(sym):
            begin = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, begin)
            low_each = np.repeat(low, np.diff(np.append(begin, len(sym))))
            at = np.flatnonzero((rank == low_each) & (rank != NONE))
            keep = np.ones(len(sym), bool)
            if (low == NONE).any():
                keep = low_each != NONE
                counts += np.bincount(seq[~keep], np.where(sym[~keep] < 0, -sym[~keep], 1), len(words)).astype(np.int64)
            if len(at):
                run = np.append(True, at[1:] != at[:-1] + 1)
                nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[nth % 2 == 0]  # of overlapping pairs every other one
                at = at[self._in_order(sym, seq, at, merge[at], rank[at])]
                sym[at] = self.new[merge[at]]
                keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            sym, seq, rank, merge = sym[keep], seq[keep], rank[keep], merge[keep]
            new = np.concatenate([now, now[now > 0] - 1])  # only the pairs of merged symbols are others
            rank[new], merge[new] = self._pairs(sym, seq, new)
        return counts

    def _pairs(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_ranks() of the pairs that begin at these places; NONE at a sequence's end."""
        right = np.minimum(at + 1, max(0, len(sym) - 1))
        rank, merge = self._ranks(sym[at], sym[right])
        rank[(right == at) | (seq[right] != seq[at])] = NONE
        return rank, merge


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a file; loaded once."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_tokens of the whole text, without begin or end.

    Row-local; null text counts as empty and has 0 tokens; repeated or null doc_ids are carried along;
    other columns are left out. Strings of control pieces in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.count(b.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = text_bytes(df, id_col, text_col)
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
