"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that occur inside no token of the vocabulary can never be joined by a merge:
between them is a certain cut. A text is cut there, each fragment is encoded by itself (a fragment
seen before comes from a table), and the ids are concatenated. The pattern that splits text before
the merges looks at most one character past a run of white space and begins a match with an
apostrophe; so no cut is made after white space or before an apostrophe, and the fragments' own
splits are those of the whole text.

Ids are 32-bit unsigned integers, little-endian, in a binary column.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, text_bytes

#: The split of byte-level BPE files with `use_regex`.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments that a worker remembers, and that it handles at once: as objects they take many times their bytes.
MEMO, BLOCK = 200_000, 32_768


def byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabulary files write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """fragment -> ids as bytes; emptied when it holds `size` fragments, so memory is bounded."""

    def __init__(self, encode, size: int = MEMO):
        self.encode, self.size = encode, size

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.encode(fragment)
        if len(self) >= self.size:
            self.clear()
        if len(fragment) <= 64:
            self[fragment] = ids
        return ids


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, memo: int = MEMO):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is read here")
        to_byte = byte_of_char()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        self._core = tiktoken.Encoding("lexigrid", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = [s.encode() for s in special]
        self.token = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for word, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.token[i] = word
        self.cut = np.ones((256, 256), bool)
        for word in self.token:
            w = np.frombuffer(word, np.uint8)
            self.cut[w[:-1], w[1:]] = False
        self.cut[[*range(9, 14), *range(28, 33)], :] = False
        self.cut[:, [0x27, *range(0x80, 0xC0)]] = False
        self.memo = Memo(self._fragment, memo)
        # the last byte of a white-space character beyond ASCII, and the byte before it
        self._last, self._before = np.zeros(256, bool), np.zeros(256, bool)
        self._last[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True
        self._before[[0xC2, 0x9A, 0x80, 0x81]] = True

    def _fragment(self, fragment: bytes) -> bytes:
        text = fragment.decode()
        if any(s in fragment for s in self._special):
            ids = self._core.encode(text, allowed_special="all", disallowed_special=())
        else:
            ids = self._core.encode_ordinary(text)
        return array("I", ids).tobytes()  # native order, little-endian on all machines that Spark supports

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each position after the first byte, whether a cut before it is certain."""
        if len(data) < 2:
            return np.zeros(0, bool)
        ok = self.cut.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        ok[1:] &= ~(self._last[data[1:-1]] & self._before[data[:-2]])
        return ok

    def encode_all(self, data: bytes, at: np.ndarray) -> list[bytes]:
        """The ids of each text data[at[i]:at[i + 1]]."""
        if not data:
            return [b""] * (len(at) - 1)
        here = np.concatenate([[False], self.cuts(np.frombuffer(data, np.uint8)), [True]])
        here[at] = True
        bounds = np.flatnonzero(here[1:]) + 1
        over = np.searchsorted(bounds, at[1:], "right").tolist()  # fragments up to each text's end
        out, parts, i, begin = [], [], 0, 0
        for a in range(0, len(bounds), BLOCK):
            ends = bounds[a : a + BLOCK].tolist()
            found = [*map(self.memo.__getitem__, [data[x:y] for x, y in zip([begin, *ends], ends)])]
            begin, k = ends[-1], 0
            while i < len(over) and over[i] <= a + len(ends):
                parts.append(b"".join(found[k : over[i] - a]))
                out.append(b"".join(parts))
                parts, k, i = [], over[i] - a, i + 1
            parts.append(b"".join(found[k:]))  # of a text that goes on in the next block
        return out

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        return np.frombuffer(self.encode_all(data, np.array([0, len(data)]))[0], "<u4").tolist()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a file; loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of df, in no stated order: doc_id, ids (binary), with `decoded` also
    decoded (string), the text that the ids give.

    Row-local, so any partition can be lost and run again. Null text counts as empty and gives no
    ids; null or repeated doc_ids are carried along; other columns are left out. A text of any length is
    encoded whole: only fragments, not texts, have to be short for speed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in slices(batches, "text"):
            ids = c.encode_all(*raw(b.column(1)))
            out = [b.column(0), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([*map(c.decode, ids)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return text_bytes(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """df's (doc_id, ids) with decoded; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in slices(batches, "ids"):
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode(..., decoded=True)."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
