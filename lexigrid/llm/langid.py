"""Language ID with a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read in stretches of STRETCH bytes, all of them, forwards and backwards from
an empty state. Both states together label every byte; a text's probabilities are the mean over its
bytes. The network is trained on the driver by backpropagation through time on a bounded sample of
labelled texts.

Arrays are laid out as (features, sequences), so every step works on whole rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices

UND = "und"
STRETCH = 128
#: Bounds of the training sample: documents of each language, characters of each, documents in all.
PER_LANG, SAMPLE_CHARS, SAMPLE_DOCS = 400, 600, 40_000
#: Unicode's letters; numbers such as those of "²½Ⅷ①" aren't.
LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Cell:
    """One direction: x (3H, 256) the bytes' parts of the gates, u (3H, H) the state's."""

    x: np.ndarray
    u: np.ndarray

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, z, r, n, the state's part of n)."""
        k = len(h)
        x = np.take(self.x, byte, axis=1, mode="clip")
        a = self.u @ h
        x[: 2 * k] += a[: 2 * k]
        gates = sigmoid(x[: 2 * k])
        z, r, n, inner = gates[:k], gates[k:], x[2 * k :], a[2 * k :]
        n += r * inner
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, inner


@dataclass
class LanguageModel:
    """The trained network and its languages, in order."""

    langs: list[str]
    forward: Cell
    backward: Cell
    v: np.ndarray
    b: np.ndarray

    def pooled(self, bytes_: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities, (languages, sequences). bytes_ is (steps, sequences),
        padded; size: bytes of each sequence."""
        steps, n = bytes_.shape
        k = self.forward.u.shape[1]
        h = np.zeros((k, n), np.float32)
        states = np.empty((steps, k, n), np.float32)
        for t in range(steps):
            h = states[t] = self.forward.step(bytes_[t], h)[0]
        total = np.zeros((len(self.langs), n), np.float32)
        h = np.zeros((k, n), np.float32)
        ragged = int(size.min()) if n else steps
        for t in range(steps - 1, -1, -1):
            h = self.backward.step(bytes_[t], h)[0]
            p = self.v[:, :k] @ states[t]
            p += self.v[:, k:] @ h
            p += self.b
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if t >= ragged:
                on = t < size
                h *= on
                p *= on
            total += p
        return total

    def predict(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """(texts, languages): mean probabilities of each text data[at[i]:at[i + 1]]; zeros if empty."""
        size = np.diff(at)
        count = -(-size // STRETCH)
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = at[:-1][text] + nth * STRETCH
        long = np.minimum(at[1:][text] - begin, STRETCH)
        out = np.zeros((len(size), len(self.langs)))
        padded = np.frombuffer(data + b"\0" * STRETCH, np.uint8)
        order = np.argsort(-long, kind="stable")
        for i in range(0, len(order), 2048):
            own = order[i : i + 2048]
            most = int(long[own[0]])
            block = padded[begin[own][None, :] + np.arange(most)[:, None]]
            np.add.at(out, text[own], self.pooled(block, long[own]).T)
        return out / np.maximum(size, 1)[:, None]


def train(texts: list[bytes], labels: list[str], hidden: int | None = None, steps: int | None = None, batch: int = 160, stretch: int = 80, rate: float = 0.02, seed: int = 0) -> LanguageModel:
    """Fit by backpropagation through time with Adam; every position of a stretch is labelled. By default
    the states' size and the steps follow the number of languages: 6 and 220 for up to four."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    c = len(langs)
    k = hidden or max(6, math.ceil(2 * math.sqrt(c)))
    steps = steps or max(220, 15 * c)
    texts, labels = zip(*[(t, label) for t, label in zip(texts, labels) if t]) if any(texts) else ((), ())
    p = {
        "x0": rng.normal(0, 0.3, (3 * k, 256)), "u0": rng.normal(0, 0.3, (3 * k, k)),
        "x1": rng.normal(0, 0.3, (3 * k, 256)), "u1": rng.normal(0, 0.3, (3 * k, k)),
        "v": rng.normal(0, 0.3, (c, 2 * k)), "b": np.zeros((c, 1)),
    }
    p = {key: x.astype(np.float32) for key, x in p.items()}
    model = LanguageModel(langs, Cell(p["x0"], p["u0"]), Cell(p["x1"], p["u1"]), p["v"], p["b"])
    by_lang = [[i for i, label in enumerate(labels) if label == lang] for lang in langs]
    if not any(by_lang):
        return model
    m1, m2 = ({key: np.zeros_like(x) for key, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        gold = rng.integers(0, c, batch)
        gold = np.array([g if by_lang[g] else next(j for j in range(c) if by_lang[j]) for g in gold])
        block = np.zeros((stretch, batch), np.uint8)
        mask = np.zeros((stretch, batch), np.float32)
        for j, g in enumerate(gold):
            t = texts[by_lang[g][rng.integers(len(by_lang[g]))]]
            i = rng.integers(max(1, len(t) - stretch + 1))
            part = np.frombuffer(t[i : i + stretch], np.uint8)
            block[: len(part), j] = part
            mask[: len(part), j] = 1
        grad = gradient(model, block, mask, gold)
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for key, x in p.items():
            g = np.clip(grad[key], -1, 1)
            m1[key] += 0.1 * (g - m1[key])
            m2[key] += 0.01 * (g * g - m2[key])
            x -= now * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)
    return model


def gradient(model: LanguageModel, block: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over all positions."""
    steps, n = block.shape
    k = model.forward.u.shape[1]
    kept, states = [], []
    for cell, order in ((model.forward, range(steps)), (model.backward, range(steps - 1, -1, -1))):
        h, own, at = np.zeros((k, n), np.float32), {}, {}
        for t in order:
            new, *rest = cell.step(block[t], h)
            own[t] = (h, *rest)
            h = at[t] = new * mask[t]
        kept.append(own)
        states.append(at)
    grad: dict[str, np.ndarray] = {"v": np.zeros_like(model.v), "b": np.zeros_like(model.b)}
    flow: list[dict] = [{}, {}]
    scale = 1 / mask.sum()
    for t in range(steps):
        s = np.vstack([states[0][t], states[1][t]])
        p = model.v @ s + model.b
        p = np.exp(p - p.max(axis=0))
        p /= p.sum(axis=0)
        p[gold, np.arange(n)] -= 1
        p *= mask[t] * scale
        grad["v"] += p @ s.T
        grad["b"] += p.sum(axis=1, keepdims=True)
        d = model.v.T @ p
        flow[0][t], flow[1][t] = d[:k], d[k:]
    for i, (cell, order) in enumerate(((model.forward, range(steps - 1, -1, -1)), (model.backward, range(steps)))):
        du = np.zeros_like(cell.u)
        dx = np.empty((3 * k, steps, n), np.float32)
        later = np.zeros((k, n), np.float32)
        for t in order:
            h, z, r, m, inner = kept[i][t]
            d = (flow[i][t] + later) * mask[t]
            dn = d * (1 - z) * (1 - m * m)
            da = np.vstack([d * (h - m) * z * (1 - z), dn * inner * r * (1 - r), dn * r])
            dx[:, t] = da
            dx[2 * k :, t] = dn
            du += da @ h.T
            later = d * z + cell.u.T @ da
        flat = block.ravel()
        grad[f"x{i}"] = np.array([np.bincount(flat, row.ravel(), 256) for row in dx], np.float32)
        grad[f"u{i}"] = du
    return grad


def held_out(doc_id):
    """Documents that are never learned from: CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, chars: int, most: int) -> list[tuple[str, str]]:
    """(language, part of a text) of about per_lang learnable documents of each language, or as many as
    `most` documents in all leave it, chosen by a hash of the id; `chars` characters from a place given by it."""
    d = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    d = d.where(~held_out("i") & F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = d.groupBy("l").count().limit(most + 1).collect()
    if not counts:
        return []
    if len(counts) > most:
        raise ValueError(f"more than {most} languages, the most documents that are learned from")
    per_lang = min(per_lang, most // len(counts))
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], int((1 << 30) * min(1.0, 1.3 * (per_lang + 10) / r["count"])))])
    at = F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(F.length("t") - chars, F.lit(1))).cast("int") + 1
    rows = d.where(draw < share[F.col("l")]).select("l", draw.alias("draw"), "i", F.substr("t", at, F.lit(chars)).alias("part")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["draw"], r["i"], r["part"])):
        if taken.setdefault(r["l"], 0) < per_lang:
            taken[r["l"]] += 1
            out.append((r["l"], r["part"]))
    return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, chars: int = SAMPLE_CHARS, most: int = SAMPLE_DOCS, **options) -> LanguageModel:
    """A model of every language of the labels, from a bounded sample: at most per_lang documents of each
    and `most` in all, `chars` characters of each. Null ids, texts and labels, and held-out documents, are
    never learned from. Without any label the model knows no language and predicts `und`; more languages
    than `most` raise ValueError."""
    got = sample(df, id_col, text_col, lang_col, per_lang, chars, most)
    return train([t.encode() for _, t in got], [lang for lang, _ in got], **options)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score (the pooled probability of
    lang_pred), probs (by language, in the order of model.langs).

    Whole texts; row-local. lang_pred is `und`, with score 0, for null text and text without a letter.
    Null and repeated doc_ids are carried along, other columns left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            letters = np.array([t is not None and LETTER.search(t) is not None for t in b.column(2).to_pylist()])
            if model.langs:
                p = model.predict(*raw(b.column(2)))
                best = p.argmax(axis=1)
                lang = np.array(model.langs, object)[best]
                score = p[np.arange(len(p)), best]
            else:
                p, lang, score = np.zeros((b.num_rows, 0)), np.full(b.num_rows, UND, object), np.zeros(b.num_rows)
            lang[~letters], score[~letters] = UND, 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "probs"])

    d = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, probs array<double>")


def keep_known(df: DataFrame, model: LanguageModel, min_score: float | None = None, text_col: str = "text") -> DataFrame:
    """df's rows, all columns, in whose text predict() finds a language with at least min_score; the
    others go: `und`, and text that is hardly more of one language than of any other. Without min_score,
    that is under 1.2 times an even share of the model's languages, and never over 0.3."""
    at = df.columns.index(text_col)
    least = min(0.3, 1.2 / max(1, len(model.langs))) if min_score is None else min_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = b.column(at)
            known = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()])
            if model.langs:
                known &= model.predict(*raw(texts)).max(axis=1) >= least
            else:
                known[:] = False
            yield b.filter(pa.array(known))

    return df.mapInArrow(run, df.schema)
