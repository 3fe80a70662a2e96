"""Row kernels in plain Python: greedy segmentation, perceptron scores. UDFs and facades share them."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Collection, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

START, END = ("-START-", "-START2-"), ("-END-", "-END2-")


def segment_greedy(text: str, vocabulary: Collection[str], longest: int) -> list[str]:
    """Words of text from left to right, at each place the longest one in the vocabulary of 2 to
    `longest` characters, else one character. Characters are code points; '' has no words."""
    out, i, n = [], 0, len(text)
    while i < n:
        for k in range(min(longest, n - i), 1, -1):
            if text[i : i + k] in vocabulary:
                break
        else:
            k = 1
        out.append(text[i : i + k])
        i += k
    return out


class Greedy:
    """segment_greedy() for a vocabulary that is used often: a word is only looked for where its first two
    characters are, and only in lengths that words with these have."""

    def __init__(self, words: Iterable[str], longest: int):
        self.words = frozenset(w for w in words if 2 <= len(w) <= longest)
        sizes: dict[str, set[int]] = {}
        for w in self.words:
            sizes.setdefault(w[:2], set()).add(len(w))
        self.sizes = {head: tuple(sorted(own, reverse=True)) for head, own in sizes.items()}

    def add_words(self, text: str, out: list[str]) -> None:
        """Append the words of text to out."""
        i, n, words, get, add = 0, len(text), self.words, self.sizes.get, out.append
        while i < n:
            for k in get(text[i : i + 2], ()):
                w = text[i : i + k]
                if w in words:
                    add(w)
                    i += k
                    break
            else:
                add(text[i])
                i += 1

    def cut(self, text: str) -> list[str]:
        out: list[str] = []
        self.add_words(text, out)
        return out


def segment_lengths(text: str, best: dict[int, int]) -> list[str]:
    """The same walk, given the longest match (2 or more) at the places that have one."""
    out, i = [], 0
    while i < len(text):
        k = best.get(i, 1)
        out.append(text[i : i + k])
        i += k
    return out


def segment_random(text: str, prob: float, rng: random.Random) -> list[str]:
    """text with a boundary between two characters wherever prob exceeds a draw from [0, 1)."""
    if not text:
        return []
    cuts = [0, *(i for i in range(1, len(text)) if prob > rng.random()), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


#: Bytes of text, and texts, that are handled at once: what a batch becomes in Python takes many times its size.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 4096


def slices(texts: pa.Array) -> Iterator[slice]:
    """Places of an array of strings, in order, in runs of about SLICE_BYTES; a longer text is a run of its own."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at, n = 0, len(size)
    while at < n:
        end = int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, n)
        yield slice(at, end)
        at = end


class Cutter:
    """Cuts texts by the draws of columns.random_words(), which prob and a text's prefix (seed|key|) fix."""

    def __init__(self, below: int):
        """below: draws of 32 bits that are smaller cut."""
        self.below = below
        self.numbers = [b"%d" % b for b in range(1024)]

    def cut(self, texts: pa.Array, prefixes: Sequence[bytes]) -> pa.Array:
        """array<string> of the texts' words; null for null. The words are parts of the texts' own buffer."""
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        kept = [t.encode() for t in texts.to_pylist() if t is not None]
        data = b"".join(kept)
        raw = np.frombuffer(data, np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes at which characters begin
        ends = np.cumsum([0, *map(len, kept)])
        edges = np.searchsorted(first, ends)  # the same in characters
        cuts = np.zeros(len(first), bool)
        md5 = hashlib.md5
        for a, b, prefix in zip(edges[:-1].tolist(), edges[1:].tolist(), (p for p, v in zip(prefixes, valid) if v)):
            if b > a:
                blocks = (b - a + 3) // 4
                while blocks > len(self.numbers):
                    self.numbers += [b"%d" % i for i in range(len(self.numbers), 2 * len(self.numbers))]
                draws = b"".join([md5(prefix + i, usedforsecurity=False).digest() for i in self.numbers[:blocks]])
                cuts[a:b] = np.frombuffer(draws, ">u4")[: b - a] < self.below
                cuts[a] = True
        words = np.append(first[cuts], len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(words) - 1, pa.py_buffer(words), pa.py_buffer(data))
        per = np.zeros(len(texts) + 1, np.int32)
        counts = np.concatenate([[0], np.cumsum(cuts)])[edges]
        per[1:][valid] = np.diff(counts)
        lists = np.cumsum(per, dtype=np.int32)
        mask = pa.array(~valid) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(lists), found, mask=mask)


def context(words: Sequence[str], i: int) -> tuple[str, str, str, str]:
    """The words two before, one before, one after and two after place i, with sentinels."""
    before2 = words[i - 2] if i >= 2 else START[0] if i == 1 else START[1]
    before = words[i - 1] if i else START[0]
    after = words[i + 1] if i + 1 < len(words) else END[0]
    after2 = words[i + 2] if i + 2 < len(words) else END[1]
    return before2, before, after, after2


def features(words: Sequence[str], i: int, prev: str, prev2: str) -> list[str]:
    """The 13 features of the word at place i, in the order in which their weights are added."""
    w = words[i]
    b2, b1, a1, a2 = context(words, i)
    return [
        "bias",
        f"i word's first char {w[:1]}",
        f"i word's final char {w[-1:]}",
        f"i-1 word's first char {b1[:1]}",
        f"i-1 word's final char {b1[-1:]}",
        f"i-1 tag {prev}",
        f"i-2 word's first char {b2[:1]}",
        f"i-2 word's final char {b2[-1:]}",
        f"i-2 tag {prev2}",
        f"i+1 word's first char {a1[:1]}",
        f"i+1 word's final char {a1[-1:]}",
        f"i+2 word's first char {a2[:1]}",
        f"i+2 word's final char {a2[-1:]}",
    ]


def round3(x: float) -> float:
    """To 3 decimals, halves away from zero."""
    y = abs(x) * 1000
    whole = float(int(y))
    whole += y - whole >= 0.5
    return (whole if x >= 0 else -whole) / 1000


class Perceptron:
    """An averaged perceptron over string features and classes."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None, classes: Iterable[str] = ()):
        self.weights = weights if weights is not None else {}
        self.classes = sorted(classes)
        self.totals: dict[tuple[str, str], float] = {}
        self.stamps: dict[tuple[str, str], int] = {}
        self.i = 0

    def predict(self, feats: Iterable[str]) -> str:
        """The class with the highest score; of equal ones the largest; '' without classes."""
        scores: dict[str, float] = {}
        for f in feats:
            for c, w in self.weights.get(f, {}).items():
                scores[c] = scores.get(c, 0.0) + w
        best, top = "", None
        for c in self.classes:
            s = scores.get(c, 0.0)
            if top is None or s >= top:
                best, top = c, s
        return best

    def update(self, truth: str, guess: str, feats: Iterable[str]) -> None:
        """Count the instance; where the guess is wrong, move its features' weights by one."""
        self.i += 1
        if truth == guess:
            return
        for f in feats:
            own = self.weights.setdefault(f, {})
            old_truth, old_guess = own.get(truth, 0.0), own.get(guess, 0.0)
            self._move(own, truth, f, old_truth, 1.0)
            self._move(own, guess, f, old_guess, -1.0)

    def _move(self, own: dict[str, float], c: str, f: str, old: float, by: float) -> None:
        key = (f, c)
        self.totals[key] = self.totals.get(key, 0.0) + (self.i - self.stamps.get(key, 0)) * old
        self.stamps[key] = self.i
        own[c] = old + by

    def average(self) -> None:
        """Weights become their means over all instances, in 3 decimals; zeros go, features stay.
        Before the first instance there is nothing to average."""
        if self.i:
            for f, own in self.weights.items():
                kept = {}
                for c, w in own.items():
                    total = self.totals.get((f, c), 0.0) + (self.i - self.stamps.get((f, c), 0)) * w
                    mean = round3(total / self.i)
                    if mean:
                        kept[c] = mean
                self.weights[f] = kept
        self.totals, self.stamps = {}, {}


#: The beginnings of the 13 features, in order; what follows is a character or a tag.
SLOTS = tuple(f.removesuffix("X") for f in features(["X"] * 5, 2, "X", "X"))


class Scorer:
    """A trained perceptron's predictions by tables for each feature's character or tag, added in the order
    of features(), so that sums are the same to the last bit."""

    def __init__(self, weights: dict[str, dict[str, float]], classes: Iterable[str]):
        self.classes = sorted(classes)
        at = {c: i for i, c in enumerate(self.classes)}
        own = {f: tuple((at[c], w) for c, w in ws.items() if c in at) for f, ws in weights.items()}
        self.bias = [0.0] * len(at)
        for i, w in own.get("bias", ()):
            self.bias[i] += w
        self.tables = tuple({f[len(slot) :]: pairs for f, pairs in own.items() if f.startswith(slot)} for slot in SLOTS[1:])

    def tag(self, words: Sequence[str], tagdict: dict[str, str]) -> list[str]:
        """tag_words() with this model."""
        out: list[str] = []
        if not words:
            return out
        known, top, classes, (t0, t1, t2, t3, t4, t5, t6, t7, t8, t9, t10, t11) = tagdict.get, len(self.classes) - 1, self.classes, self.tables
        # first and final characters, those of the sentinels around them
        first = ["-", "-", *[w[:1] for w in words], "-", "-"]
        final = ["-", "-", *[w[-1:] for w in words], "-", "-"]
        prev, prev2 = START
        for i, w in enumerate(words):
            tag = known(w)
            if tag is None:
                if top < 0:
                    tag = ""
                else:
                    scores = self.bias.copy()
                    for pairs in (
                        t0.get(first[i + 2]), t1.get(final[i + 2]), t2.get(first[i + 1]), t3.get(final[i + 1]), t4.get(prev),
                        t5.get(first[i]), t6.get(final[i]), t7.get(prev2), t8.get(first[i + 3]), t9.get(final[i + 3]), t10.get(first[i + 4]), t11.get(final[i + 4]),
                    ):
                        if pairs:
                            for c, x in pairs:
                                scores[c] += x
                    best = max(scores)
                    c = top
                    while scores[c] != best:
                        c -= 1
                    tag = classes[c]
            out.append(tag)
            prev2, prev = prev, tag
        return out


class BatchTagger:
    """Scorer's tags for Arrow arrays of sentences, word after word of all sentences at once. Weights are rows of a
    matrix for each slot, row 0 for what the model hasn't; they are added in the order of features()."""

    #: Slots of tags, and tokens that are scored at once.
    TAGS, TOKENS = (4, 7), 1 << 16

    def __init__(self, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]):
        scorer = Scorer(weights, classes)
        self.classes, self.tagdict = scorer.classes, tagdict
        self.bias = np.array(scorer.bias)
        self.rows: list[dict[str, int]] = []
        self.matrix: list[np.ndarray] = []
        for table in scorer.tables:
            m = np.zeros((len(table) + 1, len(self.classes)))
            for r, pairs in enumerate(table.values(), 1):
                for c, w in pairs:
                    m[r, c] = w
            self.rows.append({x: r for r, x in enumerate(table, 1)})
            self.matrix.append(m)
        # ids of tags: the classes, '' where there are none, other tags of the dictionary, and the two before a sentence
        known = set(self.classes)
        self.tags = [*self.classes, *sorted({t for t in tagdict.values() if t not in known} | ({""} - known)), *START]
        self.tag_id = {t: i for i, t in reversed([*enumerate(self.tags)])}
        self.tag_rows = {k: np.array([self.rows[k].get(t, 0) for t in self.tags]) for k in self.TAGS}
        self.strings = pa.array(self.tags, pa.string())

    def tag(self, sents: pa.Array) -> pa.Array:
        """array<string> of words -> array<string> of tags."""
        offsets = sents.offsets.to_numpy().astype(np.int64)
        begin, size = offsets[:-1], np.diff(offsets)
        if sents.null_count:
            size = np.where(sents.is_valid().to_numpy(zero_copy_only=False), size, 0)
        codes = sents.values.dictionary_encode()
        words = codes.dictionary.to_pylist()
        code = codes.indices.to_numpy(zero_copy_only=False)
        # rows of each word in the slots of characters; the sentinels around a sentence are one more word
        ends = [(w[:1], w[-1:]) for w in [*words, START[0]]]
        place = {k: np.array([self.rows[k].get(e[j], 0) for e in ends]) for k, j in zip((0, 1, 2, 3, 5, 6, 8, 9, 10, 11), (0, 1) * 5)}
        fixed = np.array([self.tag_id[self.tagdict[w]] if w in self.tagdict else -1 for w in words] or [-1])
        out = np.zeros(len(code), np.int64)
        for part in self._slices(size):
            self._tag(code, begin[part], size[part], len(words), place, fixed, out)
        tags = self.strings.take(pa.array(out))
        mask = sents.is_null() if sents.null_count else None
        return pa.ListArray.from_arrays(sents.offsets, tags, mask=mask)

    def _slices(self, size: np.ndarray) -> Iterator[np.ndarray]:
        """Sentences, the longest first, of about TOKENS tokens."""
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        group = (np.cumsum(size[order]) - 1) // self.TOKENS
        yield from np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ()

    def _tag(self, code: np.ndarray, begin: np.ndarray, size: np.ndarray, none: int, place: dict[int, np.ndarray], fixed: np.ndarray, out: np.ndarray) -> None:
        n, m = len(size), self.matrix
        prev, prev2 = (np.full(n, len(self.tags) - 2 + i) for i in (0, 1))
        for i in range(int(size[0])):
            live = int(np.searchsorted(-size, -i, "left"))  # the sentences are in order of their size
            at = begin[:live] + i
            own = code[at]
            tag = fixed[own].copy()
            open_ = np.flatnonzero(tag < 0)
            if len(open_) and not self.classes:
                tag[open_] = self.tag_id[""]
            elif len(open_):
                a, left = at[open_], size[:live][open_] - i
                word = own[open_]
                around = {d: code[a + d] if i + d >= 0 else np.full(len(a), none) for d in (-1, -2)}
                around |= {d: np.where(left > d, code[np.minimum(a + d, len(code) - 1)], none) for d in (1, 2)}
                s = self.bias + m[0][place[0][word]]
                s += m[1][place[1][word]]
                s += m[2][place[2][around[-1]]]
                s += m[3][place[3][around[-1]]]
                s += m[4][self.tag_rows[4][prev[:live][open_]]]
                s += m[5][place[5][around[-2]]]
                s += m[6][place[6][around[-2]]]
                s += m[7][self.tag_rows[7][prev2[:live][open_]]]
                s += m[8][place[8][around[1]]]
                s += m[9][place[9][around[1]]]
                s += m[10][place[10][around[2]]]
                s += m[11][place[11][around[2]]]
                tag[open_] = len(self.classes) - 1 - np.argmax(s[:, ::-1], axis=1)
            out[at] = tag
            prev2[:live], prev[:live] = prev[:live], tag


def tag_words(words: Sequence[str], model: Perceptron, tagdict: dict[str, str]) -> list[str]:
    """Tags from left to right; a word in the dictionary never reaches the model."""
    out: list[str] = []
    prev, prev2 = START
    for i, w in enumerate(words):
        tag = tagdict.get(w)
        if tag is None:
            tag = model.predict(features(words, i, prev, prev2))
        out.append(tag)
        prev2, prev = prev, tag
    return out


def train_pass(model: Perceptron, tagdict: dict[str, str], sents: Iterable[Sequence[tuple[str, str]]]) -> None:
    """One pass over tagged sentences; guesses, not the given tags, are the context."""
    for sent in sents:
        words = [w for w, _ in sent]
        prev, prev2 = START
        for i, (w, truth) in enumerate(sent):
            guess = tagdict.get(w)
            if guess is None:
                feats = features(words, i, prev, prev2)
                guess = model.predict(feats)
                model.update(truth, guess, feats)
            prev2, prev = prev, guess


def make_tagdict(sents: Iterable[Sequence[tuple[str, str]]], frequency: int, ambiguity: float) -> tuple[dict[str, str], set[str]]:
    """(word -> its tag, all tags): words seen often enough of which one tag has a large enough share;
    of equally frequent tags the largest."""
    counts: dict[str, dict[str, int]] = {}
    tags: set[str] = set()
    for sent in sents:
        for w, t in sent:
            own = counts.setdefault(w, {})
            own[t] = own.get(t, 0) + 1
            tags.add(t)
    out = {}
    for w, own in counts.items():
        n, (mode, tag) = sum(own.values()), max((c, t) for t, c in own.items())
        if n >= frequency and mode / n >= ambiguity:
            out[w] = tag
    return out, tags
