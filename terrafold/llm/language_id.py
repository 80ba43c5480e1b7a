"""Language identification with unigram pieces, summed over all segmentations.

Pieces are the entries of a fixed public vocabulary that lie inside words. Each
language has a probability for each piece. The probability of a word in a
language is the sum, over all ways to cut it into pieces, of the product of the
piece probabilities (forward algorithm); a text is the product of its words.
The piece probabilities come from expectation-maximisation with the same sums
(forward and backward) over the word counts of a bounded sample.

Only word counts of the sample are shuffled and collected. Prediction is one pass
inside the scan's tasks, without a shuffle; a word is scored once and remembered
in a table of bounded size.

Words are runs of a-z and bytes above ASCII in the lower-cased text; everything
else separates. All pieces of the vocabulary that consist of these count, compared by 64-bit hashes. Words
of up to ``WORD_BYTES`` bytes are summed many at a time; a longer run, as scripts without spaces have, is
summed place by place over its whole length, with the last sums carried along and scaled.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels
from .common import short_batches

WORD_BYTES = 24
SAMPLE_ROWS = 3000
#: Least rows of a language in the sample (or all it has), and most words of a sampled text, evenly over it.
LEAST_ROWS = 60
TEXT_WORDS = 5000
ROUNDS = 3
SMOOTHING = 0.05
MEMO = 300_000
SLICE_BYTES = 2_000_000
UNKNOWN = "und"
SEED = 23

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_LETTER = regex.compile(r"\p{L}")


#: Weights of the bytes of a piece, its last byte first.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]))


def piece_hash(piece: bytes) -> int:
    """64 bits of a piece: bytes (plus one) times powers of an odd number, from the last byte on."""
    return sum((b + 1) * int(w) for b, w in zip(reversed(piece), _WEIGHTS)) % 2**64


class Pieces:
    """Sorted hashes of pieces, and the lengths that occur."""

    def __init__(self, pieces: set[bytes]):
        self.hashes = np.array(sorted({piece_hash(p) for p in pieces}), dtype=np.uint64)
        self.lengths = sorted({len(p) for p in pieces})

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the numbers of these."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, at[hit]


def vocabulary(path: str) -> Pieces:
    """The pieces of a rank file (a leading space aside) that lie inside words. All single bytes are pieces."""
    pieces = {bytes([b]) for b in np.flatnonzero(_LETTERS)}
    with open(path, "rb") as file:
        for line in file:
            piece = base64.b64decode(line.split()[0]).removeprefix(b" ")
            if piece and len(piece) < len(_WEIGHTS) and _LETTERS[list(piece)].all():
                pieces.add(piece)
    return Pieces(pieces)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of whole words."""
    return kernels.runs(_LETTERS[data])


def short_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words, those of more than ``WORD_BYTES`` bytes in parts that end between characters. For the fit only."""
    starts, ends = word_spans(data)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        while b - a > WORD_BYTES:
            cut = a + WORD_BYTES
            while cut > a + 1 and 128 <= data[cut] < 192:
                cut -= 1
            out.append((a, cut))
            a = cut
        out.append((a, b))
    spans = np.array(out, dtype=np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


class Lattice:
    """The pieces at every place of a set of distinct words, longest words first."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.order = np.argsort(starts - ends, kind="stable")
        self.lengths = (ends - starts)[self.order]
        letters = np.zeros((len(starts), WORD_BYTES), dtype=np.uint64)
        for p in range(WORD_BYTES):
            n = np.searchsorted(-self.lengths, -p, side="left")
            letters[:n, p] = data[starts[self.order[:n]] + p].astype(np.uint64) + np.uint64(1)
        #: (end, length) -> word rows and pieces
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for end in range(1, int(self.lengths.max(initial=0)) + 1):
            n = np.searchsorted(-self.lengths, -end, side="right")
            packed = np.zeros(n, dtype=np.uint64)
            for length in range(1, min(end, pieces.lengths[-1]) + 1):
                packed = packed + letters[:n, end - length] * _WEIGHTS[length - 1]
                if length in pieces.lengths:
                    rows, found = pieces.find(packed)
                    if len(rows):
                        self.edges.append((end, length, rows, found))

    def forward(self, chances: np.ndarray) -> np.ndarray:
        """``[word, place, language]``: the sum over all segmentations up to the place."""
        sums = np.zeros((len(self.lengths), WORD_BYTES + 1, chances.shape[1]))
        sums[:, 0] = 1
        for end, length, rows, piece in self.edges:
            sums[rows, end] += sums[rows, end - length] * chances[piece]
        return sums

    def backward(self, chances: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.lengths), WORD_BYTES + 1, chances.shape[1]))
        sums[np.arange(len(self.lengths)), self.lengths] = 1
        for end, length, rows, piece in reversed(self.edges):
            sums[rows, end - length] += sums[rows, end] * chances[piece]
        return sums

    def totals(self, forward: np.ndarray) -> np.ndarray:
        return forward[np.arange(len(self.lengths)), self.lengths]


def long_logs(pieces: Pieces, chances: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log probability of one long word in each language: the sum over all segmentations of its whole length.

    The sums of the last places, as many as a piece is long, are carried along and scaled by a power of two.
    """
    longest = pieces.lengths[-1]
    n_languages = chances.shape[1]
    sums = np.zeros((longest, n_languages))  # of the places before, the nearest last
    sums[-1] = 1.0
    scale = np.zeros(n_languages)
    step = 4096
    for a in range(0, len(word), step):
        b = min(a + step, len(word))
        # chances of the pieces that end at each place of the step, by length
        back = max(0, a - longest)
        letters = word[back:b].astype(np.uint64) + np.uint64(1)
        edges = np.zeros((b - a, longest, n_languages))
        packed = np.zeros(b - a, dtype=np.uint64)
        for length in range(1, longest + 1):
            first = np.arange(a, b) + 1 - length - back
            able = np.flatnonzero((first >= 0) & (first + back >= 0))
            packed[able] += letters[first[able]] * _WEIGHTS[length - 1]
            if length in pieces.lengths and len(able):
                rows, found = pieces.find(packed[able])
                edges[able[rows], longest - length] = chances[found]
        held = np.concatenate([sums, np.zeros((b - a, n_languages))])
        for i in range(b - a):
            now = (held[i : i + longest] * edges[i]).sum(axis=0)
            held[i + longest] = now
            if i % 64 == 63 or i + 1 == b - a:
                top = np.maximum(held[i + 1 : i + 1 + longest].max(axis=0), 1e-300)
                held[i + 1 : i + 1 + longest] /= top
                scale += np.log(top)
        sums = held[-longest:]
    return np.log(np.maximum(sums[-1], 1e-300)) + scale


class Model:
    """Languages, pieces and ``chances[piece, language]``."""

    def __init__(self, languages: list[str], pieces: Pieces, chances: np.ndarray):
        self.languages, self.pieces, self.chances = languages, pieces, chances
        self.token = hashlib.sha256(chances.tobytes() + repr(languages).encode()).digest()

    def word_logs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(starts), len(self.languages)))
        long = ends - starts > WORD_BYTES
        for i in np.flatnonzero(long):
            out[i] = long_logs(self.pieces, self.chances, data[starts[i] : ends[i]])
        short = np.flatnonzero(~long)
        out[short] = self._short_logs(data, starts[short], ends[short])
        return out

    def _short_logs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(self.languages)))
        step = max(1000, 20_000 * 4 // max(1, len(self.languages)))
        for i in range(0, len(starts), step):
            lattice = Lattice(self.pieces, data, starts[i : i + step], ends[i : i + step])
            out[i + lattice.order] = np.log(np.maximum(lattice.totals(lattice.forward(self.chances)), 1e-300))
        return out

    def text_logs(self, texts: list[bytes], memo: Memo) -> np.ndarray:
        """Log probability of each lower-cased text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for numbers, text_ends, raw in kernels.chunks(texts, SLICE_BYTES):
            data = np.frombuffer(raw, dtype=np.uint8)
            starts, ends = word_spans(data)
            if not len(starts):
                continue
            keys = kernels.span_hashes(data, starts, ends)
            distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
            logs = memo.get(distinct, lambda new: self.word_logs(data, starts[first[new]], ends[first[new]]))
            owner = numbers[np.searchsorted(text_ends, starts)]
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner, logs[place, k], minlength=len(texts))
        return out


class Memo:
    """Sorted word hashes with their log probabilities. Beyond ``MEMO`` only those of the last slice stay."""

    def __init__(self, width: int):
        self.keys, self.logs = np.empty(0, np.uint64), np.empty((0, width))

    def get(self, keys: np.ndarray, make) -> np.ndarray:
        """Values of sorted distinct keys; ``make`` gets the positions of the new ones."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        out = np.empty((len(keys), self.logs.shape[1]))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = make(new)
            if len(self.keys) + len(new) > MEMO:
                self.keys, self.logs = keys, out
            else:
                places = np.searchsorted(self.keys, keys[new])
                self.keys, self.logs = np.insert(self.keys, places, keys[new]), np.insert(self.logs, places, out[new], axis=0)
        return out


_MEMOS: dict[bytes, Memo] = {}


def memo_of(model: Model) -> Memo:
    """The word table of this Python process; one model at a time."""
    if model.token not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[model.token] = Memo(len(model.languages))
    return _MEMOS[model.token]


def learn_pieces(pieces: Pieces, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities ``[piece, language]`` from ``counts[word, language]`` by expectation-maximisation."""
    chances = np.full((len(pieces), counts.shape[1]), 1 / len(pieces))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.empty(0, np.int64)
    starts = ends - np.array([len(w) for w in words], dtype=np.int64)
    step = max(1000, 20_000 * 4 // max(1, counts.shape[1]))
    for _ in range(ROUNDS):
        expected = np.full_like(chances, SMOOTHING)
        for i in range(0, len(words), step):
            lattice = Lattice(pieces, data, starts[i : i + step], ends[i : i + step])
            forward, backward = lattice.forward(chances), lattice.backward(chances)
            weight = counts[i : i + step][lattice.order] / np.maximum(lattice.totals(forward), 1e-300)
            for end, length, rows, piece in lattice.edges:
                share = forward[rows, end - length] * chances[piece] * backward[rows, end] * weight[rows]
                np.add.at(expected, piece, share)
        chances = expected / expected.sum(axis=0)
    return chances


def train(
    df: DataFrame, learn: Column, path: str, row_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS
) -> Model:
    """Fit on about ``rows`` rows with text and language for which ``learn`` holds, chosen by a hash of the id.

    Each language has the same share of them, ``LEAST_ROWS`` or all its rows at least, so every language that has a row is learned. Of
    a text at most ``TEXT_WORDS`` words count. Without such rows the model has no language.
    """
    short_batches(df.sparkSession)
    able = df.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(row_id).isNotNull())
    held = {r[0]: r[1] for r in able.groupBy(lang).count().collect()}  # one row per language
    share = max(LEAST_ROWS, rows / max(len(held), 1))
    limits = [x for name, n in held.items() for x in (F.lit(name), F.lit(2**32 if n <= 2 * LEAST_ROWS else int(min(1.0, share / n) * 2**32)))]
    limit = F.element_at(F.create_map(*limits), F.col(lang)) if limits else F.lit(0)
    chosen = able.filter(F.pmod(F.xxhash64(F.lit(SEED), F.col(row_id).cast("long")), F.lit(2**32)) < limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for name, body in zip(batch["lang"], batch["body"]):
                raw = body.lower().encode()
                spans = list(zip(*(x.tolist() for x in short_spans(np.frombuffer(raw, dtype=np.uint8)))))
                spans = spans[:: -(-len(spans) // TEXT_WORDS) or 1]
                seen.update((name, raw[a:b]) for a, b in spans)
            keys = list(seen)
            yield pd.DataFrame({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": [seen[k] for k in keys]})

    read = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("body"))
    words = read.mapInPandas(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = words.toPandas()
    languages = sorted(table["lang"].unique())
    names = sorted({bytes(w) for w in table["word"]})
    counts = np.zeros((len(names), len(languages)))
    place = {w: i for i, w in enumerate(names)}
    rows_at = [place[bytes(w)] for w in table["word"]]
    counts[rows_at, [languages.index(x) for x in table["lang"]]] = table["n"]
    pieces = vocabulary(path)
    return Model(languages, pieces, learn_pieces(pieces, names, counts))


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the chance of that language among those learned (all alike beforehand).

    Null texts, texts without a letter and models without a language give ``und`` and 0.
    Ties go to the first language by name. Columns of these two names in ``df`` are replaced.
    """
    short_batches(df.sparkSession)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(bodies: pd.Series) -> pd.DataFrame:
        names, scores = np.full(len(bodies), UNKNOWN, dtype=object), np.zeros(len(bodies))
        able = [i for i, t in enumerate(bodies) if t is not None and _LETTER.search(t)] if model.languages else []
        memo = memo_of(model)
        if able:
            logs = model.text_logs([bodies.iloc[i].lower().encode() for i in able], memo)
            best = logs.argmax(axis=1)
            names[able] = np.array(model.languages, dtype=object)[best]
            scores[able] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = df.withColumn("__found", predict(F.col(text)))
    kept = [F.col(c) for c in df.columns if c not in ("lang_pred", "score")]
    return found.select(*kept, "__found.lang_pred", "__found.score")
