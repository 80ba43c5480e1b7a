"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text becomes lower-cased words, cut into windows of about ``WINDOW`` bytes. Every window is
compressed with both dictionaries; the margin is how many bytes fewer the toxic one needs.
A document is judged by how many of its windows reach each of ``BARS`` and by its mean margin,
and a logistic curve over these, fitted on rows that the dictionaries had not seen
(two folds), gives the score: the calibrated threshold is where it crosses 0.5.

The dictionaries are trained on labelled rows. The ordinary one is trained on windows of
ordinary rows. Toxic rows are mostly ordinary prose, so the toxic one is trained on the
passages that set them apart: words, or beginnings of words, that stand in far more toxic than
ordinary rows (likelihood ratio). Both compressors hold the ordinary dictionary at
equal offsets, the toxic one with the toxic dictionary behind it, the other with zeros
in that place; so prose without such passages compresses alike and its margin is about 0.

The fit runs on the driver on a bounded sample: at most about ``rows`` rows of each label, chosen by a
hash of the id, and at most ``WINDOWS`` windows of each, spread over its whole text. Scoring reads
whole texts in one pass inside the scan's tasks, without a shuffle, with the dictionaries
(about 120 KB) in the closure.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import short_batches

#: Bytes of a window, most windows of a sampled row, sampled rows of each label.
WINDOW = 64
WINDOWS = 64
SAMPLE_ROWS = 2000
ORDINARY_BYTES = 112640
TOXIC_BYTES = 4096
#: Windows that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 40_000
#: Of a spelling that sets toxic rows apart: least likelihood ratio, rows, and share of toxic rows in shares of ordinary ones;
#: most spellings.
RATIO = 20.0
LEAST_ROWS = 3
TIMES = 4
SIGNS = 400
#: A window longer than this (one very long word) is compressed in pieces.
LONGEST = 1024
BARS = (1, 2, 3)
THRESHOLD = 0.5
SHARE = 0.3
SEED = 29

_SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def windows(text: str | None) -> list[bytes]:
    """The words of a text (runs of letters, lower case) as windows: words that start in the same 64 bytes."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()
    if not words:
        return []
    body = b" " + b" ".join(words) + b" "
    starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
    first = np.flatnonzero(np.diff(starts // WINDOW, prepend=-1))
    edges = [*(starts[first] - 1).tolist(), len(body) - 1]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        out += [body[i : min(i + LONGEST, b) + 1] for i in range(a, b, LONGEST)]
    return out


def spread(items: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the items, evenly over the list."""
    if len(items) <= most:
        return items
    return [items[i * len(items) // most] for i in range(most)]


# ---- training ---------------------------------------------------------------


def spellings(word: bytes) -> list[bytes]:
    """A word and its beginnings of four to eight bytes, with the space before."""
    return [b" " + word + b" ", *(b" " + word[:n] for n in range(4, min(len(word), 9)))]


def telling(rows: list[list[bytes]], toxic: np.ndarray) -> dict[bytes, float]:
    """Spellings that stand in far more toxic than ordinary rows, with their likelihood ratio; the ``SIGNS`` best."""
    held = (Counter(), Counter())
    for found, label in zip(rows, toxic):
        words = {w for window in found for w in window.split()}
        held[int(label)].update({s for w in words for s in spellings(w)})
    n = len(toxic) - int(toxic.sum()), int(toxic.sum())

    def fit(k: int, total: int, share: float) -> float:
        return sum(c * math.log(p) for c, p in ((k, share), (total - k, 1 - share)) if c)

    out = {}
    for spelling, k in held[1].items():
        other = held[0][spelling]
        if k < LEAST_ROWS or k * n[0] <= TIMES * (other + 1) * n[1]:
            continue
        apart = fit(k, n[1], k / n[1]) + fit(other, n[0], other / n[0])
        together = (k + other) / (n[0] + n[1])
        ratio = 2 * (apart - fit(k, n[1], together) - fit(other, n[0], together))
        if ratio > RATIO:
            out[spelling] = ratio
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:SIGNS])


def passage(word: bytes, signs: dict[bytes, float]) -> bytes:
    """What sets a word apart: of its telling spellings the longest that tells nearly as much as the best; else nothing."""
    found = [(signs[s], len(s), s) for s in spellings(word) if s in signs]
    best = max(found, default=(0.0, 0, b""))[0]
    return max(((n, s) for ratio, n, s in found if ratio >= 0.9 * best), default=(0, b""))[1]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(rows: list[list[bytes]], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary from the windows of labelled rows."""
    ordinary = [w for found, label in zip(rows, toxic) if not label for w in found]
    some = np.random.default_rng(SEED).permutation(len(ordinary))[:ORDINARY_WINDOWS]
    signs = telling(rows, toxic)
    words = (w for found, label in zip(rows, toxic) if label for window in found for w in window.split())
    passages = [p for p in (passage(w, signs) for w in words) if p]
    joined = [b"".join(passages[i : i + 8]) for i in range(0, len(passages), 8)]
    return dictionary([ordinary[i] for i in sorted(some)], ORDINARY_BYTES), dictionary(joined, TOXIC_BYTES)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if len(content) >= 8 else zstandard.DICT_TYPE_RAWCONTENT
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=5, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), compression_params=settings)


class Distance:
    """Margins of windows between two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)

    def margins(self, found: list[bytes]) -> np.ndarray:
        plain, toxic = self.plain.compress, self.toxic.compress
        return np.array([len(plain(w)) - len(toxic(w)) for w in found], dtype=np.int64)

    def features(self, found: list[bytes]) -> np.ndarray:
        """Windows that reach each bar (by the root of all windows), and the mean margin."""
        if not found:
            return np.zeros(len(BARS) + 1)
        m = self.margins(found)
        return np.array([*((m >= bar).sum() / math.sqrt(len(m) + 2) for bar in BARS), np.clip(m, -8, 16).mean()])


@dataclass(frozen=True)
class Model:
    """The dictionaries and the logistic curve (constant first)."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    @property
    def token(self) -> bytes:
        return hashlib.sha256(self.ordinary + self.toxic + self.weights.tobytes()).digest()

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; label 1 weighs ``SHARE`` of all, whatever its share of the sample."""
    x = np.column_stack([np.ones(len(features)), features])
    y = toxic.astype(float)
    weight = np.where(y == 1, SHARE / max(y.sum(), 1), (1 - SHARE) / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[list[bytes]], toxic: np.ndarray) -> Model:
    """Dictionaries from all rows; the curve from margins under dictionaries of the other fold.

    Without rows of both labels the model answers the share of label 1 (one half without any).
    """
    if len(np.unique(toxic)) < 2:
        share = (toxic.sum() + 1) / (len(toxic) + 2)
        return Model(b"", b"", np.array([math.log(share / (1 - share)), *[0.0] * (len(BARS) + 1)]))
    # every second row of each label, so that both folds hold both
    fold = np.zeros(len(toxic), dtype=int)
    for label in (0, 1):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % 2
    features = np.zeros((len(rows), len(BARS) + 1))
    for k in (0, 1):
        seen = np.flatnonzero(fold != k)
        distance = Distance(*dictionaries([rows[i] for i in seen], toxic[seen]))
        for i in np.flatnonzero(fold == k):
            features[i] = distance.features(rows[i])
    return Model(*dictionaries(rows, toxic), calibrate(features, toxic))


def train(
    df: DataFrame, labels: DataFrame, learn: Column, row_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on about ``rows`` rows of each label for which ``learn`` holds, chosen by a hash of the id.

    Labels other than 0 and 1 are no labels; of several labels of an id the largest counts. Null ids
    are not learned from. Other columns of ``df`` and ``labels`` are not read.
    """
    short_batches(df.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).filter(learn)
    known = known.groupBy(F.col(row_id).cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    held = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    limit = {k: int(min(1.0, rows / max(held.get(k, 0), 1)) * 2**32) for k in (0, 1)}
    place = lambda c: F.pmod(F.xxhash64(F.lit(SEED), c), F.lit(2**32))
    known = known.filter(place(F.col("__id")) < F.when(F.col("__label") == 1, limit[1]).otherwise(limit[0]))
    texts = df.select(F.col(row_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    texts = texts.filter(place(F.col("__id")) < max(limit.values()))  # before the join: other texts are not shuffled

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spread(windows(t), WINDOWS) for t in batch["__text"]]
            yield pd.DataFrame({"id": batch["__id"], "label": batch["__label"], "found": found})

    joined = texts.join(known, "__id").select("__id", "__label", "__text")
    got = joined.mapInPandas(cut_up, "id long, label int, found array<binary>").toPandas()
    found = [[bytes(w) for w in f] for f in got["found"]]
    order = sorted(range(len(got)), key=lambda i: (got["id"].iloc[i], found[i]))
    return fit([found[i] for i in order], got["label"].to_numpy()[order].astype(int))


# ---- scoring ----------------------------------------------------------------

_DISTANCES: dict[bytes, Distance] = {}


def distance_of(model: Model) -> Distance:
    """The compressors of this Python process; one model at a time."""
    if model.token not in _DISTANCES:
        _DISTANCES.clear()
        _DISTANCES[model.token] = Distance(model.ordinary, model.toxic)
    return _DISTANCES[model.token]


def with_toxicity(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with ``name``: the chance of label 1 of every row, in place of a column of that name.

    Null texts and texts without letters have no windows and get the score of margins of 0.
    """
    short_batches(df.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        distance = distance_of(model)
        features = np.array([distance.features(windows(t)) for t in texts]).reshape(-1, len(BARS) + 1)
        return pd.Series(model.score(features))

    return df.withColumn(name, score(F.col(text)))
