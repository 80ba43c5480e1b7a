"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(b + sum_j w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2))

The last sum is the pairwise term of all feature pairs, in time linear in the
features of a text. The machine is fitted on the driver on a bounded sample of
labelled rows (``sample_rows``, chosen by a hash of the id); only hashed features of
the sample travel, never texts. Scoring is one pass over the documents inside
the scan's tasks, without a shuffle, with the model (about 1.5 MB) in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels
from .common import short_batches

#: Buckets of hashed words, factors per feature, rows to fit on.
BUCKETS = 1 << 15
FACTORS = 6
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
EPOCHS = 12
BATCH = 64
RATE = 0.02
DECAY = 1e-5
SEED = 11

#: Byte classes counted as structure statistics, as shares of all bytes.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "symbol": "#*$%&|<>@~^_=+{}[]\\/`",
    "stop": ".!?",
    "comma": ",;:",
    "quote": "'\"()-",
    "space": " \t",
    "line": "\n",
}
STATISTICS = [*CLASSES, "beyond_ascii", "words", "word_bytes", "distinct", "most_frequent", "pairs_distinct", "chars"]
_CLASS = np.full(256, len(CLASSES) + 1, dtype=np.int64)
_CLASS[128:] = len(CLASSES)
for _n, _chars in enumerate(CLASSES.values()):
    _CLASS[[ord(c) for c in _chars]] = _n


@dataclass
class Features:
    """Sparse word features (``bucket``, ``value``, ``first`` entry of each text) and dense statistics."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray
    dense: np.ndarray


def features(texts: list[bytes], n_chars: np.ndarray) -> Features:
    """Features of a few texts. ``n_chars`` is the metadata column (NaN if unknown)."""
    n = len(texts)
    counts = np.zeros((n, len(CLASSES) + 2))
    for numbers, ends, data in kernels.chunks(texts):
        kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
        kinds[ends[:-1]] = len(CLASSES) + 1  # the line feeds between texts belong to none
        owner = np.repeat(numbers, np.diff(np.concatenate([[-1], ends])))[: len(kinds)]
        counts += np.bincount(owner * counts.shape[1] + kinds, minlength=counts.size).reshape(counts.shape)
    hashes, first = kernels.word_hashes(texts)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    keys, repeats = np.unique(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    text_of, bucket = keys // BUCKETS, keys % BUCKETS
    weight = np.sqrt(repeats)
    norm = np.sqrt(np.bincount(text_of, repeats, minlength=n))
    pairs = np.zeros(n)
    if len(hashes) > 1:
        same = owner[1:] == owner[:-1]
        two = kernels.mix(hashes[1:] * np.uint64(3) + hashes[:-1])[same] >> np.uint64(24)
        pairs = np.bincount((np.unique(owner[1:][same].astype(np.uint64) << np.uint64(40) | two) >> np.uint64(40)).astype(np.int64), minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, text_of, repeats)
    size = np.array([len(t) for t in texts])
    per_word = np.maximum(words, 1)
    dense = np.column_stack([
        counts[:, :-1] / np.maximum(size, 1)[:, None],
        np.log1p(words),
        size / per_word,
        np.bincount(text_of, minlength=n) / per_word,
        most / per_word,
        pairs / np.maximum(words - 1, 1),
        np.log1p(np.nan_to_num(np.maximum(n_chars, 0))),
    ])
    return Features(bucket, (weight / norm[text_of]).astype(np.float32), np.searchsorted(text_of, np.arange(n + 1)), dense)


@dataclass
class Machine:
    """Weights of word buckets first, then of the statistics; ``mean`` and ``spread`` standardise the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return (np.clip((dense - self.mean) / self.spread, -4, 4) * 0.5).astype(np.float32)

    def parts(self, f: Features, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear term, factor sums and factor square sums of each text."""
        n = len(dense)
        linear = np.full(n, self.bias) + dense @ self.linear[BUCKETS:]
        v = self.factors[BUCKETS:]
        sums, squares = dense @ v, (dense * dense) @ (v * v)
        if len(f.bucket):
            filled = np.flatnonzero(np.diff(f.first))
            at = f.first[filled]
            mine = self.factors[f.bucket] * f.value[:, None]
            linear[filled] += np.add.reduceat(self.linear[f.bucket] * f.value, at)
            sums[filled] += np.add.reduceat(mine, at)
            squares[filled] += np.add.reduceat(mine * mine, at)
        return linear, sums, squares

    def score(self, f: Features) -> np.ndarray:
        linear, sums, squares = self.parts(f, self.scaled(f.dense))
        z = linear + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def take(f: Features, rows: np.ndarray) -> Features:
    sizes = f.first[rows + 1] - f.first[rows]
    first = np.concatenate([[0], np.cumsum(sizes)])
    entries = np.repeat(f.first[rows] - first[:-1], sizes) + np.arange(first[-1])
    return Features(f.bucket[entries], f.value[entries], first, f.dense[rows])


def fit(f: Features, labels: np.ndarray) -> Machine:
    """Adagrad on the logistic loss. The order of the rows and the start are fixed by ``SEED``.

    Without rows, or with one class only, the machine answers the class's share.
    """
    rng = np.random.default_rng(SEED)
    size = BUCKETS + len(STATISTICS)
    share = (labels.sum() + 1) / (len(labels) + 2)
    mean = f.dense.mean(axis=0) if len(labels) else np.zeros(len(STATISTICS))
    spread = np.maximum(f.dense.std(axis=0), 1e-3) if len(labels) else np.ones(len(STATISTICS))
    m = Machine(np.log(share / (1 - share)), np.zeros(size, np.float32),
                rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), mean, spread)
    if len(np.unique(labels)) < 2:
        m.factors[:] = 0
        return m
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    columns = np.arange(BUCKETS, size)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for rows in np.split(order, range(BATCH, len(order), BATCH)):
            some = take(f, rows)
            dense = m.scaled(some.dense)
            linear, sums, squares = m.parts(some, dense)
            z = linear + 0.5 * (sums * sums - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]).astype(np.float32) / len(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(some.first))
            used = np.concatenate([some.bucket, np.tile(columns, len(rows))])
            x = np.concatenate([some.value, dense.ravel()])
            who = np.concatenate([owner, np.repeat(np.arange(len(rows)), len(columns))])
            ids, place = np.unique(used, return_inverse=True)
            g = error[who] * x
            g_linear = np.bincount(place, g, minlength=len(ids)).astype(np.float32) + DECAY * m.linear[ids]
            step = g[:, None] * (sums[who] - m.factors[used] * x[:, None])
            g_factors = np.column_stack([np.bincount(place, step[:, k], minlength=len(ids)) for k in range(FACTORS)])
            g_factors = g_factors.astype(np.float32) + DECAY * m.factors[ids]
            seen_linear[ids] += g_linear**2
            seen_factors[ids] += g_factors**2
            seen_bias += error.sum() ** 2
            m.linear[ids] -= RATE * 5 * g_linear / np.sqrt(seen_linear[ids])
            m.factors[ids] -= RATE * g_factors / np.sqrt(seen_factors[ids])
            m.bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return m


def sample(df: DataFrame, labels: DataFrame, learn: Column, row_id: str, text: str, chars: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled rows, by a hash of the id, as hashed features ``label, bucket, value, dense``.

    The hash filter runs before the join, so texts outside the sample are not shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).filter(learn)
    known = known.groupBy(row_id).agg(F.max(label).alias("__label"))
    total = known.count()
    limit = int(min(1.0, rows / max(total, 1)) * 2**32)
    chosen = lambda c: F.pmod(F.xxhash64(F.lit(SEED), c.cast("long")), F.lit(2**32)) < limit
    known = known.filter(chosen(F.col(row_id))).select(F.col(row_id).cast("long").alias("__id"), "__label")
    texts = df.select(F.col(row_id).cast("long").alias("__id"), F.col(text).alias("__text"), F.col(chars).cast("double").alias("__chars"))
    joined = texts.filter(chosen(F.col("__id"))).join(known, "__id").select("__id", "__label", "__text", "__chars")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = features([(t or "").encode() for t in batch["__text"]], batch["__chars"].to_numpy(dtype=float))
            edges = f.first[1:-1]
            yield pd.DataFrame({
                "id": batch["__id"], "label": batch["__label"], "bucket": np.split(f.bucket.astype(np.int32), edges),
                "value": np.split(f.value, edges), "dense": list(f.dense),
            })

    return joined.mapInPandas(hashed, "id long, label int, bucket array<int>, value array<float>, dense array<double>")


def train(
    df: DataFrame, labels: DataFrame, learn: Column, row_id: str = "doc_id", text: str = "text", chars: str = "n_chars",
    label: str = "quality", rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on about ``rows`` labelled rows for which ``learn`` holds. Labels other than 0 and 1 are no labels."""
    short_batches(df.sparkSession)
    got = sample(df, labels, learn, row_id, text, chars, label, rows).toPandas().sort_values("id", kind="stable")
    sizes = [len(b) for b in got["bucket"]]
    f = Features(
        np.concatenate([np.empty(0, np.int64), *got["bucket"]]).astype(np.int64),
        np.concatenate([np.empty(0, np.float32), *got["value"]]).astype(np.float32),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.array(got["dense"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS)),
    )
    return fit(f, got["label"].to_numpy(dtype=np.float64))


def with_score(df: DataFrame, machine: Machine, text: str = "text", chars: str = "n_chars", name: str = "score") -> DataFrame:
    """``df`` with ``name``: the chance of label 1 of every row. Null and empty texts have statistics only."""
    short_batches(df.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        out = [np.empty(0)]
        rows, held = [], 0
        bodies = [b"" if t is None else t.encode() for t in texts]
        known = n_chars.to_numpy(dtype=float)
        for i, body in enumerate(bodies):
            rows.append(i)
            held += len(body)
            if held >= kernels.CHUNK or i + 1 == len(bodies):
                out.append(machine.score(features([bodies[k] for k in rows], known[rows])))
                rows, held = [], 0
        return pd.Series(np.concatenate(out))

    return df.withColumn(name, score(F.col(text), F.col(chars).cast("double")))
