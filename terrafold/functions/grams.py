"""N-gram overlap of two text columns, a batch at a time.

The interpreted way (arrays of joined n-grams, sorted and run-length coded by lambdas) costs a
string per n-gram and a comparison call per step. Here a batch of rows is one byte array. Token
bounds are edges of a byte mask, tokens become 64-bit hashes, an n-gram's hash is rolled
from the one of its first n - 1 tokens, and all n-grams of both columns are sorted as plain
numbers with the row in the upper bits: equal n-grams of a row are one run, and the multiset
intersection is one merge of the two lists of runs. No row is looped over, nothing is shuffled.

Within a row two n-grams are told apart by 55 bits of their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Longest n-grams.
ORDERS = 4
#: Rows and bytes of both columns handled at once; a longer text is handled alone. Row numbers take nine bits.
ROWS, BYTES = 512, 4_000_000
_ROW_BITS = 9
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in ".!?,"])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "struct<" + ",".join(f"m{n}:long,t{n}:long,r{n}:long" for n in range(1, ORDERS + 1)) + ",same:boolean>"


def _scrambled(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_STEP), pow(int(_STEP), -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def _tokens(data: np.ndarray, ends: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token. Rows end at ``ends``. White space separates; with ``punctuation`` each of ``.!?,`` is a token."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_WHITE[data]
    alone = _PUNCTUATION[data] if punctuation else np.zeros(len(data), dtype=bool)
    cut = np.zeros(len(data) + 1, dtype=bool)  # a row begins here
    cut[0] = True
    cut[ends] = True
    cut[1:-1] |= alone[1:] | alone[:-1]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge |= cut
    bounds = np.flatnonzero(edge)
    kept = inside[bounds[:-1]]
    first, last = bounds[:-1][kept], bounds[1:][kept]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = _scrambled((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(ends, first, side="right")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _slice_counts(sides: list[tuple[np.ndarray, np.ndarray]], n_rows: int, punctuation: bool, distinct: bool) -> dict[str, np.ndarray]:
    """Per row and n: n-grams in common ``m``, of the second text ``t``, of the first ``r``; and whether the tokens are the same."""
    tokens = [_tokens(data, ends, punctuation) for data, ends in sides]
    out: dict[str, np.ndarray] = {}
    counts = [np.bincount(row, minlength=n_rows) for _, row in tokens]
    same = counts[0] == counts[1]
    first = [np.cumsum(c) - c for c in counts]
    both = np.repeat(same, counts[0])
    at = np.flatnonzero(both)
    rows = tokens[0][1][at]
    partner = at - first[0][rows] + first[1][rows]
    same &= np.bincount(rows, tokens[0][0][at] != tokens[1][0][partner], minlength=n_rows) == 0
    out["same"] = same
    rolled = [h.copy() for h, _ in tokens]
    for n in range(1, ORDERS + 1):
        lists = []
        for k, (h, row) in enumerate(tokens):
            if n > 1:
                rolled[k] = _scrambled(rolled[k][:-1] * _STEP + h[n - 1 :])
            grams, owner = rolled[k], row[: len(rolled[k])]
            whole = owner == row[n - 1 :]
            keys = (owner[whole].astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (grams[whole] >> np.uint64(_ROW_BITS))
            lists.append(_runs(keys))
        for name, (keys, often) in zip("rt", lists):
            owner = (keys >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
            out[f"{name}{n}"] = np.bincount(owner, None if distinct else often, minlength=n_rows).astype(np.int64)
        (left, a), (right, b) = lists
        place = np.minimum(np.searchsorted(right, left), max(len(right) - 1, 0))
        met = np.flatnonzero(right[place] == left) if len(right) else np.empty(0, np.int64)
        common = np.ones(len(met)) if distinct else np.minimum(a[met], b[place[met]])
        owner = (left[met] >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
        out[f"m{n}"] = np.bincount(owner, common, minlength=n_rows).astype(np.int64)
    return out


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def batch_counts(reference: pa.Array, prediction: pa.Array, punctuation: bool, distinct: bool) -> pa.StructArray:
    """The counts of ``_slice_counts`` for all rows of a batch, at most ``ROWS`` rows or about ``BYTES`` bytes at a time."""
    sides = [_parts(c) for c in (reference, prediction)]
    size = np.zeros(len(reference) + 1, dtype=np.int64)
    for _, offsets in sides:
        size += offsets - offsets[0]
    made: list[dict[str, np.ndarray]] = []
    a = 0
    while a < len(reference):
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(size, size[a] + BYTES, side="right")) - 1), len(reference))
        part = [(data[o[a] : o[b]], o[a + 1 : b + 1] - o[a]) for data, o in sides]
        made.append(_slice_counts(part, b - a, punctuation, distinct))
        a = b
    names = [f"{c}{n}" for n in range(1, ORDERS + 1) for c in "mtr"] + ["same"]
    empty = {n: np.empty(0, bool if n == "same" else np.int64) for n in names}
    return pa.StructArray.from_arrays([pa.array(np.concatenate([x[n] for x in [empty, *made]])) for n in names], names=names)


def overlap(reference: Column, prediction: Column, punctuation: bool, distinct: bool = False) -> Column:
    """A struct of n-gram counts for n = 1 to 4: ``m`` in common, ``t`` of the prediction, ``r`` of the reference; and
    ``same``, whether the token lists are equal. Tokens are lower-case and end at white space; with ``punctuation`` each
    of ``. ! ? ,`` is one of its own. Counts clip repeats, or with ``distinct`` leave them out. A null text is empty."""

    @F.arrow_udf(_FIELDS)
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return batch_counts(a, b, punctuation, distinct)

    # lower case as everywhere else in the JVM
    return count(*[F.lower(F.coalesce(c, F.lit(""))) for c in (reference, prediction)])
