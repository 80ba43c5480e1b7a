"""Vectorised word hashing over UTF-8 bytes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once.
CHUNK = 1_000_000
BASE = 0x9E3779B97F4A7C15
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts joined by line feeds, about ``size`` bytes at a time: text numbers, their end positions, bytes.

    A longer text comes in several pieces, cut at white space; a word longer
    than ``size`` stays whole.
    """
    numbers: list[int] = []
    parts: list[bytes] = []
    held = 0
    for number, text in enumerate(texts):
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = min(at + size, len(text))
            while end < len(text) and not _WHITE[text[end]]:
                end += 1
            numbers.append(number)
            parts.append(text[at:end])
            held += end - at
            if held >= size:
                yield _joined(numbers, parts)
                numbers, parts, held = [], [], 0
            if not text:
                break
            at = end
    if parts:
        yield _joined(numbers, parts)


def _joined(numbers: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.array(numbers), np.cumsum([len(p) + 1 for p in parts]) - 1, b"\n".join(parts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case) in order, and the first word of each text (one entry more than texts)."""
    counts = np.zeros(len(texts), dtype=np.int64)
    hashes = [np.empty(0, np.uint64)]
    for numbers, ends, data in chunks(texts):
        b = _LOWER[np.frombuffer(data, dtype=np.uint8)]
        first, last = runs(~_WHITE[b])
        hashes.append(span_hashes(b, first, last))
        edges = np.searchsorted(first, ends)
        np.add.at(counts, numbers, np.diff(np.concatenate([[0], edges])))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])
