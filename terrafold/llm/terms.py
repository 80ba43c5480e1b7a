"""Term counts of texts, vectorised over a batch, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernels

_BYTES = np.arange(256)
#: Bytes of terms: ASCII letters and everything above ASCII; with digits in the second.
LETTERS = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LETTERS_DIGITS = LETTERS | ((_BYTES >= 48) & (_BYTES <= 57))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def term_slices(texts: list[bytes], inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The terms (longest runs of ``inside`` bytes, A-Z in lower case) about a megabyte at a time.

    Gives the text number of every term, its length, and the bytes of all terms without gaps. A text may
    come in several slices; no term is cut, as slices end at white space.
    """
    for numbers, ends, raw in kernels.chunks(texts):
        data = np.frombuffer(raw, dtype=np.uint8)
        kept = inside[data]
        first, last = kernels.runs(kept)
        yield numbers[np.searchsorted(ends, first)], last - first, _LOWER[data[kept]]


def numbered(lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every term, and the distinct terms that the numbers stand for."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    told = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    encoded = told.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
