"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

Every task keeps one in-memory DuckDB connection with two small tables made from
the public rank file: ``merges(l, r, id)``, the pairs of tokens whose joined
bytes are a token, and ``vocab(id, hex)``. Words met for the first time go
through a recursive query: its rows are the token positions of the unfinished
words, joined to the merge table; the leftmost pair of the least rank of each
word is contracted until no pair of it is in the table. Decoding is the ordered
aggregation of token bytes by position.

Spark partitions the documents; nothing is shuffled. A task holds a slice of
texts (``SLICE_BYTES``), memos of bounded size and DuckDB's tables.

Words over ``LONG_BYTES`` take a second recursive query that contracts all
non-overlapping occurrences of the least pair, from the left, in one round. That
gives the same result for ranks none of whose extensions have a lower rank
(flag ``safe``), since no pair made on the way can then come first. Other ranks
are contracted one at a time.
"""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Callable, Iterable, Iterator, Sized

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import BATCH_ROWS, short_batches

SLICE_BYTES = 5_000_000
#: Most keys and bytes of a memo between two slices. A worker holds three, and each lookup makes a hash table of the keys beside them.
MEMO = 300_000
MEMO_BYTES = 15_000_000
#: Words of one query.
QUERY_WORDS = 40_000
LONG_BYTES = 300
#: A contraction key is rank * POSITIONS + position.
POSITIONS = 1 << 32

SHORT_SQL = f"""
WITH RECURSIVE state(wid, toks) AS (
  SELECT wid, toks FROM words
  UNION ALL
  SELECT s.wid, list_concat(list_append(s.toks[:b.k % {POSITIONS} - 1], (b.k // {POSITIONS})::INTEGER),
                            s.toks[b.k % {POSITIONS} + 2:])
  FROM state s JOIN (
    SELECT wid, min(id * {POSITIONS}::BIGINT + i) AS k
    FROM (SELECT wid, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i FROM state) p
    JOIN merges USING (l, r) GROUP BY wid
  ) b ON s.wid = b.wid
)
SELECT wid, arg_min(toks, len(toks)) AS toks FROM state GROUP BY wid ORDER BY wid
"""

LONG_SQL = """
WITH RECURSIVE state(wid, toks) USING KEY (wid) AS (
  SELECT wid, toks FROM words
  UNION
  SELECT wid, list(CASE WHEN taken THEN best ELSE l END ORDER BY i) FILTER (WHERE NOT gone) AS toks FROM (
    SELECT wid, i, l, best, taken,
           coalesce(lag(taken) OVER (PARTITION BY wid ORDER BY i), false) AS gone
    FROM (
      SELECT wid, i, l, best, hit AND (CASE WHEN best_safe THEN (i - island) % 2 = 0 ELSE i = first_hit END) AS taken
      FROM (
        SELECT *, max(CASE WHEN NOT hit THEN i ELSE 0 END) OVER (PARTITION BY wid ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS island,
               min(CASE WHEN hit THEN i END) OVER (PARTITION BY wid) AS first_hit,
               bool_or(hit AND safe) OVER (PARTITION BY wid) AS best_safe
        FROM (
          SELECT *, coalesce(id = best, false) AS hit FROM (
            SELECT p.wid, p.i, p.l, m.id, m.safe, min(m.id) OVER (PARTITION BY p.wid) AS best
            FROM (SELECT wid, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i
                  FROM state) p
            LEFT JOIN merges m ON p.l = m.l AND p.r = m.r
          ) a WHERE best IS NOT NULL
        ) b
      ) c
    ) d
  ) e GROUP BY wid
)
SELECT wid, toks FROM state ORDER BY wid
"""

DECODE_SQL = """
SELECT wid, unhex(string_agg(hex, '' ORDER BY i)) AS bytes
FROM (SELECT wid, unnest(toks) AS id, generate_subscripts(toks, 1) AS i FROM words) JOIN vocab USING (id)
GROUP BY wid ORDER BY wid
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Memo:
    """Values by key, both as Arrow arrays. Beyond ``MEMO`` keys only those of the last call stay."""

    def __init__(self):
        self.keys = pa.array([], pa.binary())
        self.values = pa.array([], pa.binary())

    def get(self, keys: pa.BinaryArray, make: Callable[[pa.BinaryArray], pa.BinaryArray]) -> pa.BinaryArray:
        """The values of distinct keys; ``make`` is asked for those not met before."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().copy()
        fresh = at < 0
        if fresh.any():
            new = keys.filter(pa.array(fresh))
            at[fresh] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.values = pa.concat_arrays([self.values, make(new)])
        out = self.values.take(pa.array(at))
        if len(self.keys) > MEMO or self.keys.nbytes + self.values.nbytes > MEMO_BYTES:
            self.keys, self.values = keys, out
        return out


def binary(starts: np.ndarray, data: bytes | np.ndarray) -> pa.BinaryArray:
    """Consecutive pieces of ``data``: one from each start to the next (the last entry is the end)."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]
    )


def offsets_of(pieces: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]


def data_of(pieces: pa.BinaryArray) -> memoryview:
    """The pieces one after the other."""
    starts = offsets_of(pieces)
    return memoryview(pieces.buffers()[2] or b"")[starts[0] : starts[-1]]


def edges(size: int, *places: np.ndarray) -> np.ndarray:
    """The distinct places from 0 to ``size``, in order. They are marked, as hashing or sorting millions of them costs far more."""
    marked = np.zeros(size + 1, dtype=bool)
    for at in places:
        marked[at] = True
    return np.flatnonzero(marked)


def regroup(pieces: pa.BinaryArray, counts: np.ndarray) -> pa.BinaryArray:
    """Join the first ``counts[0]`` pieces, the next ``counts[1]``, and so on."""
    starts = offsets_of(pieces)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return binary(starts[ends] - starts[0], data_of(pieces))


class ByteBpe:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.words, self.units, self.texts = Memo(), Memo(), Memo()
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], i)
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        l, r, i = (np.array(x, dtype=np.int32) for x in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 3
        unsafe = np.unique(np.concatenate([l[l > i], r[r > i]]))
        merges = pa.table({"l": l, "r": r, "id": i, "safe": ~np.isin(i, unsafe)})
        #: Tokens that begin with white space; decoding cuts before them, to meet the same pieces again.
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[n for t, n in ranks.items() if t[:1].isspace()]] = True
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.tables = {"merges": merges, "vocab": vocab}
        self.con: duckdb.DuckDBPyConnection | None = None

    def open(self) -> None:
        """Connect and load the fixed tables."""
        if self.con is None:
            self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
            for name, rows in self.tables.items():
                self._table(name, rows)

    def close(self) -> None:
        if self.con is not None:
            self.con.close()
            self.con = None

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _run(self, sql: str, starts: np.ndarray, tokens: np.ndarray) -> pa.Array:
        """The last column of a query over the token lists that begin at ``starts``, in their order."""
        self.open()
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens, pa.int32()))
        out = []
        for at in range(0, len(lists), QUERY_WORDS):
            some = lists[at : at + QUERY_WORDS]
            self._table("words", pa.table({"wid": pa.array(np.arange(len(some), dtype=np.int32)), "toks": some}))
            out += self.con.sql(sql).to_arrow_table().column(1).chunks
        return pa.concat_arrays(out)

    def _encode(self, words: pa.BinaryArray, sql: str) -> pa.BinaryArray:
        """The ids of distinct words."""
        tokens = self.byte_ids[np.frombuffer(data_of(words), dtype=np.uint8)]
        lists = self._run(sql, offsets_of(words) - offsets_of(words)[0], tokens)
        return binary(lists.offsets.to_numpy() * 4, lists.values.to_numpy().astype("<u4").tobytes())

    def _encode_words(self, words: pa.BinaryArray) -> pa.BinaryArray:
        long = pc.greater(pc.binary_length(words), LONG_BYTES)
        if not pc.any(long).as_py():
            return self._encode(words, SHORT_SQL)
        parts = [words.filter(pc.invert(long)), words.filter(long)]
        coded = [self._encode(p, q) if len(p) else p for p, q in zip(parts, (SHORT_SQL, LONG_SQL))]
        order = pa.concat_arrays(parts)
        return pa.concat_arrays(coded).take(pc.index_in(words, value_set=order))

    def _encode_units(self, units: pa.BinaryArray) -> pa.BinaryArray:
        """The ids of distinct units, each split by the pattern."""
        split = [(u,) if u[1:].isalpha() and (u[0] == " " or u[0].isalpha()) else self.split(u)
                 for u in (x.decode() for x in units.to_pylist())]
        words = pa.array([w.encode() for ws in split for w in ws], pa.binary()).dictionary_encode()
        coded = self.words.get(words.dictionary, self._encode_words).take(words.indices)
        return regroup(coded, np.array([len(ws) for ws in split]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers.

        A match of the pattern always begins at a space between two characters
        that are not white space. Texts are cut there, and equal cuts (units)
        share one split. Spaces beside bytes that may belong to white space
        beyond ASCII stay inside a unit, where the pattern settles them.
        """
        data = b"".join(texts)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not data:
            return [b""] * len(texts)
        b = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(b[1:-1] == 32) + 1
        before, after = b[at - 1], b[at + 1]
        plain_before = ((before > 32) & (before < 127)) | ((b[np.maximum(at - 2, 0)] >= 0xC3) & (b[np.maximum(at - 2, 0)] <= 0xDF))
        plain_after = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF))
        starts = edges(len(data), ends, at[plain_before & plain_after])
        units = binary(starts, data).dictionary_encode()
        coded = self.units.get(units.dictionary, self._encode_units).take(units.indices)
        out = regroup(coded, np.diff(np.searchsorted(starts, ends)))
        return out.to_pylist()

    def _decode_pieces(self, pieces: pa.BinaryArray) -> pa.BinaryArray:
        starts = offsets_of(pieces)
        found = self._run(DECODE_SQL, (starts - starts[0]) // 4, np.frombuffer(data_of(pieces), dtype="<i4"))
        return found.cast(pa.binary())

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence."""
        data = b"".join(coded)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        if not data:
            return [b""] * len(coded)
        starts = edges(len(data), ends, np.flatnonzero(self.opens[np.frombuffer(data, dtype="<u4")]) * 4)
        pieces = binary(starts, data).dictionary_encode()
        texts = self.texts.get(pieces.dictionary, self._decode_pieces).take(pieces.indices)
        return regroup(texts, np.diff(np.searchsorted(starts, ends))).to_pylist()


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of this Python process; later tasks of a reused worker find its memo filled."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def slices(texts: Iterable[Sized], size: int) -> Iterator[list]:
    """Consecutive whole texts of together about ``size``."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give the free pages of both allocators back. Without it every worker keeps the most that one slice took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def rest() -> None:
    """Give back what an idle worker does not need: DuckDB's memory and the allocators' free pages."""
    for bpe in _CODERS.values():
        bpe.close()
    give_back()


def encode_decode(
    df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str = "bytes"
) -> DataFrame:
    """``encode`` and then ``decode`` of the ids it gave, in one pass: adds both columns.

    One worker holds both memos, instead of two workers with a DuckDB each.
    """
    short_batches(df.sparkSession, 3 * BATCH_ROWS)

    @F.pandas_udf("struct<ids:binary,bytes:binary>")
    def both_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for part in parts:
            texts = [b"" if t is None else t.encode() for t in part]
            coded, read = [], []
            for some in slices(texts, SLICE_BYTES):
                new = bpe.encode(some)
                coded += new
                read += bpe.decode(new)
                give_back()
            yield pd.DataFrame({"ids": pd.Series(coded, dtype=object), "bytes": pd.Series(read, dtype=object)})
        rest()

    done = df.withColumn("__coded", both_of(F.col(text)))
    return done.select(*df.columns, F.col("__coded.ids").alias(ids), F.col("__coded.bytes").alias(decoded))


def encode(df: DataFrame, text: str, path: str, pattern: str, name: str = "ids") -> DataFrame:
    """Add ``name``: the token ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers.

    Rows and all other columns stay as they are. Every match of ``pattern`` is
    encoded by itself and special tokens are not known. A very long text is cut
    into words like any other; a very long word takes the second query.
    """
    short_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def ids_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(path, pattern)
        for part in parts:
            texts = [b"" if t is None else t.encode() for t in part]
            yield pd.Series([x for some in slices(texts, SLICE_BYTES) for x in bpe.encode(some)], dtype=object)
        rest()

    return df.withColumn(name, ids_of(F.col(text)))


def decode(df: DataFrame, ids: str, path: str, pattern: str, name: str = "bytes") -> DataFrame:
    """Add ``name``: the bytes of the token ids in ``ids`` (null: no bytes), as ``encode`` makes them.

    An id that the rank file lacks raises an error, as its bytes are not known.
    """
    short_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(path, pattern)
        for part in parts:
            coded = [b"" if x is None else bytes(x) for x in part]
            yield pd.Series([x for some in slices(coded, 2 * SLICE_BYTES) for x in bpe.decode(some)], dtype=object)
        rest()

    return df.withColumn(name, bytes_of(F.col(ids)))
