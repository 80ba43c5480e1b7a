"""Ranked lexical search: exact inner-product search in sparse ball trees.

A document is a sparse integer vector over terms, an item one of term weights, and the score their
inner product. Documents are dealt into blocks; in a block they form a ball tree: every node has
the centroid and the radius of its documents, and the box around them (the largest value of each term);
halves are split along the line through two far documents, and leaves hold a few documents. For an
item q the scores of a node are at most ``q . centroid + |q| radius``, and at most ``q . box``, as nothing is
negative; both are rounded up. Nodes are opened best first, and the search of the block ends when the best
bound left is below the k-th score. Leaves are scored exactly in integers.

Only terms that some item may hold are kept of a document: a bit array of fixed size, made from the items' term hashes,
is tested while texts are read, so other terms are not shuffled and its size does not grow. A share of the blocks is
searched first; the k-th score found there is a lower bound of the final one, so that the full search returns
few rows a block. Terms are compared by 64-bit hashes.

Blocks bound the memory of a task: ``DOCUMENTS`` documents meet ``ITEMS`` items. Nothing is broadcast but the bit array;
there is no key that many documents share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels
from .common import any_id, cut, short_batches
from .terms import LETTERS_DIGITS, term_slices

TOP = 50
#: Documents and items of a block, documents of a leaf, bits of the filter, blocks for each one searched first.
DOCUMENTS = 4096
ITEMS = 1024
LEAF = 48
BITS = 1 << 22
FIRST = 16


# ---- vectors ----------------------------------------------------------------


def _hashes(lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return kernels.span_hashes(data, ends - lengths, ends).astype(np.int64)


def term_vectors(df: DataFrame, row_id: str, text: str, bits: np.ndarray | None) -> DataFrame:
    """``doc, n, h, tf``: number of terms with repeats, hashes of the distinct terms that the bit array lets pass, and how often each occurs."""
    short_batches(df.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            n = np.zeros(len(bodies), dtype=np.int64)
            owners, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for owner, lengths, data in term_slices(bodies, LETTERS_DIGITS):
                n += np.bincount(owner, minlength=len(bodies))
                h = _hashes(lengths, data)
                if bits is not None:
                    at = (h.view(np.uint64) % np.uint64(BITS)).astype(np.int64)
                    passed = (bits[at >> 3] >> (at & 7)) & 1 == 1
                    owner, h = owner[passed], h[passed]
                owners.append(owner)
                hashes.append(h)
            owner, h = np.concatenate(owners), np.concatenate(hashes)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(h))).astype(np.int64)
            edges = pa.array(np.searchsorted(owner[first], np.arange(len(bodies) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (h[first], tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc", "n", "h", "tf"])

    rows = df.select(any_id(row_id).alias("doc"), F.col(text).alias("body"))
    return rows.mapInArrow(read, "doc long, n long, h array<long>, tf array<long>")


def bit_array(terms: DataFrame, column: str) -> np.ndarray:
    """``BITS`` bits with one set for every hash; at most ``BITS / 8`` bytes come to the driver."""
    at = F.expr(f"{column} & {BITS - 1}")  # the hash modulo a power of two, as for unsigned numbers
    piece = (at / 32768).cast("int")
    rows = terms.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg((at % 32768)).alias("bits")).collect()
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows:
        out[row["piece"] * 4096 : row["piece"] * 4096 + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


# ---- ball trees -------------------------------------------------------------


class Rows:
    """Sparse rows: ``columns`` and ``values`` of row i from ``first[i]`` to ``first[i + 1]``; no row is empty."""

    def __init__(self, first: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.first, self.columns, self.values = first, columns, values

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[rows] - first[:-1], sizes) + np.arange(first[-1])
        return Rows(first, self.columns[at], self.values[at])

    def times(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.columns] * self.values, self.first[:-1])

    def __len__(self) -> int:
        return len(self.first) - 1


class BallTree:
    """Nodes with centroid, radius, box and a range of rows; the rows are in the order of the leaves."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centroids, boxes, radii, order = [], [], [], []
        norms = np.add.reduceat(rows.values.astype(float) ** 2, rows.first[:-1])

        def build(members: np.ndarray) -> int:
            node = len(self.spans)
            mine, size = rows.take(members), norms[members]
            centre = np.bincount(mine.columns, mine.values, minlength=width) / len(members)
            own = float(centre @ centre)
            # squared distances by difference of large numbers: the slack covers what that loses
            apart = size - 2 * mine.times(centre) + own
            slack = 1e-9 * (size + own)
            centroids.append(centre)
            radii.append(float(np.sqrt(np.maximum(apart + slack, 0).max())))
            self.spans.append((len(order), len(order) + len(members)))
            self.children.append(None)
            boxes.append(np.zeros(width))
            if len(members) <= leaf:
                np.maximum.at(boxes[node], mine.columns, mine.values)
                order.extend(members.tolist())
                return node
            far = int(np.argmax(apart))
            one = np.zeros(width)
            one[mine.columns[mine.first[far] : mine.first[far + 1]]] = mine.values[mine.first[far] : mine.first[far + 1]]
            farther = int(np.argmax(size - 2 * mine.times(one)))
            one[mine.columns[mine.first[farther] : mine.first[farther + 1]]] -= mine.values[mine.first[farther] : mine.first[farther + 1]]
            along = np.argsort(mine.times(one), kind="stable")
            half = len(members) // 2
            a, b = self.children[node] = (build(members[along[:half]]), build(members[along[half:]]))
            np.maximum(boxes[a], boxes[b], out=boxes[node])
            return node

        build(np.arange(len(rows)))
        self.order = np.array(order)
        self.rows = rows.take(self.order)
        self.centroids, self.boxes, self.radii = np.array(centroids), np.array(boxes), np.array(radii)

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a node scores more than this."""
        w = weights.astype(float)
        ball = self.centroids[:, columns] @ w + np.sqrt(w @ w) * self.radii
        return np.minimum(ball, self.boxes[:, columns] @ w) * (1 + 1e-9) + 1

    def best(self, columns: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of all documents that may be among the ``k`` best and score ``least`` or more; leaves opened."""
        bounds = self.bounds(columns, weights)
        dense = np.zeros(self.centroids.shape[1], dtype=np.int64)
        dense[columns] = weights
        heap = [(-bounds[0], 0)]
        rows, scores, opened = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        top = np.empty(0, np.int64)
        bar = least
        while heap and -heap[0][0] >= bar:
            node = heapq.heappop(heap)[1]
            if self.children[node] is None:
                a, b = self.spans[node]
                lo, hi = self.rows.first[a], self.rows.first[b]
                s = np.add.reduceat(dense[self.rows.columns[lo:hi]] * self.rows.values[lo:hi], self.rows.first[a:b] - lo)
                good = np.flatnonzero(s >= bar)
                rows.append(good + a)
                scores.append(s[good])
                opened += 1
                top = np.concatenate([top, s[good]])
                if len(top) >= k:
                    top = np.partition(top, len(top) - k)[len(top) - k :]
                    bar = max(bar, int(top.min()))
            else:
                for child in self.children[node]:
                    if bounds[child] >= bar:
                        heapq.heappush(heap, (-bounds[child], child))
        return self.order[np.concatenate(rows)], np.concatenate(scores), opened


def vector_rows(table: pa.Table, count: int, terms: int) -> tuple[np.ndarray, Rows, np.ndarray]:
    """Ids, rows of term values, and the sorted hashes that the columns stand for.

    ``m = 50 + (50 n count) div terms`` and a value is ``(10 ** 9 tf) div (1000 tf + 20 m)``.
    """
    h, tf = (table[c].combine_chunks() for c in ("h", "tf"))
    sizes = np.diff(h.offsets.to_numpy())
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    m = 50 + (50 * table["n"].to_numpy() * count) // terms
    times = tf.flatten().to_numpy()
    values = (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, sizes))
    known, columns = np.unique(h.flatten().to_numpy(), return_inverse=True)
    return table["doc"].to_numpy(), Rows(first, columns, values), known


def search_block(documents: pa.Table, items: pa.Table, count: int, terms: int, k: int) -> pa.Table:
    """The best documents of a block for every item: ``item, doc, score``."""
    found: list[tuple] = []
    if documents.num_rows and items.num_rows:
        # in the order of ids, so that a block is the same at any partitioning
        documents = documents.sort_by([("doc", "ascending"), ("n", "ascending")])
        ids, rows, known = vector_rows(documents, count, terms)
        tree = BallTree(rows, len(known))
        for item, h, w, least in zip(*(items[c].to_pylist() for c in ("item", "h", "w", "least"))):
            h, w = np.array(h, dtype=np.int64), np.array(w, dtype=np.int64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            here = known[at] == h
            at_rows, scores, _ = tree.best(at[here], w[here], k, max(1, least))
            top = np.lexsort((ids[at_rows], -scores))[:k]
            found.append((np.full(len(top), item), ids[at_rows[top]], scores[top]))
    empty = np.empty(0, dtype=np.int64)
    return pa.table([np.concatenate([empty, *(f[i] for f in found)]).astype(np.int64) for i in range(3)], names=["item", "doc", "score"])


# ---- the search -------------------------------------------------------------


def search(
    df: DataFrame, items: DataFrame, k: int = TOP, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item, rank, doc, score``: the ``k`` highest-scoring documents of every item, scores above 0 only, ties to the smaller id.

    Every row of ``df`` is a document, also where ids or texts repeat; rows of ``items`` that share an id are
    one item with the terms of all. Null ids are ids below all others (``any_id``); null texts have no terms. Documents
    without terms count nowhere, items without any found term give no rows. Other columns are not read.
    """
    asked = term_vectors(items, item_id, item_text, None).select(F.col("doc").alias("item"), F.explode("h").alias("h")).distinct()
    asked = cut(asked)
    vectors = cut(term_vectors(df, row_id, text, bit_array(asked, "h")))
    count, terms, able = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("h") > 0)).first()
    holding = vectors.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(holding, "h").select("item", "h", weight.alias("w")).filter("w > 0")
    n_items = asked.select("item").distinct().count()
    blocks, item_blocks = -(-able // DOCUMENTS) or 1, -(-n_items // ITEMS) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = weighted.groupBy("item").agg(F.collect_list(F.struct("h", "w")).alias("t"))
    wanted = cut(wanted.select("item", deal("item", item_blocks).alias("q"), F.col("t.h").alias("h"), F.col("t.w").alias("w")))
    # rows that share an id are dealt by their terms too
    placed = vectors.filter(F.size("h") > 0).withColumn("c", F.pmod(F.xxhash64("doc", "n", "h"), F.lit(blocks)).cast("int"))

    def meet(documents: DataFrame, questions: DataFrame, n: int) -> DataFrame:
        left = documents.withColumn("q", every(item_blocks)).groupBy("c", "q")
        right = questions.withColumn("c", every(n)).groupBy("c", "q")
        block = lambda a, b: search_block(a, b, count, terms, k)
        return left.cogroup(right).applyInArrow(block, "item long, doc long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        order = W.partitionBy("item").orderBy(F.desc("score"), "doc")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)

    some = -(-blocks // FIRST)
    first = ranked(meet(placed.filter(F.col("c") < some), wanted.withColumn("least", F.lit(1).cast("long")), some))
    least = first.filter(F.col("rank") == k).select(F.col("item").alias("__item"), F.col("score").alias("least"))
    bounded = wanted.join(least, F.col("item") == F.col("__item"), "left").select("item", "q", "h", "w", F.coalesce("least", F.lit(1).cast("long")).alias("least"))
    return ranked(meet(placed, cut(bounded), blocks)).select("item", "rank", "doc", "score")
