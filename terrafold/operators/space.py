"""Space cut into cells that follow the data: small where much meets, large where little does.

A quadtree is grown on a bounded sample of both sides of a join. A cell costs the pairs that meet
in it plus the rows that are copied into it, and it is cut in four while that lowers the
cost. So a crowded city gets cells of the size of the boxes in it, an ocean stays one cell,
and cells smaller than the boxes, which only copy rows, are not made.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import Box

#: Boxes looked at on each side, most cells, what a copied row costs in pairs.
SAMPLE, CELLS, ROW_COST = 4096, 2048, 8.0
#: Most tiles, and what a copied row costs in pairs that are only looked at in arrays.
TILES, COPY_COST = 1024, 2000.0
_CELL = "struct<wide:boolean,cells:array<struct<cell:int,x0:double,y0:double,x1:double,y1:double>>>"


def sample_boxes(df: DataFrame, box: Box, row_id: str, total: int, most: int = SAMPLE) -> np.ndarray:
    """About ``most`` of ``total`` boxes, by a hash of the id."""
    limit = int(min(1.0, most / max(total, 1)) * 2**32)
    known = df.filter(box.known()).filter(F.pmod(F.xxhash64(row_id), F.lit(2**32)) < limit)
    rows = known.select(*[c.cast("double") for c in box]).toPandas().to_numpy(dtype=float).reshape(-1, 4)
    good = np.isfinite(rows).all(axis=1) & (rows[:, 0] <= rows[:, 2]) & (rows[:, 1] <= rows[:, 3])
    return rows[good]


def _touching(boxes: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (boxes[:, 2] >= cell[0]) & (boxes[:, 0] <= cell[2]) & (boxes[:, 3] >= cell[1]) & (boxes[:, 1] <= cell[3])


class Cells:
    """A quadtree that covers the plane. A point is in the cell with ``x0 <= x < x1`` and ``y0 <= y < y1``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, scale: tuple[float, float] = (1.0, 1.0), most: int = CELLS):
        self.bounds: list[np.ndarray] = [np.array([-np.inf, -np.inf, np.inf, np.inf])]
        self.children: list[list[int]] = [[]]
        both = np.concatenate([left, right])
        if len(both):
            world = np.array([both[:, 0].min(), both[:, 1].min(), both[:, 2].max(), both[:, 3].max()])
            self._grow(world, left, right, scale, most)
        self.box = np.array(self.bounds)
        self.first = np.array([c[0] if c else -1 for c in self.children])

    def _grow(self, world: np.ndarray, left: np.ndarray, right: np.ndarray, scale: tuple[float, float], most: int) -> None:
        def cost(a: np.ndarray, b: np.ndarray) -> float:
            n, m = len(a) * scale[0], len(b) * scale[1]
            return n * m + ROW_COST * (n + m)

        def quarters(b: np.ndarray, x: float, y: float) -> list[np.ndarray]:
            return [np.array(q, dtype=float) for q in ((b[0], b[1], x, y), (x, b[1], b[2], y), (b[0], y, x, b[3]), (x, y, b[2], b[3]))]

        def offer(node: int, span: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            x, y = (span[0] + span[2]) / 2, (span[1] + span[3]) / 2
            if not (span[0] < x < span[2] and span[1] < y < span[3]):
                return
            spans, cells = quarters(span, x, y), quarters(self.bounds[node], x, y)
            parts = [(s, c, a[_touching(a, c)], b[_touching(b, c)]) for s, c in zip(spans, cells)]
            now = cost(a, b)
            # a cut that only closes in on a crowd gains nothing itself, but the next one may; costly cells come first
            if now and sum(cost(c, d) for _, _, c, d in parts) <= now * (1 + 1e-12) and span[2] - span[0] > 1e-12 * (world[2] - world[0]):
                heapq.heappush(heap, (-now, node, parts))

        heap: list = []
        offer(0, world, left, right)
        leaves = 1
        while heap and leaves + 3 <= most:
            _, node, parts = heapq.heappop(heap)
            self.children[node] = list(range(len(self.bounds), len(self.bounds) + 4))
            self.bounds += [c for _, c, _, _ in parts]
            self.children += [[] for _ in parts]
            leaves += 3
            for child, (s, _, a, b) in zip(self.children[node], parts):
                offer(child, s, a, b)

    def cover(self, boxes: np.ndarray, known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and cells of the known boxes, in order of the rows; and which are wide: in more than ``most`` cells, or broken.

        Wide boxes have no cells.
        """
        wide = known & ~((boxes[:, 0] <= boxes[:, 2]) & (boxes[:, 1] <= boxes[:, 3]))
        row = np.flatnonzero(known & ~wide)
        node = np.zeros(len(row), dtype=np.int64)
        found = [(row[:0], node[:0])]
        held = np.zeros(len(boxes), dtype=np.int64)
        while len(row):
            cell, box = self.box[node], boxes[row]
            hit = (box[:, 2] >= cell[:, 0]) & (box[:, 0] <= cell[:, 2]) & (box[:, 3] >= cell[:, 1]) & (box[:, 1] <= cell[:, 3])
            row, node = row[hit], node[hit]
            leaf = self.first[node] < 0
            found.append((row[leaf], node[leaf]))
            np.add.at(held, row[leaf], 1)
            row, node = row[~leaf], node[~leaf]
            # an inner cell stands for one leaf at least
            over = held + np.bincount(row, minlength=len(boxes)) > most
            wide |= over
            row, node = row[~over[row]], node[~over[row]]
            row, node = np.repeat(row, 4), (self.first[node][:, None] + np.arange(4)).ravel()
        rows, cells = (np.concatenate(x) for x in zip(*found))
        kept = ~wide[rows]
        order = np.argsort(rows[kept], kind="stable")
        return rows[kept][order], cells[kept][order], wide

    def column(self, box: Box, most: int) -> Column:
        """``struct<wide, cells>`` of a box: the cells it touches, with their bounds."""
        box_of, cover = self.box, self.cover

        @F.arrow_udf(_CELL)
        def covered(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
            sides = (x0, y0, x1, y1)
            boxes = np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in sides]).reshape(-1, 4)
            known = np.all([a.is_valid().to_numpy(zero_copy_only=False) for a in sides], axis=0)
            rows, cells, wide = cover(boxes, known, most)
            edges = pa.array(np.searchsorted(rows, np.arange(len(boxes) + 1)).astype(np.int32))
            parts = [pa.array(cells.astype(np.int32)), *(pa.array(box_of[cells, i]) for i in range(4))]
            lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(parts, names=["cell", "x0", "y0", "x1", "y1"]))
            return pa.StructArray.from_arrays([pa.array(wide), lists], names=["wide", "cells"])

        return covered(*[c.cast("double") for c in box])


class Tiles:
    """The plane cut at the centres of the right boxes (a sample of them), so that each of those is in one tile with all left boxes it touches.

    A tile is a region of centres; its reach is the region widened by half of the largest box that is dealt by tiles. Which boxes are too
    large for that follows from the cost: a tile costs the pairs that meet in it and the rows copied into it, a box without a tile all left rows.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, scale: tuple[float, float], rows: int):
        # of every tile also how many of the left boxes given are in it
        self.regions, self.reach, self.held = np.empty((0, 4)), np.empty((0, 4)), np.empty(0)
        least = None
        for share in (1.0, 0.99, 0.9, 0.5) if len(right) else ():
            sides = np.quantile(right[:, 2:] - right[:, :2], share, axis=0)
            near = right[(right[:, 2:] - right[:, :2] <= sides).all(axis=1)]
            regions = self._cut(left, (near[:, :2] + near[:, 2:]) / 2, sides / 2, rows / max(scale[0], 1e-9))
            reach = regions + np.concatenate([-sides, sides]) / 2
            cost = (len(right) - len(near)) * scale[1] * len(left) * scale[0]
            for region, wide in zip(regions, reach):
                n, m = _touching(left, wide).sum() * scale[0], self._inside((near[:, :2] + near[:, 2:]) / 2, region).sum() * scale[1]
                cost += n * m + COPY_COST * n
            if least is None or cost < least:
                least, self.regions, self.reach = cost, regions, reach
                self.held = np.array([_touching(left, wide).sum() for wide in reach])

    @staticmethod
    def _inside(centres: np.ndarray, region: np.ndarray) -> np.ndarray:
        return (centres[:, 0] >= region[0]) & (centres[:, 0] < region[2]) & (centres[:, 1] >= region[1]) & (centres[:, 1] < region[3])

    @staticmethod
    def _cut(left: np.ndarray, centres: np.ndarray, half: np.ndarray, rows: float) -> np.ndarray:
        """Regions whose reach touches about ``rows`` of the left boxes, where cutting lowers that."""
        done, todo = [], [(np.array([-np.inf, -np.inf, np.inf, np.inf]), left, centres)]
        while todo:
            region, some, mine = todo.pop()
            cuts = []
            if len(some) > rows and len(mine) > 1 and len(done) + len(todo) < TILES:
                for axis in (0, 1):
                    at = np.median(mine[:, axis])
                    parts = [region.copy(), region.copy()]
                    parts[0][axis + 2] = parts[1][axis] = at
                    sides = [mine[:, axis] < at, mine[:, axis] >= at]
                    if sides[0].any():
                        kept = [some[_touching(some, p + np.concatenate([-half, half]))] for p in parts]
                        cuts.append((max(map(len, kept)), sum(map(len, kept)), axis, [(p, k, mine[s]) for p, k, s in zip(parts, kept, sides)]))
            best = min(cuts, key=lambda c: c[:3], default=None)
            if best is not None and best[1] <= 1.5 * len(some):
                todo += best[3]
            else:
                done.append(region)
        return np.array(done)

    def home(self, box: Box) -> Column:
        """The tile of a right box; null for one that is absent, broken or too large."""
        regions, reach, inside = self.regions, self.reach, self._inside

        @F.arrow_udf("int")
        def tile(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
            boxes, known = _arrays(x0, y0, x1, y1)
            known &= np.isfinite(boxes).all(axis=1) & (boxes[:, 0] <= boxes[:, 2]) & (boxes[:, 1] <= boxes[:, 3])
            centres, out = (boxes[:, :2] + boxes[:, 2:]) / 2, np.full(len(boxes), -1, dtype=np.int32)
            for t, (region, wide) in enumerate(zip(regions, reach)):
                fits = (boxes[:, :2] >= wide[:2]).all(axis=1) & (boxes[:, 2:] <= wide[2:]).all(axis=1)
                out[known & fits & inside(centres, region)] = t
            return pa.array(out, mask=out < 0)

        return tile(*[c.cast("double") for c in box])

    def touched(self, box: Box) -> Column:
        """All tiles whose reach a left box touches."""
        reach = self.reach

        @F.arrow_udf("array<int>")
        def tiles(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
            boxes, known = _arrays(x0, y0, x1, y1)
            found = [np.flatnonzero(known & _touching(boxes, wide)) for wide in reach]
            row = np.concatenate([np.empty(0, dtype=np.int64), *found])
            order = np.argsort(row, kind="stable")
            tile = np.repeat(np.arange(len(reach), dtype=np.int32), [len(f) for f in found])[order]
            edges = np.searchsorted(row[order], np.arange(len(boxes) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(edges), pa.array(tile))

        return tiles(*[c.cast("double") for c in box])


def _arrays(*sides: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Boxes, NaN as infinity, which it is greater than for Spark too, and which are known."""
    boxes = np.column_stack([a.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for a in sides]).reshape(-1, 4)
    known = np.all([a.is_valid().to_numpy(zero_copy_only=False) for a in sides], axis=0)
    return np.where(np.isnan(boxes), np.inf, boxes), known
