"""Batch retrieval: a table of queries against the catalog, and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores, text as tx, vectors
from ..functions.geo import Box
from ..session import materialize
from .best_pairs import query_scene_best
from .catalog import newest_first
from .joins import QUERY_BOX, query_scene_join
from .ordered import first_rows, with_range_rank
from .ranked_pairs import query_scene_ranks

def topk_per_query(
    scored: DataFrame, k: int, query: str = "query_id", score: str = "score", item: str = "scene_id", name: str = "rank"
) -> DataFrame:
    """Best ``k`` per query, score descending, ties by id; ``rank`` starts at 1."""
    return first_rows(scored, [query], [F.desc(score), F.asc(item)], k, name)


def result_rank(results: DataFrame, query: str = "query_id", score: str = "score", item: str = "scene_id") -> DataFrame:
    """All results with their 1-based ``rank`` per query, score descending, ties by id."""
    return with_range_rank(results, [query], [F.desc(score), F.asc(item)], "rank")


def result_rank_join(scenes: DataFrame, queries: DataFrame, score: Column, more: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """``result_rank`` of the pairs of ``query_scene_join`` by a value of the scene: ``query_id, scene_id, score, rank``, the columns ``more`` of the queries and ``also`` of the scenes.

    Pairs get their ranks where they are found (``query_scene_ranks``) and are never shuffled, sorted or kept. Ids that several queries share (or
    null ones) are ranked across their rows by ``result_rank``.
    """
    scenes = scenes.withColumn("score", score.cast("double"))
    shared = materialize(queries.groupBy(F.col("query_id").alias("__id")).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("__id").isNull()).select("__id"))
    own = queries.join(shared, F.col("query_id").eqNullSafe(F.col("__id")), "left_anti")
    names = ["query_id", *more, "scene_id", "score", *also]
    ranked = query_scene_ranks(scenes, own, "score", ["scene_id", "score", *also], ["query_id", *more]).select(*names, "rank")
    if not shared.head(1):
        return ranked
    twice = queries.join(shared, F.col("query_id").eqNullSafe(F.col("__id")), "left_semi")
    return ranked.unionByName(result_rank(query_scene_join(scenes, twice).select(*names)))


def two_stage_topk(
    scored: DataFrame, k: int, first: str, second: str, query: str = "query_id", item: str = "scene_id"
) -> DataFrame:
    """Keep 2k by the first score, then k of those by the second."""
    kept = topk_per_query(scored, 2 * k, query, first, item, "__r").drop("__r")
    return topk_per_query(kept, k, query, second, item)


# ---- vector search ---------------------------------------------------------

#: Rows multiplied at a time inside a task, and queries.
CHUNK_ROWS, CHUNK_QUERIES = 2048, 1024
#: Bytes of the vectors that one task holds of either side, and tiles that a smaller corpus is cut into.
TILE_BYTES, TILES = 1 << 24, 16


def _keep_best(rows: np.ndarray, places: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of every row (score descending, place ascending), in order of the rows."""
    order = np.lexsort((places, -found, rows))
    rows, places, found = rows[order], places[order], found[order]
    chosen = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[chosen], places[chosen], found[chosen]


def _matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors, rounded so that equal vectors tie."""
    parts = [np.einsum("ij,ij->i", left[i[at : at + 65536]], right[j[at : at + 65536]]) for at in range(0, len(i), 65536)]
    return np.round(np.concatenate([np.empty(0), *parts]), 12)


def _search_tile(items: pa.Table, block: pa.Table, k: int, max_queries: int, max_rows: int) -> pa.Table:
    """Best ``k`` items of a tile for every query of a block, of those in the groups it visits and not below its bound.

    Products in single precision leave out what is below the bound by more than they can be wrong; the rest is multiplied exactly.
    """
    names = ["query_id", "item_id", "score"]
    if not items.num_rows or not block.num_rows:
        return pa.table([block["query_id"].slice(0, 0), items["item_id"].slice(0, 0), pa.array([], pa.float64())], names=names)
    dim = items["dim"][0].as_py()
    slack = (dim + 8) * 1.2e-7 + 1e-6
    by_id = pc.sort_indices(items["item_id"], null_placement="at_start").to_numpy()
    place = np.empty(len(by_id), dtype=np.int64)
    place[by_id] = np.arange(len(by_id))
    vectors_, asked = _matrix(items["v"], dim), _matrix(block["v"], dim)
    pivot = items["pivot"].to_numpy()
    by_pivot = np.argsort(pivot, kind="stable")
    groups, edges = np.unique(pivot[by_pivot], return_index=True)
    segments = np.split(by_pivot, edges[1:])
    lists = block["pivots"].combine_chunks()
    owner, wanted = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    visitors = [owner[wanted == g] for g in groups]
    bound = block["bound"].to_numpy().copy()
    short, short_asked = vectors_.astype(np.float32), asked.astype(np.float32)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(asked), max_queries):
        best = out[0]
        for segment, all_visitors in zip(segments, visitors):
            q = all_visitors[slice(*np.searchsorted(all_visitors, [at, at + max_queries]))]
            for start in range(0, len(segment) if len(q) else 0, max_rows):
                part = segment[start : start + max_rows]
                near = short_asked[q] @ short[part].T
                if len(part) >= k and bound[q].min() <= -1.0:
                    # k rows are at least as near as the k-th of these, less what a product is wrong by
                    bound[q] = np.maximum(bound[q], np.partition(near, len(part) - k, axis=1)[:, len(part) - k] - slack)
                i, j = np.nonzero(near >= (bound[q] - slack).astype(np.float32)[:, None])
                score = _products(asked, vectors_, q[i], part[j])
                kept = score >= bound[q[i]]
                best = tuple(np.concatenate(x) for x in zip(best, (q[i][kept], place[part[j][kept]], score[kept])))
                if len(best[0]) > 2 * k * max_queries:
                    best = _keep_best(*best, k)
                    row, first = np.unique(best[0], return_index=True)
                    full = np.diff(np.append(first, len(best[0]))) == k
                    last = first[full] + k - 1
                    bound[row[full]] = np.maximum(bound[row[full]], best[2][last])
        out.append(_keep_best(*best, k))
    rows, places, found = (np.concatenate(x) for x in zip(*out))
    return pa.table([block["query_id"].take(pa.array(rows)), items["item_id"].take(pa.array(by_id[places])), pa.array(found)], names=names)


def usable_vector(vector: Column) -> Column:
    """Vectors that have a direction: no nulls, finite components, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & (vectors.norm(vector) > 0), F.lit(False))


def unusable_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """One row with ``total`` and ``unusable``: how many vectors a search leaves out."""
    return rows.agg(F.count("*").alias("total"), F.count_if(~usable_vector(F.col(vector))).alias("unusable"))


#: Corpus vectors that serve as pivots, about; what rounding may add to an angle.
PIVOTS, SLACK = 64, 1e-6


def _unit_vectors(rows: DataFrame, key: str, name: str, vector: str) -> DataFrame:
    values = rows.select(F.col(key).alias(name), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    values = values.filter(usable_vector(F.col("v")))
    return values.select(name, F.size("v").alias("dim"), vectors.l2_normalize(F.col("v")).alias("v"))


class Pivots:
    """Unit vectors of one dimension each, which corpus vectors are grouped around."""

    def __init__(self, sample: list[np.ndarray]):
        self.of = {d: np.unique(np.stack([v for v in sample if len(v) == d]), axis=0) for d in {len(v) for v in sample}}

    def angles(self, batch: pd.Series) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Per dimension the places of its vectors in a batch, the dimension, and their angles to all its pivots (none: one pivot at no angle)."""
        sizes = np.array([len(x) for x in batch], dtype=np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            if dim in self.of:
                yield at, dim, np.arccos(np.clip(np.stack(batch.to_numpy()[at]) @ self.of[dim].T, -1.0, 1.0))
            else:
                yield at, dim, np.zeros((len(at), 1))

    def nearest(self, v: Column) -> Column:
        """``struct<pivot, angle>``."""
        angles = self.angles

        @F.pandas_udf("struct<pivot:int,angle:double>")
        def near(batch: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"pivot": np.zeros(len(batch), dtype=np.int32), "angle": np.zeros(len(batch))})
            for at, _, found in angles(batch):
                out.loc[at, "pivot"], out.loc[at, "angle"] = found.argmin(axis=1).astype(np.int32), found.min(axis=1)
            return out

        return near(v)

    def reachable(self, v: Column, bound: Column, radii: dict[tuple[int, int], float]) -> Column:
        """The pivots whose groups may hold a vector of cosine ``bound`` or more.

        A vector of a group is within its radius of the pivot, so its angle to the query is at least the query's to the pivot less the
        radius (triangle inequality of angles).
        """
        angles = self.angles

        @F.pandas_udf("array<int>")
        def reach(batch: pd.Series, bounds: pd.Series) -> pd.Series:
            out: list[np.ndarray] = [np.empty(0, np.int32)] * len(batch)
            apart = np.arccos(np.clip(bounds.to_numpy() - 1e-9, -1.0, 1.0)) + SLACK
            for at, dim, found in angles(batch):
                reach_of = np.array([radii.get((dim, p), -10.0) for p in range(found.shape[1])])
                for i, near in zip(at, found - reach_of <= apart[at][:, None]):
                    out[i] = np.flatnonzero(near).astype(np.int32)
            return pd.Series(out)

        return reach(v, bound)


def _tiles(sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """First tile of every group, and how many it is cut into. Small groups of one dimension share a tile of about the rows one task takes."""
    out, tile, held, last = {}, -1, 0, None
    for (dim, pivot), n in sorted(sizes.items()):
        total = sum(m for (d, _), m in sizes.items() if d == dim)
        most = max(1, min(TILE_BYTES // (8 * max(dim, 1)), max(1024, -(-total // TILES))))
        parts = -(-n // most)
        if parts > 1 or dim != last or held + n > most:
            tile, held = tile + 1, 0
        out[dim, pivot] = (tile, parts)
        tile += parts - 1
        held, last = held + n if parts == 1 else most, dim
    return out


class Plan(NamedTuple):
    """What an exact search needs: the corpus as ``item_id, v, dim, pivot, tile`` and the queries as ``query_id, v, dim, bound, pivots``, the groups they visit."""

    items: DataFrame
    visits: DataFrame
    tiles: dict[tuple[int, int], tuple[int, int]]


def knn_plan(
    queries: DataFrame, corpus: DataFrame, k: int, max_block: int = 4096, rows_per_group: int = 100_000,
    query_key: str = "query_id", item_key: str = "item_id", vector: str = "vector",
) -> Plan:
    """Groups of the corpus, their tiles, and the groups that every query visits."""
    unit_q, unit_c = _unit_vectors(queries, query_key, "query_id", vector), _unit_vectors(corpus, item_key, "item_id", vector)
    place = F.pmod(F.xxhash64("item_id"), F.lit(2**32))
    total = unit_c.count()
    limit = int(min(1.0, PIVOTS / max(total, 1)) * 2**32)
    pivots = Pivots([np.asarray(r["v"]) for r in unit_c.filter(place < limit).select("v").collect()])
    near = unit_c.withColumn("__p", pivots.nearest(F.col("v"))).select("item_id", "v", "dim", "__p.pivot", "__p.angle")
    near = materialize(near)
    # one row per pivot, and one per dimension without pivots
    groups = near.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radii = {(r["dim"], r["pivot"]): r["radius"] for r in groups}
    tiles = _tiles({(r["dim"], r["pivot"]): r["n"] for r in groups})
    part = F.pmod(F.xxhash64("item_id"), _of_group(tiles, 1))
    items = near.drop("angle").withColumn("tile", (_of_group(tiles, 0) + part).cast("int"))
    # a first bound of the k-th score from one tile of the nearest group
    unit_q = materialize(unit_q.withColumn("__p", pivots.nearest(F.col("v"))).select("query_id", "v", "dim", "__p.pivot"))
    first = unit_q.withColumns({"bound": F.lit(-1.0), "pivots": F.array("pivot"), "tiles": F.array(_of_group(tiles, 0))})
    types = [df.schema[key].dataType.simpleString() for df, key in ((corpus, item_key), (queries, query_key))]
    seen = _met(items, first.filter(F.get("tiles", F.lit(0)).isNotNull()), k, max_block, rows_per_group, *types)
    bound = topk_per_query(seen, k, item="item_id").filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    asked = unit_q.drop("pivot").join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    return Plan(items, asked.withColumn("pivots", pivots.reachable(F.col("v"), F.col("bound"), radii)), tiles)


def _of_group(tiles: dict[tuple[int, int], tuple[int, int]], at: int) -> Column:
    """First tile (0) or number of tiles (1) of the group ``dim, pivot``; null for a group without rows."""
    table = [F.lit(x) for (dim, pivot), found in tiles.items() for x in (f"{dim} {pivot}", found[at])]
    return F.try_element_at(F.create_map(*table), F.concat_ws(" ", "dim", "pivot")) if table else F.lit(None).cast("int")


def _visited_tiles(tiles: dict[tuple[int, int], tuple[int, int]]) -> Column:
    """Every tile with rows of the groups ``pivots``, once."""

    @F.pandas_udf("array<int>")
    def visited(dims: pd.Series, lists: pd.Series) -> pd.Series:
        spans = [[tiles[dim, p] for p in found if (dim, p) in tiles] for dim, found in zip(dims.tolist(), lists)]
        return pd.Series([np.unique([t for first, n in some for t in range(first, first + n)]).astype(np.int32) for some in spans], dtype=object)

    return visited(F.col("dim"), F.col("pivots"))


def _met(items: DataFrame, asked: DataFrame, k: int, max_block: int, rows_per_group: int, item_type: str, query_type: str) -> DataFrame:
    """Best ``k`` of every visited tile: ``query_id, item_id, score``. The queries of a tile are cut into blocks of bounded bytes."""
    asked = asked.select("query_id", "v", "dim", "bound", "pivots", F.explode("tiles").alias("tile"))
    most = F.greatest(F.lit(TILE_BYTES) / (8 * F.max("dim")), F.lit(1))
    blocks = F.broadcast(materialize(asked.groupBy("tile").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))))
    asked = asked.join(blocks, "tile").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    offered = items.join(blocks, "tile").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["tile", "block"]
    sizes = max(1, min(max_block, CHUNK_QUERIES)), max(1, min(rows_per_group, CHUNK_ROWS))
    schema = f"query_id {query_type}, item_id {item_type}, score double"
    return offered.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(lambda a, b: _search_tile(a, b, k, *sizes), schema)


def visited_share(items: DataFrame, visits: DataFrame, tiles: dict | None = None) -> float:
    """Of all pairs of a query and a corpus vector of its dimension, the share that the visits meet."""
    sizes = items.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
    met = visits.select("dim", F.explode("pivots").alias("pivot")).join(sizes, ["dim", "pivot"]).agg(F.sum("n")).first()[0] or 0
    every = visits.select("query_id", "dim").distinct().join(items.groupBy("dim").agg(F.count("*").alias("n")), "dim").agg(F.sum("n")).first()[0]
    return met / every if every else 0.0


def knn_cosine(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    max_block: int = 4096,
    rows_per_group: int = 100_000,
    query_key: str = "query_id",
    item_key: str = "item_id",
    vector: str = "vector",
) -> DataFrame:
    """Exact top ``k`` corpus items per query by cosine: ``query_id, item_id, score, rank``.

    Corpus vectors gather around about ``PIVOTS`` of their own. A query first searches the nearest group for a bound of its
    k-th score, and then only the groups that the angles allow to reach it. Groups share tiles of bounded bytes, large ones are cut
    into several, and a query travels once per tile, with its bound and the groups it visits. A task holds one tile and a block of
    queries, multiplies at most ``max_block`` queries with ``rows_per_group`` rows at a time, and passes on only the best ``k``
    per query; no full pair list is written and nothing but pivots, group radii and counts
    comes to the driver. Vectors without a direction are left out (``usable_vector``).
    """
    items, visits, tiles = knn_plan(queries, corpus, k, max_block, rows_per_group, query_key, item_key, vector)
    types = [df.schema[key].dataType.simpleString() for df, key in ((corpus, item_key), (queries, query_key))]
    asked = materialize(visits.withColumn("tiles", _visited_tiles(tiles)))
    return topk_per_query(_met(items, asked, k, max_block, rows_per_group, *types), k, item="item_id")


# ---- semantic ranking ------------------------------------------------------

Embed = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed_column(text: Column, embed: Embed | None) -> Column:
    """Vector of a text: the built-in hash embedding, or a user function over Arrow batches."""
    if embed is None:
        return vectors.hash_embedding(text)
    from pyspark.sql.functions import pandas_udf

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from embed(batches)

    return pandas_udf(encode, "array<double>")(text)


def text_vectors(rows: DataFrame, text: str, embed: Embed | None, name: str) -> DataFrame:
    """``text, name``: the vector of every distinct text that is not blank."""
    some = rows.select(F.col(text).alias("__t")).filter(F.trim("__t") != "").distinct()
    return some.select(F.col("__t").alias(text), embed_column(F.col("__t"), embed).alias(name))


def semantic_rank(
    candidates: DataFrame,
    k: int | None,
    query_text: str,
    scene_text: str,
    neutral: float = 0.5,
    embed: Embed | None = None,
) -> DataFrame:
    """Score candidate pairs by cosine of query and scene text; a blank text scores ``neutral``.

    Each distinct text is embedded once, however many pairs it is in.
    """
    dim = vectors.HASH_DIM if embed is None else None
    sides = [text_vectors(candidates, t, embed, n) for t, n in ((query_text, "__q"), (scene_text, "__s"))]
    with_vectors = candidates.join(sides[0], query_text, "left").join(sides[1], scene_text, "left")
    known = F.col("__q").isNotNull() & F.col("__s").isNotNull()
    score = F.when(known, vectors.dot(F.col("__q"), F.col("__s"), dim)).otherwise(F.lit(float(neutral)))
    scored = with_vectors.withColumn("score", score).select(*candidates.columns, "score")
    return scored if k is None else topk_per_query(scored, k)


def semantic_rank_join(
    scenes: DataFrame, queries: DataFrame, k: int, query_text: Column, scene_text: Column, neutral: float = 0.5, embed: Embed | None = None
) -> DataFrame:
    """``semantic_rank`` of the pairs of ``query_scene_join``: ``query_id, scene_id, score, rank``.

    With the built-in embedding the best ``k`` are found inside tasks (``query_scene_best``) and only they are rows; with
    a function of the user all pairs are.
    """
    left, right = scenes.withColumn("__st", scene_text), queries.withColumn("__qt", query_text)
    if embed is None:
        digest = lambda t: F.when(F.trim(t) != "", F.unhex(F.md5(t)))
        named = [c for c in ("scene_id", "acquisition_time", "sensor", "object", *Box._fields) if c in scenes.columns]
        left = left.select(*named, "__st", digest("__st").alias("__sv"))
        silent = F.coalesce(F.trim("__qt"), F.lit("")) == ""
        pairs = query_scene_best(left, right.withColumn("__qv", digest("__qt")), k, silent, neutral, fuse=False, absent=neutral)
    else:
        pairs = query_scene_join(left, right)
    pairs = pairs.select("query_id", "scene_id", "__qt", "__st")
    # the few pairs are read three times
    ranked = semantic_rank(materialize(pairs) if embed is None else pairs, k, "__qt", "__st", neutral, embed)
    return ranked.select("query_id", "scene_id", "score", "rank")


def relax_empty(scenes: DataFrame, queries: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Offer the ``n`` newest scenes to queries that matched nothing."""
    newest = scenes.orderBy(*newest_first()).limit(n).agg(F.collect_list(F.struct(*scenes.columns)).alias("a"))
    lonely = queries.join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    offered = lonely.withColumn("__s", F.explode(newest.scalar())).select(*queries.columns, "__s.*")
    return candidates.unionByName(offered)


def retrieve_batch(
    scenes: DataFrame,
    queries: DataFrame,
    k: int = 10,
    fuse: bool = True,
    relax_when_empty: int = 0,
    weights: dict[str, float] | None = None,
    embed: Embed | None = None,
    end_inclusive_day: bool = False,
) -> DataFrame:
    """Filter, rank by text similarity (2k), fuse four scores (k), for every query in one plan.

    ``fuse=False`` ranks by similarity of the query text and the
    sensor/modality/object text alone. ``relax_when_empty`` is the number of
    newest scenes offered to queries that matched nothing (0: none).
    """
    if fuse:
        s_text = F.concat(F.coalesce("object", F.lit("")), F.lit(" "), F.col("scene_id"))
        q_text = tx.semantic_query_text(F.col("text_query"), F.col("query_object"))
    else:
        s_text = tx.scene_text(F.col("sensor"), F.col("modality"), F.col("object"))
        q_text = F.col("text_query")
    # vectors of a function of the user are made once per scene and once per query, before the pairs exist; those of the built-in one travel as digests
    vector = (lambda text: embed_column(text, embed)) if embed else lambda text: F.unhex(F.md5(text))
    left = scenes.withColumn("__sv", vector(s_text))
    right = queries.withColumns({"__qt": q_text, "__qv": vector(q_text)})
    silent = F.coalesce(F.trim("__qt"), F.lit("")) == ""
    neutral = 0.0 if fuse else 0.5
    if embed is None:
        # the best of the first stage are found inside tasks; a query keeps 2k of its pairs, or k where that is the only stage
        named = ["scene_id", "acquisition_time", "sensor", "cloud_cover", "object", *Box._fields, "__sv"]
        left = left.select(*[c for c in named if c in left.columns])
        pairs = query_scene_best(left, right, 2 * k if fuse else k, silent, neutral, weights, fuse, end_inclusive_day)
    else:
        pairs = query_scene_join(left, right, end_inclusive_day=end_inclusive_day)
    if relax_when_empty:
        pairs = relax_empty(left, right, pairs, relax_when_empty)
    dim = vectors.HASH_DIM if embed is None else None
    if embed is None:
        pairs = pairs.withColumns({c: vectors.digest_embedding(F.hex(c)) for c in ("__qv", "__sv")})
    similarity = F.when(silent, F.lit(neutral)).otherwise(vectors.dot(F.col("__qv"), F.col("__sv"), dim))
    pairs = pairs.withColumn("semantic_sim", similarity)
    # only ids and scores are sorted and shuffled; scene columns join the few survivors at the end
    if not fuse:
        top = topk_per_query(pairs.select("query_id", "scene_id", F.col("semantic_sim").alias("score")), k)
        return _with_scene_columns(top, scenes)
    box, q_box = Box.named(), Box.named(QUERY_BOX)
    scored = pairs.select(
        "query_id",
        "scene_id",
        silent.alias("__silent"),
        "change_flag",
        "semantic_sim",
        scores.score_geo(box, q_box).alias("geo_score"),
        scores.score_temporal(F.col("acquisition_time"), F.col("start_date"), F.col("end_date")).alias("temporal_score"),
        scores.score_modality(
            F.col("sensor"), F.col("sensors"), F.col("cloud_cover"), F.col("cloud_cover_max")
        ).alias("modality_score"),
    )
    fused = scores.score_composite(
        F.col("geo_score"), F.col("temporal_score"), F.col("semantic_sim"), F.col("modality_score"),
        F.col("change_flag"), weights,
    )
    scored = scored.withColumn("score", fused)
    # a query without text is not cut by similarity: its first stage orders by the final score
    first = F.when(F.col("__silent"), F.col("score")).otherwise(F.col("semantic_sim"))
    staged = scored.withColumn("__first", first).drop("__silent", "change_flag")
    return _with_scene_columns(two_stage_topk(staged, k, "__first", "score").drop("__first"), scenes)


def engine_rank(scenes: DataFrame, queries: DataFrame, k: int, embed: Embed | None = None) -> DataFrame:
    """Similarity-only retrieval: best ``k`` scenes per query by text alone, ``rank`` from 1.

    A scene passes if its sensor is the query's or ``both``, it is dated within the
    bounds and its box touches the query's; the object is not filtered, and scenes
    without date or sensor never pass. A query of both sensors takes any.
    """
    known = scenes.filter(F.col("acquisition_time").isNotNull() & F.col("sensor").isNotNull())
    one = F.size(F.array_distinct("sensors")) == 1
    asked = queries.withColumn("sensors", F.when(one, F.array(F.get("sensors", F.lit(0)), F.lit("both"))))
    asked = asked.withColumn("query_object", F.lit(None).cast("string"))
    return retrieve_batch(known, asked, k, fuse=False, embed=embed)


def _with_scene_columns(top: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene columns of the ranked results; the score parts become one struct."""
    names = ["scene_id", "sensor", "modality", "acquisition_time", "object", "paired_scene_id", "cloud_cover"]
    parts = [c for c in ("semantic_sim", "geo_score", "temporal_score", "modality_score") if c in top.columns]
    if parts:
        top = top.withColumn("score_breakdown", F.struct(*parts)).drop(*parts)
    return top.join(scenes.select(*names), "scene_id")


# ---- selections on ranked results ------------------------------------------


def select_change_pair(results: DataFrame) -> DataFrame:
    """t1 is the best result; t2 its pair if it was returned too, else the second best, else an error."""
    # in one pass, as the results are costly: the few ids of a query are looked through for the pair
    best = results.groupBy("query_id").agg(
        F.min_by(F.struct("scene_id", "paired_scene_id"), "rank").alias("__t1"),
        F.max(F.when(F.col("rank") == 2, F.col("scene_id"))).alias("__second"),
        F.collect_list("scene_id").alias("__ids"),
    )
    partners = F.filter("__ids", lambda x: F.col("query_id").isNotNull() & (x == F.col("__t1.paired_scene_id")))
    joined = best.withColumn("__pair", F.explode_outer(partners))
    t2 = F.coalesce("__pair", "__second")
    error = "No comparable second observation available for the requested time window."
    return joined.select(
        "query_id",
        F.col("__t1.scene_id").alias("t1"),
        t2.alias("t2"),
        F.when(t2.isNull(), error).alias("error"),
    )


def select_fusion_pair(results: DataFrame) -> DataFrame:
    """Best optical and best radar result of every query, else an error."""
    optical = F.col("modality").isin("optical", "multispectral")
    radar = F.col("modality") == "sar"
    picked = results.groupBy("query_id").agg(
        F.min_by("scene_id", F.when(optical, F.col("rank"))).alias("optical_id"),
        F.min_by("scene_id", F.when(radar, F.col("rank"))).alias("sar_id"),
    )
    missing = F.col("optical_id").isNull() | F.col("sar_id").isNull()
    error = "Optical-SAR fusion unavailable: no co-registered pair for this location/date."
    return picked.withColumn("error", F.when(missing, error))


def attach_confidence(
    results: DataFrame,
    as_of: Column,
    used_fallback: Column | None = None,
    registered: Column | None = None,
    trace_fallback: Column | None = None,
    cross_check: Column | None = None,
) -> DataFrame:
    """Confidence band, reason and observation age of every result row.

    ``cross_check`` is a struct like that of ``scores.cross_check``. A null ``registered`` is a failed registration.
    """
    no = F.lit(False)
    verdict = scores.confidence(
        used_fallback if used_fallback is not None else no,
        trace_fallback if trace_fallback is not None else no,
        F.coalesce("paired_scene_id", F.lit("")) == "",
        F.col("cloud_cover"),
        F.coalesce(registered, no) if registered is not None else F.lit(True),
        None if cross_check is None else cross_check["disagreement"],
        None if cross_check is None else cross_check["severity"],
    )
    return (
        results.withColumn("__c", verdict)
        .withColumns(
            {
                "confidence_band": F.col("__c.band"),
                "confidence_reason": F.col("__c.reason"),
                "observation_age_days": scores.observation_age(F.col("acquisition_time"), as_of),
            }
        )
        .drop("__c")
    )


def explained_results(results: DataFrame, scenes: DataFrame, summary: Column | None = None) -> DataFrame:
    """Result rows (with ``confidence_reason``) and what a reader is told of each: ``explanation`` and ``note``.

    ``results`` has ``query_id, rank, score, scene_id, sensor, acquisition_time``; the outline comes from ``scenes``. The note
    joins the explanation and the confidence; ``summary`` may tell what a model found.
    """
    outlines = scenes.select("scene_id", "geometry_wkt")
    joined = results.join(outlines, "scene_id", "left")
    day = F.coalesce(F.date_format("acquisition_time", "yyyy-MM-dd"), F.lit("an unknown date"))
    told = scores.result_explanation(
        F.col("rank"), F.col("score"), F.coalesce("sensor", F.lit("an unknown sensor")), day,
        F.coalesce("geometry_wkt", F.lit("an unknown place")), F.lit(None).cast("string") if summary is None else summary,
    )
    note = F.concat_ws(" ", told, F.concat(F.lit("Confidence: "), F.col("confidence_reason"), F.lit(".")))
    return joined.withColumns({"explanation": told, "note": note}).drop("geometry_wkt")
