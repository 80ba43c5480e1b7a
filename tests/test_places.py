"""Places of queries: each query meets all its scenes in one task, and only what is needed travels."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.functions import vectors
from terrafold.functions.geo import Box
from terrafold.operators import best_pairs, catalog, evalkit as ev, joins, retrieval as rt
from terrafold.operators.ranked_pairs import query_scene_ranks
from terrafold.operators.space import Tiles

SIDES = "min_lon double, min_lat double, max_lon double, max_lat double"


def tables(spark, scenes=900, queries=80, seed=3):
    rng = random.Random(seed)
    maybe = lambda x, share=0.1: None if rng.random() < share else x
    left, right = [], []
    for i in range(scenes):
        x, y = rng.randrange(400) / 20, rng.randrange(400) / 20
        box = (x, y, x + 0.25, y + 0.25) if rng.random() < 0.95 else (5.0, None, 6.0, 6.0)
        left.append((maybe(f"s{i % (scenes - 20):05d}", 0.01), maybe(rng.choice(["A", "B", "both"])), "optical", maybe(datetime(2020, 1, 1) + timedelta(days=rng.randrange(900))), maybe(rng.choice(["lake", "Wood"])), 10.0, *box))
    for i in range(queries):
        x, y = rng.randrange(360) / 20, rng.randrange(360) / 20
        side = 30.0 if i % 20 == 7 else rng.choice([1.5, 4.0])
        box = (x, y, x + side, y + side) if i % 9 else (None,) * 4
        right.append((i, maybe(f"find {i}"), *box, maybe(datetime(2020, 3, 1), 0.5), maybe(datetime(2022, 1, 1), 0.5), maybe(rng.choice([["A"], ["A", "B"]]), 0.4), maybe(rng.choice(["lake", "wood", ""]), 0.5), 20.0, i % 2 == 0))
    s = spark.createDataFrame(left, f"scene_id string, sensor string, modality string, acquisition_time timestamp, object string, cloud_cover double, {SIDES}")
    asked = ", ".join(f"q_{c}" for c in SIDES.split(", "))
    q = spark.createDataFrame(right, f"query_id int, text_query string, {asked}, start_date timestamp, end_date timestamp, sensors array<string>, query_object string, cloud_cover_max double, change_flag boolean")
    return s.withColumn("paired_scene_id", F.lit(None).cast("string")), q


@pytest.mark.parametrize("fuse", [True, False])
def test_few_rows_leave_the_tasks(spark, monkeypatch, fuse):
    """Before, every cell that a query touches gave its best, and 128 bytes of a vector were in each row of either side."""
    scenes, queries = tables(spark)
    found, cut = [], best_pairs.first_rows
    monkeypatch.setattr(best_pairs, "first_rows", lambda df, *a: found.append(df) or cut(df, *a))
    got = rt.retrieve_batch(scenes, queries, 5, fuse=fuse).collect()
    settled = queries.filter((F.col("query_id") % 9 != 0) & (F.col("query_id") % 20 != 7))
    rows = found[0].join(settled.select("query_id"), "query_id", "left_semi")
    assert rows.groupBy("query_id").count().agg(F.max("count")).first()[0] <= (10 if fuse else 5)
    assert found[0].schema["__sv"].dataType.simpleString() == "binary"
    monkeypatch.setattr(rt, "query_scene_best", lambda a, b, n, silent, neutral, weights, fuse, day: joins.query_scene_join(a, b, end_inclusive_day=day))
    want = rt.retrieve_batch(scenes, queries, 5, fuse=fuse).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 200


def test_digests_are_the_vectors_of_the_texts(spark):
    texts = [f"text {i} é" for i in range(200)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hash_embedding(F.col("t")).alias("v"), F.unhex(F.md5("t")).alias("d")).toPandas()
    made, there = best_pairs._vectors(pa.chunked_array([pa.array(list(rows.d), pa.binary())]))
    assert there.tolist() == [t is not None for t in texts]
    assert np.array_equal(made[there], np.stack(list(rows.v[:-1])))


def test_tiles_hold_every_touching_pair():
    rng = np.random.default_rng(5)
    left = rng.random((3000, 2)) * 50
    left = np.hstack([left, left + 0.2])
    corner, size = rng.random((500, 2)) * 50, np.where(rng.random((500, 1)) < 0.02, 30.0, 2.0)
    right = np.hstack([corner, corner + size])
    tiles = Tiles(left, right, (1000.0, 1000.0), 200_000)
    centres = (right[:, :2] + right[:, 2:]) / 2
    home = np.array([tiles._inside(centres, r) for r in tiles.regions])
    assert len(tiles.regions) > 4 and (home.sum(axis=0) == 1).all()
    fits = np.array([(right[:, :2] >= w[:2]).all(axis=1) & (right[:, 2:] <= w[2:]).all(axis=1) for w in tiles.reach])
    settled = (home & fits).any(axis=0)
    assert 0.95 < settled.mean() < 1.0  # the huge ones are not worth a tile
    for b, t in zip(right[settled][:100], home.argmax(axis=0)[settled][:100]):
        w, near = tiles.reach[t], (left[:, 2] >= b[0]) & (left[:, 0] <= b[2]) & (left[:, 3] >= b[1]) & (left[:, 1] <= b[3])
        assert ((left[near, 2] >= w[0]) & (left[near, 0] <= w[2]) & (left[near, 3] >= w[1]) & (left[near, 1] <= w[3])).all()


def test_pairing_that_nobody_reads_costs_nothing(spark):
    """Before, the neighbours were found by a join, which stayed in the plan of those who read other columns."""
    scenes, _ = tables(spark, 50, 5)
    scenes = scenes.withColumn("place_id", F.lit("p"))
    paired = catalog.pair_consecutive(scenes.drop("paired_scene_id"), ["place_id", "sensor"])
    plan = paired.select("scene_id", *Box._fields)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    small = catalog.pair_consecutive(scenes.drop("paired_scene_id"), ["place_id", "sensor"], rows_per_chunk=4)
    assert sorted(map(str, paired.collect())) == sorted(map(str, small.select(*paired.columns).collect()))


def test_one_pass_finds_the_pairs(spark):
    rows = [(1, 1, "a", "c"), (1, 2, "b", None), (1, 3, "c", None), (1, 4, "c", None), (1, 5, "z", None), (2, 1, "d", "x"), (2, 2, "e", None), (3, 1, "f", None), (None, 1, "g", "h"), (None, 3, "h", None)]
    results = spark.createDataFrame(rows, "query_id int, rank int, scene_id string, paired_scene_id string")
    chosen = rt.select_change_pair(results)
    got = sorted((r.query_id or 0, r.t1, r.t2) for r in chosen.collect() if r.t2) + [r.t1 for r in chosen.collect() if r.error]
    assert got == [(1, "a", "c"), (1, "a", "c"), (2, "d", "e"), "f", "g"] or got == [(1, "a", "c"), (1, "a", "c"), (2, "d", "e"), "g", "f"]
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # before, the results were made twice and joined


def scored(spark, scenes):
    """Scores with ties, nulls and NaN."""
    n = F.pmod(F.xxhash64("scene_id", "min_lon"), F.lit(23))
    return scenes.withColumn("value", F.when(n == 1, None).when(n == 2, float("nan")).otherwise(F.floor(n / 5).cast("double")))


@pytest.mark.parametrize("rows", [60, 100_000])
def test_ranks_of_all_pairs(spark, rows):
    """Places in one piece, and cut along the order into many."""
    scenes, queries = tables(spark)
    scenes = scored(spark, scenes.filter(F.col("scene_id").isNotNull()).dropDuplicates(["scene_id"]))
    got = query_scene_ranks(scenes, queries, "value", ["scene_id"], ["query_id"], rows_per_task=rows)
    pairs = joins.query_scene_join(scenes, queries).select("query_id", "scene_id", F.col("value").alias("score"))
    want = sorted((r.query_id, r["rank"], r.scene_id) for r in rt.result_rank(pairs).collect())
    assert sorted((r.query_id, r["rank"], r.scene_id) for r in got.collect()) == want and len(want) > 2000


def test_ranked_pairs_are_not_shuffled(spark):
    """Odd ids on either side, hits of shared groups; before, all pairs were range-partitioned, kept, and joined with their groups."""
    scenes, queries = tables(spark)
    scenes = scored(spark, scenes)
    own = queries.filter(F.col("query_id") != 3)
    own = own.union(queries.filter(F.col("query_id").isin(5, 6))).withColumn("query_id", F.when(F.col("query_id") != 11, F.col("query_id")))
    items = scenes.filter("min_lon < 9").select("scene_id", F.col("sensor").alias("group"))
    groups = own.select("query_id", F.when(F.col("query_id") % 2 == 0, "A").otherwise("B").alias("group"))

    def marked(asked):
        left, right = ev.attach_groups(scenes, items, "scene_id", "item_groups"), ev.attach_groups(asked, groups, "query_id", "query_groups")
        results = rt.result_rank_join(left, right, F.col("value"), ("query_groups",), ("item_groups",))
        return ev.mark_group_hits(results, groups, items)

    pairs = joins.query_scene_join(scenes, own).select("query_id", "scene_id", F.col("value").alias("score"))
    want = ev.mark_group_hits(rt.result_rank(pairs), groups, items)
    rows = [sorted(map(str, x.select("query_id", "scene_id", "score", "hit").collect())) for x in (marked(own), want)]
    assert rows[0] == rows[1] and len(rows[0]) > 2000
    ranks = [sorted(map(str, x.select("query_id", "score", "rank").collect())) for x in (marked(own), want)]
    assert ranks[0] == ranks[1]
    plan = marked(queries)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above and "Window" not in above
