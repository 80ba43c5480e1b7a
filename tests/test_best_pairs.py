"""The best scenes of every query against the join of all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrafold.functions import vectors
from terrafold.operators import best_pairs, joins, retrieval as rt


def tables(spark):
    rng = random.Random(4)
    maybe = lambda x, share=0.15: None if rng.random() < share else x
    scenes, queries = [], []
    for i in range(300):
        x, y = rng.randrange(40) / 4, rng.randrange(40) / 4
        box = (x, y, x + 0.5, y + 0.5) if rng.random() < 0.9 else (None, y, x, y)
        when = maybe(datetime(2020, 1, 1) + timedelta(days=rng.randrange(2000)))
        scenes.append((f"s{i % 280:03d}", maybe(rng.choice(["A", "B", "both"])), "optical", when, maybe(rng.choice(["lake", "salt lake", "Wood", ""])), maybe(float(rng.randrange(60))), *box))
    for i in range(60):
        x, y = rng.randrange(32) / 4, rng.randrange(32) / 4
        box = (x, y, x + 2.5, y + 2.5) if rng.random() < 0.7 else (None,) * 4
        start = maybe(datetime(2020, 1, 1) + timedelta(days=rng.randrange(1500)), 0.4)
        end = maybe(datetime(2022, 1, 1) + timedelta(days=rng.randrange(1500)), 0.4)
        queries.append((i, maybe(f"find {i}", 0.5), *box, start, end, maybe(rng.choice([["A"], ["A", "B"], []]), 0.3), maybe(rng.choice(["lake", "WOOD", ""]), 0.5), 20.0, maybe(i % 2 == 0)))
    sides = "min_lon double, min_lat double, max_lon double, max_lat double"
    s = spark.createDataFrame(scenes, f"scene_id string, sensor string, modality string, acquisition_time timestamp, object string, cloud_cover double, {sides}")
    asked = ", ".join(f"q_{c}" for c in sides.split(", "))
    q = spark.createDataFrame(queries, f"query_id int, text_query string, {asked}, start_date timestamp, end_date timestamp, sensors array<string>, query_object string, cloud_cover_max double, change_flag boolean")
    return s.withColumn("paired_scene_id", F.lit(None).cast("string")), q


@pytest.mark.parametrize("relax", [0, 3])
@pytest.mark.parametrize("fuse", [True, False])
def test_equal_to_the_join_of_all_pairs(spark, monkeypatch, fuse, relax):
    scenes, queries = tables(spark)
    got = rt.retrieve_batch(scenes, queries, 4, fuse=fuse, relax_when_empty=relax).collect()

    def every(left, right, n, silent, neutral, weights, fuse, end_inclusive_day):
        return joins.query_scene_join(left, right, end_inclusive_day=end_inclusive_day)

    monkeypatch.setattr(rt, "query_scene_best", every)
    want = rt.retrieve_batch(scenes, queries, 4, fuse=fuse, relax_when_empty=relax).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 100


def test_no_query_keeps_more_pairs_than_it_needs(spark, monkeypatch):
    """Chunks and hot places of a few rows; before, all pairs were rows."""
    monkeypatch.setattr(best_pairs, "CHUNK_QUERIES", 3)
    monkeypatch.setattr(best_pairs, "CHUNK_SCENES", 7)
    scenes, queries = tables(spark)
    left = scenes.withColumn("__sv", vectors.hash_embedding(F.col("scene_id")))
    right = queries.withColumn("__qv", vectors.hash_embedding(F.coalesce("text_query", F.lit(""))))
    product = vectors.dot(F.col("__qv"), F.col("__sv"), vectors.HASH_DIM)
    pairs = best_pairs.query_scene_best(left, right, 5, F.lit(False), 0.0, rows_per_task=20).withColumn("score", product)
    every = joins.query_scene_join(left, right).withColumn("score", product)
    rows = [sorted((r.query_id, r.scene_id, r.score) for r in x.select("query_id", "scene_id", "score").collect()) for x in (pairs, rt.topk_per_query(every, 5))]
    assert rows[0] == rows[1] and every.count() > 3 * len(rows[0])


def test_semantic_rank_join_is_the_rank_of_all_pairs(spark, monkeypatch):
    """Blank texts on either side, ties and null ids; before, every pair that passes the filters was a row."""
    scenes, queries = tables(spark)
    scenes = scenes.withColumn("st", F.when(F.col("sensor").isNotNull(), F.concat_ws(" ", "sensor", "object")))
    queries = queries.withColumn("qt", F.when(F.col("query_id") % 7 == 3, " ").otherwise(F.col("text_query")))
    pairs = joins.query_scene_join(scenes, queries)
    want = sorted(map(str, rt.semantic_rank(pairs, 4, "qt", "st").select("query_id", "scene_id", "score", "rank").collect()))
    taken, best = [], rt.query_scene_best
    monkeypatch.setattr(rt, "query_scene_best", lambda *a, **b: taken.append(best(*a, **b)) or taken[0])
    got = rt.semantic_rank_join(scenes, queries, 4, F.col("qt"), F.col("st")).collect()
    assert sorted(map(str, got)) == want and len(want) > 100
    assert any(r.score == 0.5 for r in got) and taken[0].count() == len(want) < pairs.count() / 3
