"""Cells that follow the data, and the scene join over them."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import joins
from terrafold.operators.space import Cells
from terrafold.plans.bindings import Data


def boxes_of(rng, n, spread, size):
    at = rng.normal(scale=spread, size=(n, 2))
    return np.column_stack([at, at + rng.uniform(0, size, (n, 2))])


def test_cells_cover_the_plane_once():
    rng = np.random.default_rng(2)
    crowd = np.concatenate([boxes_of(rng, 900, 0.05, 0.002), boxes_of(rng, 100, 40, 0.5)])
    cells = Cells(crowd, boxes_of(rng, 500, 0.05, 0.01), (1000.0, 10.0))
    leaves = cells.box[cells.first < 0]
    assert len(leaves) > 60
    points = np.concatenate([rng.normal(scale=s, size=(300, 2)) for s in (0.05, 5, 1e6)] + [leaves[np.isfinite(leaves).all(axis=1)][:, :2]])
    inside = (points[:, None, 0] >= leaves[:, 0]) & (points[:, None, 0] < leaves[:, 2]) & (points[:, None, 1] >= leaves[:, 1]) & (points[:, None, 1] < leaves[:, 3])
    assert (inside.sum(axis=1) == 1).all()
    area = np.prod(leaves[:, 2:] - leaves[:, :2], axis=1)
    assert area.min() < 1e-3 < 1e3 < area.max()  # small in the crowd, large outside
    some = np.concatenate([boxes_of(rng, 200, 0.1, 0.01), [[5, 5, 4, 4], [-1e10, -1e10, 1e10, 1e10], [0, 0, 0, 0], [np.nan] * 4]])
    rows, at, wide = cells.cover(some, np.ones(len(some), dtype=bool), 9)
    for i, b in enumerate(some):
        touched = np.flatnonzero((cells.first < 0) & (b[2] >= cells.box[:, 0]) & (b[0] <= cells.box[:, 2]) & (b[3] >= cells.box[:, 1]) & (b[1] <= cells.box[:, 3]))
        odd = not (b[0] <= b[2] and b[1] <= b[3]) or len(touched) > 9
        assert wide[i] == odd and sorted(at[rows == i]) == ([] if odd else sorted(touched))


def test_cells_of_nothing_and_of_one_place():
    none = np.empty((0, 4))
    assert len(Cells(none, none).box) == 1
    same = np.tile([1.0, 1.0, 1.0, 1.0], (50, 1))
    rows, cells, wide = Cells(same, same).cover(same, np.ones(50, dtype=bool), 4)
    assert len(rows) == 50 and not wide.any()


@pytest.mark.parametrize("rows_per_task, max_cells", [(2_000_000, 64), (20, 4), (7, 1)])
def test_hot_cell_on_both_sides(spark, rows_per_task, max_cells):
    """A third of both sides in one spot, the rest spread; nested loops must agree, each pair once."""
    rng = random.Random(8)
    scenes, queries = [], []
    for i in range(240):
        x, y = (77.2 + rng.random() / 50, 28.6 + rng.random() / 50) if i % 3 == 0 else (rng.uniform(-179, 179), rng.uniform(-89, 89))
        size = 0.001 if i % 3 == 0 else rng.choice([0.1, 5, 90])
        obj = rng.choice([None, "", "farm", "farm land", "Water"])
        scenes.append((f"s{i}", rng.choice([None, "Sentinel-1", "Sentinel-2"]), obj, datetime(2020 + i % 3, 1 + i % 12, 3) if i % 7 else None, x, y, x + size, y + size))
    for i in range(90):
        x, y = (77.2 + rng.random() / 50, 28.6 + rng.random() / 50) if i % 3 == 0 else (rng.uniform(-179, 170), rng.uniform(-89, 80))
        size = 0.002 if i % 3 == 0 else rng.choice([1, 30, 300])
        box = (None,) * 4 if i % 11 == 0 else (x, y, x + size, y + size)
        queries.append((i, *box, datetime(2020, 6, 1) if i % 2 else None, datetime(2022, 2, 1) if i % 3 else None, rng.choice([None, ["Sentinel-1"]]), rng.choice([None, "", "farm", "WATER"])))
    s = spark.createDataFrame(scenes, "scene_id string, sensor string, object string, acquisition_time timestamp, min_lon double, min_lat double, max_lon double, max_lat double")
    q = spark.createDataFrame(queries, "query_id int, q_min_lon double, q_min_lat double, q_max_lon double, q_max_lat double, start_date timestamp, end_date timestamp, sensors array<string>, query_object string")
    want = set()
    for sid, sensor, obj, when, a, b, c, e in scenes:
        for qid, qa, qb, qc, qe, start, end, asked, wanted in queries:
            boxed = qa is None or (c >= qa and a <= qc and e >= qb and b <= qe)
            dated = when is None or ((start is None or when >= start) and (end is None or when <= end))
            like = wanted is None or (obj is not None and (wanted.lower() in obj.lower() or obj.lower() in wanted.lower()))
            if boxed and dated and like and (asked is None or sensor is None or sensor in asked):
                want.add((qid, sid))
    got = joins.query_scene_join(s, q, rows_per_task=rows_per_task, max_cells=max_cells).select("query_id", "scene_id").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 600


def test_candidates_stay_near_the_results(spark):
    shares = []
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        data = Data(spark, folder)
        shares.append(joins.scene_candidates(data.unpaired, data.queries).count() / joins.query_scene_join(data.unpaired, data.queries).count())
    assert shares[1] < 1.2 * shares[0] and shares[1] < 20


def test_gridded_join_cuts_both_sides(spark):
    left = spark.range(600).select(F.col("id").alias("a"), (F.col("id") % 3 > 0).cast("int").alias("k"))
    right = spark.range(300).select(F.col("id").alias("b"), (F.col("id") % 3 > 0).cast("int").alias("k"))
    got = joins.gridded_join(left, right, ["k"], ("a", "b"), 50)
    assert got.count() == 400 * 200 + 200 * 100 == got.select("a", "b").distinct().count()


def test_within_km_over_poles_and_the_180th_meridian(spark):
    rng = np.random.default_rng(4)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 150), np.degrees(np.arcsin(rng.uniform(-1, 1, 150))))]
    points += [(179.99, 10.0), (-179.99, 10.0), (0.0, 90.0), (120.0, 89.9), (-60.0, 89.9), (10.0, -90.0), (190.0, 10.0), (5.0, 5.0), (5.0, 5.0), (-175.0, -5.0)]
    rows = [(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    a = spark.createDataFrame(rows, "a int, alon double, alat double")
    b = spark.createDataFrame(rows, "b int, blon double, blat double")

    def apart(p, q):
        x, y = (np.array([np.cos(np.radians(t[1])) * np.cos(np.radians(t[0])), np.cos(np.radians(t[1])) * np.sin(np.radians(t[0])), np.sin(np.radians(t[1]))]) for t in (p, q))
        return 6371.0 * np.arctan2(np.linalg.norm(np.cross(x, y)), x @ y)

    for km, bound in ((30.0, 2_000_000), (2000.0, 40), (25_000.0, 2_000_000)):
        want = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if apart(p, q) <= km}
        got = joins.within_km(a, b, km, ("alon", "alat"), ("blon", "blat"), ("a", "b"), bound).select("a", "b").collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def test_points_near_each_other_are_not_broadcast(spark):
    """Spark takes the 27 rows of a point for one; before, small estimates sent all of them through the driver."""
    one = spark.range(300).selectExpr("id AS a", "id % 20 / 10 AS lon", "id % 7 / 10 AS lat")
    other = spark.range(200).selectExpr("id AS b", "id % 15 / 10 AS x", "id % 9 / 10 AS y")
    near = joins.within_km(one, other, 30.0, ("lon", "lat"), ("x", "y"), ("a", "b"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    km = joins.geo.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    want = one.crossJoin(other).filter(km <= 30).select("a", "b").collect()
    assert sorted(map(tuple, near.select("a", "b").collect())) == sorted(map(tuple, want)) and len(want) > 1000
