"""Properties that must hold at any size: partitioning, skew, brute-force equality, plans."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.functions.geo import Box, boxes_touch
from terrafold.operators import catalog, joins, querylog as ql, retrieval as rt, textsim as ts
from terrafold.operators.ordered import with_hash_rank, with_running_sum
from terrafold.operators.selection import exact_percentiles
from terrafold.plans.bindings import Data

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark, FOLDER)


def pairs_of(df):
    return sorted((r.query_id, r.scene_id) for r in df.select("query_id", "scene_id").collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_scene_join_is_the_nested_loop(spark, data, parts):
    scenes, queries = data.unpaired.repartition(parts), data.queries
    sb, qb = Box.named(), Box.named("q_")
    match = (
        (qb.min_lon.isNull() | boxes_touch(sb, qb))
        & catalog.matches_dates(F.col("acquisition_time"), F.col("start_date"), F.col("end_date"))
        & catalog.matches_sensor(F.col("sensor"), F.col("sensors"))
        & catalog.matches_object(F.col("object"), F.col("query_object"))
    )
    want = pairs_of(scenes.crossJoin(queries).filter(match))
    assert pairs_of(joins.query_scene_join(scenes, queries)) == want
    # wide boxes sent the other way, and every key treated as hot
    assert pairs_of(joins.query_scene_join(scenes, queries, max_cells=1)) == want
    assert pairs_of(joins.query_scene_join(scenes, queries, rows_per_task=3)) == want


def test_scene_join_plan_has_no_nested_loop(spark, data):
    plan = joins.query_scene_join(data.unpaired, data.queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_topk_is_cut_before_the_shuffle(spark, data):
    scored = data.unpaired.select(F.col("aoi").alias("query_id"), "scene_id", F.col("min_lon").alias("score"))
    plan = rt.topk_per_query(scored.repartition(4), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_edges_and_nulls_of_the_grid(spark):
    names = ["min_lon", "min_lat", "max_lon", "max_lat"]
    scene_rows = [("edge", 1.0, 1.0, 2.0, 2.0), ("wide", -3.5, -3.5, 3.5, 3.5), ("negative", -1.0, -1.0, -0.5, -0.5), ("none", None, None, None, None)]
    schema = "scene_id string, " + ", ".join(f"{n} double" for n in names)
    scenes = spark.createDataFrame(scene_rows, schema).withColumns(
        {"sensor": F.lit("both"), "object": F.lit("x"), "acquisition_time": F.lit(None).cast("timestamp")}
    )
    queries = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 1.0), (2, 2.0, 2.0, 2.0, 2.0), (3, None, None, None, None)],
        "query_id int, " + ", ".join(f"q_{n} double" for n in names),
    ).withColumns(
        {
            "start_date": F.lit("2024-01-01").cast("timestamp"), "end_date": F.lit(None).cast("timestamp"),
            "sensors": F.lit(None).cast("array<string>"), "query_object": F.lit(None).cast("string"),
        }
    )
    got = pairs_of(joins.query_scene_join(scenes, queries))
    assert got == [(1, "edge"), (1, "wide"), (2, "edge"), (2, "wide"), (3, "edge"), (3, "negative"), (3, "none"), (3, "wide")]


def test_chunked_windows_equal_plain_windows(spark, data):
    log = data.view("log")
    base = sorted((r.query_id, r.session_no) for r in ql.session_ttl(log).collect())
    for rows in (2, 7):
        hot = log.repartition(5)
        assert sorted((r.query_id, r.session_no) for r in ql.session_ttl(hot, rows_per_chunk=rows).collect()) == base


def test_hash_rank_is_dense(spark):
    rows = spark.range(5000).withColumn("g", F.lit(None).cast("string"))  # one hot (null) key
    got = sorted(r.r for r in with_hash_rank(rows, ["g"], "id", "s", "r").collect())
    assert got == list(range(1, 5001))
    total = with_running_sum(rows, [], F.floor(F.col("id") / 100), ["id"], F.lit(2), "t")
    assert total.filter(F.col("t") != (F.col("id") + 1) * 2).count() == 0


@pytest.mark.parametrize("n", [1, 7, 30000])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(size=n), 3)
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None), ("other", 1.0)], "k string, v double")
    probs = [0.0, 0.005, 0.5, 0.95, 0.995, 1.0]
    got = {(r.k, r.prob): r.percentile for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for p in probs:
        assert got["k", p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
        assert got["other", p] == 1.0


def test_query_scene_join_odd_boxes_and_filters(spark):
    """Broken and wide scene boxes, null and empty objects and sensors, queries with and without a box."""
    rnd = random.Random(12)
    objects, sensors = [None, "", "a", "farm", "farm land", "Water"], [None, "Sentinel-1", "Sentinel-2"]
    boxes = [(-1e10, -1e10, 1e10, 1e10), (-180.0, -90.0, 180.0, 90.0), (None, None, None, None), (1e300, 0.0, 1e300, 0.0), (5.0, 5.0, 4.0, 4.0)]
    scenes, queries = [], []
    for i in range(120):
        x, y = rnd.uniform(-5, 5), rnd.uniform(-5, 5)
        box = boxes[i % 5] if i % 4 == 0 else (x, y, x + rnd.random(), y + rnd.random())
        when = None if i % 9 == 0 else datetime(2020 + i % 3, 1 + i % 12, 3)
        scenes.append((f"s{i:03d}", sensors[i % 3], objects[rnd.randrange(6)], when, *box))
    for i in range(60):
        x, y = rnd.uniform(-5, 5), rnd.uniform(-5, 5)
        box = (None,) * 4 if i % 3 == 0 else (x, y, x + 2, y + 2) if i % 3 == 1 else (-60.0, -60.0, 60.0, 60.0)
        asked = [None, [], ["Sentinel-1"], ["Sentinel-1", "Sentinel-1", None], ["Sentinel-2", "Sentinel-1"]][i % 5]
        start = None if i % 2 else datetime(2020, 6, 1)
        queries.append((i, *box, start, None if i % 4 else datetime(2021, 12, 1), asked, objects[i % 6]))
    s = spark.createDataFrame(scenes, "scene_id string, sensor string, object string, acquisition_time timestamp, min_lon double, min_lat double, max_lon double, max_lat double")
    q = spark.createDataFrame(queries, "query_id int, q_min_lon double, q_min_lat double, q_max_lon double, q_max_lat double, start_date timestamp, end_date timestamp, sensors array<string>, query_object string")
    want = set()
    for sid, sensor, obj, when, a, b, c, e in scenes:
        for qid, qa, qb, qc, qe, start, end, asked, wanted in queries:
            boxed = qa is None or (a is not None and c >= qa and a <= qc and e >= qb and b <= qe)
            dated = when is None or ((start is None or when >= start) and (end is None or when <= end))
            seen = asked is None or sensor is None or sensor in asked
            like = wanted is None or (obj is not None and (wanted.lower() in obj.lower() or obj.lower() in wanted.lower()))
            if boxed and dated and seen and like:
                want.add((qid, sid))
    got = [(r.query_id, r.scene_id) for r in joins.query_scene_join(s, q, rows_per_task=40).select("query_id", "scene_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def brute_near(rows, t):
    norm = [(i, g, set("".join(c for c in x.lower() if c.isalnum() or c == " ").split())) for i, g, x in rows]
    out = set()
    for i, g, a in norm:
        for j, h, b in norm:
            if j < i and g == h and a and b and len(a & b) / len(a | b) >= t - 1e-12:
                out.add(i)
                break
    return out


@pytest.mark.parametrize("threshold, words", [(0.9, 20), (0.7, 6), (0.5, 3)])
def test_near_duplicates_against_brute_force(spark, threshold, words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(40)]
    base = rnd.sample(vocabulary, words)
    rows = []
    for i in range(150):
        if i % 3 == 0:  # a crowd: copies, and copies with one word changed
            text = list(base)
            if i % 2:
                text[rnd.randrange(words)] = rnd.choice(vocabulary)
        else:
            text = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, words))]
        rows.append((i, f"g{i % 2}" if i % 5 else "g0", " ".join(text)))
    rows.append((150, "g0", ""))
    df = spark.createDataFrame(rows, "id int, g string, t string").repartition(3)
    for rows_per_task in (1_000_000, 5):
        got = {r.id for r in ts.near_duplicates(df, "id", "t", ["g"], threshold, rows_per_task).collect()}
        assert got == brute_near(rows, threshold)


def test_benchmark_overlap_short_and_long_items(spark):
    docs = spark.createDataFrame(
        [(1, "xxAlpha, beta gammayy"), (2, "say: NDVI!"), (3, "alpha gamma delta"), (4, "one two three four"), (5, None)], "id int, t string"
    )
    bench = spark.createDataFrame([(10, "alpha beta gamma"), (11, "ndvi"), (12, "one two three five"), (13, "")], "item int, b string")
    got = {(r.id, r.item) for r in ts.containing_benchmark(docs, "id", "t", bench, "item", "b").collect()}
    assert got == {(1, 10), (2, 11)}
    near = {(r.id, r.item) for r in ts.similar_to_benchmark(docs, "id", "t", bench, "item", "b", 0.6).collect()}
    assert near == {(4, 12)}
    marked = {r.id: r.reject_reason for r in ts.decontaminate(docs, "id", "t", bench, "item", "b").collect()}
    assert marked == {1: "contains", 2: "contains", 3: None, 4: "jaccard", 5: None}


def test_containment_paths_agree(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "al", "a", "ta", "é"])
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [(500, None), (501, "")]
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 4)))) for i in range(25)] + [(90, ""), (91, None), (92, "Alpha!")]
    d, b = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(items, "item int, b string")
    norm = lambda t: " ".join("".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split())
    want = {(i, k) for i, t in docs for k, x in items if norm(x) and norm(x) in norm(t)}
    for limit, passes in ((4_000_000, 4), (100, 100), (100, 1)):
        monkeypatch.setattr(ts, "AUTOMATON", limit)
        monkeypatch.setattr(ts, "PASSES", passes)
        got = [tuple(r) for r in ts.containing_benchmark(d, "id", "t", b, "item", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert ts.containing_benchmark(d, "id", "t", b.filter("b = ''"), "item", "b").count() == 0
    monkeypatch.undo()
    plan = ts.containing_benchmark(d, "id", "t", b, "item", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(xxhash" not in plan and plan.count("Generate") == 1


def test_only_key_words_are_shuffled(spark):
    """Rows of the key join at two sizes: a tenth of the words, and none of words that no other set has."""
    shares = []
    for n in (60, 240):
        rnd = random.Random(n)
        sets = [(i, [f"w{rnd.randrange(40)}" for _ in range(3)] + [f"u{i}x{k}" for k in range(47)]) for i in range(n)]
        df = spark.createDataFrame(sets, "id int, toks array<string>").selectExpr("id", "array_distinct(toks) AS toks")
        own = df.selectExpr("explode(toks) AS w").filter("w LIKE 'u%'").select(F.xxhash64("w").alias("__w"))
        tiers = ts.word_tiers(df, 2)
        assert ts._key_words(df, ["id"], tiers, 0.9).join(own, "__w").count() <= n // 20  # words that share a slot
        shares.append(ts._key_words(df, ["id"], tiers, 0.9).count() / df.selectExpr("explode(toks)").count())
        other = ts.word_tiers(df.filter("id < 3"))
        assert ts._key_words(df, ["id"], other, 0.05).join(own, "__w").select("id").distinct().count() <= 3 + n // 20
    assert max(shares) < 0.1


def test_first_words_by_tier(spark):
    sets = [(i, ["all"] + (["half"] if i % 2 else []) + [f"one{i}"]) for i in range(64)]
    df = spark.createDataFrame(sets, "id int, toks array<string>")
    table = ts.word_tiers(df, 2).value
    h = {r.w: r.h for r in spark.createDataFrame([("all",), ("half",), ("one3",), ("one5",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    lists = pa.array([[h["all"], h["one3"], h["half"]], [], [h["all"], h["half"]], [h["one5"]]], pa.list_(pa.int64()))
    got = ts.first_words(lists.slice(0), np.array([2, 3, 1, 1]), table).to_pylist()
    assert got == [[h["half"]], [], [h["half"]], []]
    assert ts.first_words(lists.slice(2), np.array([2, 1]), table).to_pylist() == [[h["half"], h["all"]], []]


def test_knn_paths_agree_and_ties_go_by_id(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).tolist()
    vectors[30:50] = [vectors[0]] * 20  # a third of the corpus is one vector
    items = spark.createDataFrame(list(enumerate(vectors)), "item_id int, vector array<double>")
    queries = items.limit(10).withColumnRenamed("item_id", "query_id")
    a = rt.knn_cosine(queries, items.repartition(7), 5)
    b = rt.knn_cosine(queries, items.repartition(3), 5, max_block=4, rows_per_group=9)
    rows = [sorted((r.query_id, r.rank, r.item_id) for r in x.collect()) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 50
    assert [i for q, _, i in rows[0] if q == 0] == [0, 30, 31, 32, 33]


@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_knn_by_pivots_is_exact(spark, spread):
    """Clustered vectors of two dimensions, a third of them equal; groups far from a query are not visited."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    corpus = [(i, (centres[i % 12] + spread * rng.normal(size=16)).tolist()) for i in range(400)]
    corpus += [(1000 + i, corpus[5][1]) for i in range(200)] + [(2000 + i, rng.normal(size=3).tolist()) for i in range(20)]
    corpus += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16)]
    queries = [(i, (centres[i % 12] + spread * rng.normal(size=16)).tolist()) for i in range(40)] + [(50, [1.0, 0.0, 0.0]), (51, [1.0] * 5), (52, None)]
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    c = spark.createDataFrame(corpus, "item_id int, vector array<double>").repartition(5)
    want = set()
    for i, v in queries:
        if v is None:
            continue
        scored = []
        for j, x in corpus:
            if x is not None and len(x) == len(v) and np.isfinite(x).all() and np.any(x):
                scored.append((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), j))
        want |= {(i, j, r) for r, (_, j) in enumerate(sorted(scored)[:7], 1)}
    got = rt.knn_cosine(q, c, 7, max_block=8, rows_per_group=50).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in got} == want and len(got) == len(want)
    share = rt.visited_share(*rt.knn_plan(q, c, 7, rows_per_group=50))
    assert share < 0.5 if spread < 1 else share <= 1


def test_knn_queries_travel_once_per_tile(spark, monkeypatch):
    """Small groups share tiles, large ones are cut, and neither parameter multiplies what is shuffled."""
    assert rt._tiles({(4, 0): 300, (4, 1): 300, (4, 2): 900, (5, 0): 10}) == {(4, 0): (0, 1), (4, 1): (0, 1), (4, 2): (1, 1), (5, 0): (2, 1)}
    monkeypatch.setattr(rt, "TILE_BYTES", 3200)
    assert rt._tiles({(4, 0): 250, (4, 1): 60, (4, 2): 60}) == {(4, 0): (0, 3), (4, 1): (3, 1), (4, 2): (4, 1)}
    rng = np.random.default_rng(9)
    vectors = np.round(rng.normal(size=(300, 4)), 1)
    vectors[:130] = vectors[0]  # a group of more than a tile
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id int, vector array<double>")
    queries = items.withColumnRenamed("item_id", "query_id")
    items_, visits, tiles = rt.knn_plan(queries, items, 3, max_block=4, rows_per_group=9)
    assert visits.count() == 300 and items_.select("tile").distinct().count() <= 20
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    want = {(q, i, r) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(300), -scores[q]))[:3].tolist(), 1)}
    got = rt.knn_cosine(queries, items, 3, max_block=4, rows_per_group=9).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in got} == want


def test_hot_day_in_interval_join(spark):
    from datetime import datetime

    rows = [(f"r{i:04d}", "sar", datetime(2024, 2, 29), "hot") for i in range(300)]
    rows += [("o1", "optical", datetime(2024, 3, 2), "hot"), ("o2", "optical", datetime(2024, 2, 27), "hot"), ("o3", "optical", datetime(2024, 2, 29), "cold")]
    s = spark.createDataFrame(rows, "scene_id string, modality string, acquisition_time timestamp, aoi string").withColumn("object", F.lit("x"))
    got = joins.optical_sar_interval_join(s, "aoi").collect()
    assert len(got) == 300 and {r.optical_id for r in got} == {"o2"}  # earliest, across the month's end
