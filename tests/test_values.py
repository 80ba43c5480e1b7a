"""Known values on tiny tables."""

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from terrafold.functions import bands, geo, scores, text as tx, vectors
from terrafold.functions.geo import Box
from terrafold.operators import catalog, evalkit as ev, examples as ex, guardrail, pixels as px, querylog as ql, retrieval as rt


def one(spark, *columns, row=None, schema=None):
    base = spark.createDataFrame([row], schema) if row is not None else spark.range(1)
    return base.select(*columns).first()


# ---- query log


def label(spark, text, as_of="2024-06-15"):
    rows = spark.createDataFrame([(1, text)], "query_id int, query_text string")
    return ql.label_queries(rows, F.lit(as_of).cast("date")).first()


def test_search_query(spark):
    r = label(spark, "Show me Sentinel-2 images of agriculture near Delhi from June 2024")
    assert (r.task_type, r.sensor, r.object, r.location) == ("search", "Sentinel-2", "agriculture", "Delhi")
    assert (r.start_date, r.end_date) == (datetime(2024, 6, 1), datetime(2024, 6, 30))


def test_question_query(spark):
    r = label(spark, "What is the land cover in this image?")
    assert r.task_type == "vqa" and r.question == "What is the land cover in this image?"


def test_caption_and_referring(spark):
    r = label(spark, "Describe the land cover around Guwahati")
    assert (r.task_type, r.location) == ("caption", "Guwahati")
    r = label(spark, "Highlight the water body in the north east")
    assert (r.task_type, r.referring_expression) == ("caption", "the water body in the north east")


def test_change_query(spark):
    r = label(spark, "What changed between August 2023 and February 2024 in Assam?")
    assert r.task_type == "change" and r.change_flag and r.location == "Assam"
    assert (r.start_date, r.end_date) == (datetime(2023, 8, 1), datetime(2024, 2, 29))


def test_fusion_and_defaults(spark):
    r = label(spark, "Combine optical and SAR for the forest area")
    assert (r.task_type, r.sensor) == ("fusion", "both")
    r = label(spark, "Show me recent images")
    assert r.location is None and r.used_fallback and r.confidence == 0.5
    assert label(spark, "").task_type == "search"


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("Images from 2024-01-01 to 2024-01-31", date(2024, 1, 1), date(2024, 1, 31)),
        ("on 2024-02-03", date(2024, 2, 3), date(2024, 2, 3)),
        ("during 2022", date(2022, 1, 1), date(2022, 12, 31)),
        ("last year", date(2023, 1, 1), date(2023, 12, 31)),
        ("last month", date(2024, 5, 1), date(2024, 5, 31)),
        ("in feb 2024", date(2024, 2, 1), date(2024, 2, 29)),
        ("no date", None, None),
    ],
)
def test_dates(spark, text, start, end):
    r = label(spark, text)
    assert (r.start_date and r.start_date.date(), r.end_date and r.end_date.date()) == (start, end)


def test_upload_task(spark):
    rows = [("combine them", False, True), ("x", False, True), ("x", True, False), ("x", False, False)]
    df = spark.createDataFrame(rows, "t string, q boolean, f boolean")
    got = [r[0] for r in df.select(ql.label_upload_task(F.col("t"), F.col("q"), F.col("f"))).collect()]
    assert got == ["fusion", "change", "vqa", "caption"]


def test_aoi_ring_wins_over_place(spark):
    ring = [[[77.0, 28.5], [77.3, 28.5], [77.3, 28.8], [77.0, 28.8]]]
    rows = spark.createDataFrame(
        [(1, "lakes near Pune", ring), (2, "lakes near Atlantis", None)],
        "query_id int, query_text string, aoi array<array<array<double>>>",
    )
    got = {r.query_id: r for r in ql.query_to_search(ql.label_queries(rows, F.lit("2024-01-01").cast("date"))).collect()}
    assert (got[1].q_min_lon, got[1].q_max_lat) == (77.0, 28.8)
    assert got[2].q_min_lon is None and got[2].text_query == "Atlantis lakes near Atlantis"


# ---- geometry


def test_wkt_box(spark):
    texts = ["POLYGON((77.0 28.5, 77.3 28.5, 77.3 28.8, 77.0 28.8, 77.0 28.5))", "", "not a polygon", "POINT(1 1)", None, "POLYGON((a b))"]
    df = spark.createDataFrame([(t,) for t in texts], "w string")
    got = [r[0] for r in df.select(geo.wkt_box(F.col("w"))).collect()]
    assert tuple(got[0]) == (77.0, 28.5, 77.3, 28.8) and got[1:] == [None] * 5


def test_overlap_and_iou(spark):
    a, b, touching = (Box.literal(v) for v in ([0, 0, 2, 2], [1, 1, 3, 3], [2, 0, 3, 2]))
    r = one(spark, geo.overlap_ratio(a, b), geo.iou(a, b), geo.overlap_ratio(a, touching), geo.boxes_touch(a, touching))
    assert r[0] == 0.25 and r[1] == pytest.approx(1 / 7) and r[2] == 0.0 and r[3] is True


def test_haversine(spark):
    r = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert r[0] == pytest.approx(6371 * math.pi / 2)


# ---- filters: how nulls behave


def test_null_rules(spark):
    schema = (
        "scene_id string, sensor string, object string, acquisition_time timestamp, "
        "min_lon double, min_lat double, max_lon double, max_lat double"
    )
    rows = [("full", "Sentinel-2", "Wetland", datetime(2024, 1, 5), 0.0, 0.0, 1.0, 1.0), ("empty", None, None, None, None, None, None, None)]
    s = spark.createDataFrame(rows, schema)

    def got(df):
        return {r.scene_id for r in df.collect()}

    assert got(catalog.filter_bbox(s, (1.0, 1.0, 2.0, 2.0))) == {"full"}
    assert got(catalog.filter_date_range(s, "2025-01-01")) == {"empty"}
    assert got(catalog.filter_sensor_in(s, ["Sentinel-1"])) == {"empty"}
    assert got(catalog.filter_object_fuzzy(s, "the wetland area")) == {"full"}
    assert got(catalog.filter_bbox(s, None)) == {"full", "empty"}


def test_end_of_day(spark):
    s = spark.createDataFrame([("a", datetime(2024, 1, 31, 12))], "scene_id string, acquisition_time timestamp")
    assert catalog.filter_date_range(s, None, "2024-01-31").count() == 0
    assert catalog.filter_date_range(s, None, "2024-01-31", end_inclusive_day=True).count() == 1


def test_pairing_rule_and_gate(spark):
    rows = [(f"s{i}", "L", "Sentinel-2", datetime(2020 + i, 1, 1)) for i in range(3)]
    s = spark.createDataFrame(rows, "scene_id string, place string, sensor string, acquisition_time timestamp")
    linked = catalog.pair_consecutive(s, ["place", "sensor"])
    assert {r.scene_id: r.paired_scene_id for r in linked.collect()} == {"s0": "s1", "s1": "s2", "s2": "s1"}
    gate = catalog.pair_integrity(linked).first()
    assert (gate.total_pairs, gate.valid_pairs, gate.not_mutual, gate.passed) == (1, 1, 1, False)


# ---- pixels


def pixels(spark, rows):
    schema = "pair_id string, row int, col int, nir double, red double, green double, vv double"
    return spark.createDataFrame(rows, schema)


def test_index_values(spark):
    r = one(spark, bands.ndvi(F.lit(0.8), F.lit(0.2)), bands.ndvi(F.lit(0.0), F.lit(0.0)), bands.ndwi(F.lit(0.2), F.lit(0.8)))
    assert r[0] == pytest.approx(0.6) and r[1] == 0.0 and r[2] == pytest.approx(-0.6)
    r = one(spark, bands.sar_log_ratio(F.lit(1.0), F.lit(10.0)), bands.sar_log_ratio(F.lit(-5.0), F.lit(0.0)), bands.to_db(F.lit(0.0)))
    assert r[0] == pytest.approx(1.0, abs=1e-6) and r[1] == 0.0 and r[2] == pytest.approx(-70.0)


@pytest.mark.parametrize(
    "ndvi, ndwi, sar, want",
    [(0.6, None, None, 0.3), (0.4, 0.8, None, 0.3), (2.0, 2.0, None, 1.0), (10.0, 10.0, None, 1.0), (None, None, None, None), (0.0, None, None, 0.0), (0.4, None, 0.8, 0.3)],
)
def test_change_score(spark, ndvi, ndwi, sar, want):
    got = one(spark, bands.change_score(*[F.lit(v).cast("double") for v in (ndvi, ndwi, sar)]))[0]
    assert got == want if want is None else got == pytest.approx(want)


def test_pair_metrics(spark):
    t1 = pixels(spark, [("same", 0, 0, 0.8, 0.2, None, 1.0), ("shape", 0, 0, 0.8, 0.2, 0.1, 1.0), ("nored", 0, 0, 0.8, None, 0.1, 1.0)])
    t2 = pixels(spark, [("same", 0, 0, 0.8, 0.2, None, 1.0), ("shape", 0, 1, 0.8, 0.2, 0.1, 1.0), ("nored", 0, 0, 0.8, 0.2, 0.1, 1.0)])
    j = px.pixel_pair_join(t1, t2, ["nir", "red", "green", "vv"])
    v = {r.pair_id: r for r in px.ndvi_change(j).collect()}
    assert v["same"].mean_abs_ndvi_delta == 0.0 and v["same"].error is None
    assert v["shape"].error == px.SHAPE_ERROR and v["shape"].mean_ndvi_delta is None
    assert v["nored"].error == px.MISSING_BANDS
    w = {r.pair_id: r for r in px.ndwi_change(j).collect()}
    assert w["same"].has_ndwi is False and w["same"].error is None
    assert [r.pair_id for r in px.pixel_pair_errors(j).collect()] == ["shape"]


def test_flat_images(spark):
    rows = [(1, r, c, 0.5) for r in range(3) for c in range(4)]
    flat = spark.createDataFrame(rows, "scene_id int, row int, col int, value double")
    box = px.box_filter_mean_var(flat, ["scene_id"], window=4).collect()
    assert len(box) == 12 and all(abs(r.local_mean - 0.5) < 1e-12 and abs(r.local_var) < 1e-12 for r in box)
    for f in (px.lee_filter, px.lee_filter_enhanced):
        assert all(abs(r.filtered - 0.5) < 1e-9 for r in f(flat, ["scene_id"]).collect())
    long = flat.withColumn("band", F.lit("b"))
    assert {r.normalized for r in px.band_normalize_sigma(long, ["scene_id", "band"]).collect()} == {0.0}
    assert {r.normalized for r in px.change_map_minmax(flat, "scene_id", "value").collect()} == {0.5}


# ---- scores


def test_confidence(spark):
    def band(*args, **kw):
        return tuple(one(spark, scores.confidence(*[F.lit(a) for a in args], **{k: F.lit(v) for k, v in kw.items()}))[0])

    assert band(True, True, False, 5.0, True) == ("low", "Low — parser fallback used; model fallback used")
    assert band(False, False, True, 45.0, False) == ("medium", "Medium — single observation; cloud cover 45%; coregistration failed")
    assert band(False, False, True, 5.0, True, disagreement=True, severity="major")[0] == "low"
    assert band(False, False, False, 5.0, True)[0] == "high"


def test_temporal_and_modality(spark):
    t, s, e = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-03-01", "2024-06-01"))
    none = F.lit(None).cast("timestamp")
    r = one(spark, scores.score_temporal(t, s, e), scores.score_temporal(s, s, e), scores.score_temporal(e, none, s), scores.score_temporal(none, s, e))
    assert r[0] == pytest.approx(1 - 60 / 365) and tuple(r)[1:] == (1.0, 0.5, 0.5)
    wanted = F.array(F.lit("Sentinel-1"))
    r = one(spark, scores.score_modality(F.lit("Sentinel-2"), wanted, F.lit(50.0), F.lit(20.0)), scores.score_modality(F.lit("Sentinel-1"), wanted, F.lit(None).cast("double"), F.lit(20.0)))
    assert tuple(r) == (0.15, 1.0)
    with pytest.raises(ValueError):
        scores.check_weights({"geo": 0.9, "temporal": 0.9, "semantic": 0, "modality": 0})


def test_explanation_text(spark):
    args = [F.lit(1), F.lit(0.875), F.lit("Sentinel-2"), F.lit("2024-01-01T00:00:00"), F.lit("POLYGON((77.0 28.5, 77.3 28.5, 77.3"), F.lit(None).cast("string")]
    assert one(spark, scores.result_explanation(*args))[0].startswith("This result is ranked #1 with a composite score of 0.88. The image was acquired by Sentinel-2")


# ---- text


def test_box_text(spark):
    texts = ["[0.25,0.30,0.60,0.80]", "bbox: [0.1, 0.2, 0.9, 0.9]", "[(0.1, 0.2), (0.9, 0.9)]", "<0.1, 0.2, 0.9, 0.9>", "x1=0.1 y1=0.2 x2=0.9 y2=0.9", "none", "[0.9, 0.2, 0.1, 0.9]", "[1.1, 0.2, 1.5, 0.9]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.parse_bbox_text(F.col("t"))).collect()]
    assert got == [[0.25, 0.3, 0.6, 0.8]] + [[0.1, 0.2, 0.9, 0.9]] * 4 + [None] * 3


def test_fence_lines(spark):
    r = one(spark, tx.strip_json_fence(F.lit('Sure\n```json\n{"a": 1}\n\n{"b": 2}\n```\nbye')), tx.strip_json_fence(F.lit('{"a": 1}\n')))
    assert r[0] == ['{"a": 1}', '{"b": 2}'] and r[1] == ['{"a": 1}']


def test_query_id_and_embedding(spark):
    r = one(spark, tx.stable_query_id(F.lit("  Show ME ")), vectors.hash_embedding(F.lit("abc")), vectors.norm(vectors.hash_embedding(F.lit("abc"))))
    import hashlib
    import uuid

    assert r[0] == str(uuid.UUID(hashlib.md5(b"show me").hexdigest()))
    raw = [b / 255 - 0.5 for b in hashlib.md5(b"abc").digest()]
    length = math.sqrt(sum(x * x for x in raw))
    assert r[1] == pytest.approx([x / length for x in raw]) and r[2] == pytest.approx(1.0)


def test_guardrail_with_user_function(spark):
    def polish(batches):
        for texts in batches:
            yield texts.map(lambda t: t + " consistent with floods" if "a" in t else t + " proves it")

    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r.text for r in guardrail.polish_descriptions(rows, "t", polish).collect()] == ["a consistent with floods", "b"]
    assert [r.text for r in guardrail.polish_descriptions(rows, "t", None).collect()] == ["a", "b"]


# ---- evaluation


def test_average_precision_and_empty_sets(spark):
    results = spark.createDataFrame([("q", 1, "a"), ("q", 2, "x"), ("q", 3, "b"), ("r", 1, "z")], "query_id string, rank int, scene_id string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("s", "c")], "query_id string, scene_id string")
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    marked, sizes = ev.mark_hits(results, relevant), ev.relevant_sizes(relevant)
    m = {r.query_id: r for r in ev.retrieval_metrics(marked, sizes, queries).collect()}
    assert m["q"].ap == pytest.approx((1 + 2 / 3) / 2) and m["q"].precision == pytest.approx(2 / 3) and m["q"].recall == 1.0
    assert (m["r"].recall, m["r"].precision, m["r"].ap) == (0.0, 0.0, 0.0)
    assert (m["s"].recall, m["s"].precision, m["s"].ap) == (0.0, 0.0, 0.0)
    other = {r.query_id: r.recall for r in ev.retrieval_metrics(marked, sizes, queries, empty_relevant=1.0).collect()}
    assert other["r"] == 1.0
    groups = spark.createDataFrame([("q", "g"), ("r", "h")], "query_id string, group string")
    items = spark.createDataFrame([("a", "g"), ("b", "g"), ("z", "other")], "scene_id string, group string")
    by_group = ev.mark_group_hits(results, groups, items)
    assert {(r.query_id, r.scene_id) for r in ev.intersect_hits(by_group).collect()} == {("q", "a"), ("q", "b")}
    assert {r.query_id: r.relevant for r in ev.group_sizes(groups, items).collect()} == {"q": 2, "r": 0}


def test_answer_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the the cat", "the the the the"), (3, "a", ""), (4, "Yes.", "yes .")],
        "id int, reference string, prediction string",
    )
    got = {r.id: r for r in ev.answer_scores(rows, "id").collect()}
    assert (got[1].bleu4, got[1].f1, got[1].exact_match) == (1.0, 1.0, 1.0)
    assert got[2].bleu4 == 0.0 and got[2].f1 == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3))
    assert (got[3].bleu4, got[3].f1, got[3].exact_match) == (0.0, 0.0, 0.0)
    assert got[4].exact_match == 1.0
    assert one(spark, ev.bleu_set(F.lit("a b c d e"), F.lit("a b c d e")))[0] == 1.0


def test_run_history(spark):
    schema = "metrics struct<r: double>, latency_ms struct<p50: double>, tag string, date date"
    rows = [((0.0,), (10.0,), "baseline_a", date(2024, 1, 1)), ((0.5,), (20.0,), "run", date(2024, 1, 2))]
    runs = ev.run_metrics(spark.createDataFrame(rows, schema), ["metrics", "latency_ms"])
    got = {r.metric: r.delta_pct for r in ev.baseline_compare(runs).collect()}
    assert got == {"metrics.r": 0.0, "latency_ms.p50": 100.0}


# ---- training data


def test_validation_reasons(spark):
    good = '{"query_text":"q","task_type":"search"}'
    rows = [
        (1, "fine", good, good), (2, "fine", "{oops", good), (3, "fine", '{"query_text":"q","task_type":"fly"}', good),
        (4, "fine", '{"query_text":"q","task_type":"vqa"}', good), (5, " ", good, good), (6, "x" * 301, good, good),
        (7, 'has {"a": 1}', good, good), (8, "fine", '{"task_type":"search","query_text":"q"}', good),
    ]
    df = spark.createDataFrame(rows, "id int, query_text string, structured_query string, seed_query string")
    got = {r.id: r.reject_reason for r in ex.validate_pairs(df).collect()}
    assert got[1] is None and got[2] == "json_parse" and got[3] == "schema" and got[4] == "label_drift"
    assert got[5] == got[6] == got[7] == "query_sanity" and got[8] is None


def test_label_answers_follow_the_class(spark):
    rows = spark.createDataFrame([("i", "water")], "id string, label string")
    _, qa, _ = ex.make_label_examples(rows, "id", "label")
    got = {r.question: r.answer for r in qa.collect()}
    assert got["Is this area water?"] == "Yes" and got["Is this an urban area?"] == "No"


def test_one_row_stratum_is_sampled(spark):
    rows = spark.createDataFrame([(i, "big") for i in range(30)] + [(99, "small")], "id int, s string")
    got = ex.stratified_sample(rows, "s", "id", 0.1).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"big": 3, "small": 1}


def test_fused_ranking_uses_user_encoder(spark):
    pairs = spark.createDataFrame([("q", "s1", "aa", "aa"), ("q", "s2", "aa", "b"), ("q", "s3", "", "b")], "query_id string, scene_id string, qt string, st string")

    def embed(batches):
        for texts in batches:
            yield texts.map(lambda t: [float(t.count("a")), 1.0])

    got = rt.semantic_rank(pairs, 3, "qt", "st", embed=embed).orderBy("rank").collect()
    assert [(r.scene_id, r.score) for r in got] == [("s1", 5.0), ("s2", 1.0), ("s3", 0.5)]


def test_stencil_goes_by_position(spark):
    rows = [("s", r, c, float(c)) for r in range(3) for c in range(9) if c != 4]
    pixels = spark.createDataFrame(rows, "scene_id string, row int, col int, value double")
    means = {(r.row, r.col): r.local_mean for r in px.box_filter_mean_var(pixels, ["scene_id"], window=3).collect()}
    assert len(means) == len(rows)
    assert abs(means[1, 3] - 2.5) < 1e-9 and abs(means[1, 5] - 5.5) < 1e-9 and abs(means[1, 7] - 7) < 1e-9


@pytest.mark.parametrize("window, tile", [(5, 128), (3, 4), (7, 5), (9, 2)])
def test_tiled_stencil_is_the_plain_one(spark, monkeypatch, window, tile):
    """Holes, nulls, repeated pixels, scenes that begin anywhere and scenes smaller than the window, over many tiles."""
    monkeypatch.setattr(px, "TILE", tile)
    rng = random.Random(window)
    rows = []
    for scene, (r0, c0, nr, nc) in enumerate([(0, 0, 13, 11), (-7, 100, 9, 20), (3, 3, 1, 6), (50, -2, 2, 2)]):
        for r in range(r0, r0 + nr):
            rows += [(scene, r, c, None if rng.random() < 0.1 else rng.random()) for c in range(c0, c0 + nc) if rng.random() > 0.15]
    rows += rows[:3]
    half = window // 2
    want = {}
    for scene in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scene]
        ends = [(min(x), max(x)) for x in zip(*[(r[1], r[2]) for r in mine])]

        def around(at, axis):
            lo, hi = ends[axis]
            n = hi - lo + 1
            for p in range(at - lo - half, at - lo + half + 1):
                p %= 2 * n
                yield lo + (p if p < n else 2 * n - 1 - p)

        def mean(xs):
            xs = [x for x in xs if x is not None]
            return sum(xs) / len(xs) if xs else None

        level = [(r, c, v, None if v is None else v * v) for _, r, c, v in mine]
        for axis in (1, 0):
            line, at = (0, 1) if axis else (1, 0)
            level = [
                (p[0], p[1], *(mean([q[k] for place in around(p[at], axis) for q in level if q[line] == p[line] and q[at] == place]) for k in (2, 3)))
                for p in level
            ]
        want |= {(scene, r, c): (m, None if m is None else q - m * m) for r, c, m, q in level}
    df = spark.createDataFrame(rows, "scene_id int, row int, col int, value double")
    got = px.box_filter_mean_var(df, ["scene_id"], window=window).collect()
    assert len(got) == len(rows)
    for x in got:
        m, v = want[x.scene_id, x.row, x.col]
        assert (x.local_mean, x.local_var) == (None, None) if m is None else (x.local_mean, x.local_var) == pytest.approx((m, v), abs=1e-12)


def test_upsert_ties_go_by_content(spark):
    old = spark.createDataFrame([("a", "z")], "scene_id string, object string")
    rows = [("a", "x", 1), ("a", "y", 1), ("a", None, 1)]
    for turn in (rows, rows[::-1]):
        new = spark.createDataFrame(turn, "scene_id string, object string, batch long")
        assert [tuple(r) for r in catalog.catalog_upsert(old, new).collect()] == [("a", "y")]
