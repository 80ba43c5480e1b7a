"""Readers, sinks and alias handling on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrafold.operators import catalog, joins
from terrafold.sources import readers, schemas, sinks

WKT = "POLYGON((77.0 28.5, 77.3 28.5, 77.3 28.8, 77.0 28.8, 77.0 28.5))"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def scene(i, **kw):
    row = dict(
        scene_id=f"a{i}", sensor="Sentinel-2", modality="optical", acquisition_time="2024-01-0%dT00:00:00Z" % i,
        geometry_wkt=WKT, file_path=f"/x/{i}.tif", cloud_cover=5.0, object="water", paired_scene_id=None, dataset_origin="t",
    )
    return {**row, **kw}


def test_scene_json_is_strict(spark, tmp_path):
    good = write(tmp_path / "g" / "a.json", json.dumps([scene(1), scene(2)]))
    assert readers.scan_scene_json(spark, good).count() == 2
    bad = write(tmp_path / "b" / "a.json", json.dumps([scene(1), scene(2, cloud_cover="many")]))
    with pytest.raises(Exception):
        readers.scan_scene_json(spark, bad).collect()


def test_wavelengths(spark):
    row = spark.createDataFrame([('{"B04": 665.0}',)], "wavelengths_nm string")
    assert readers.decode_wavelengths(row).first()[0] == {"B04": 665.0}


def test_jsonl_tolerant(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"image_id": "1", "caption": "x"}\n\n{"image_id": \n{"image_id": "2", "caption": "y"}\n')
    good, rejected = readers.scan_jsonl_tolerant(spark, path, "image_id string, caption string")
    assert sorted(r.image_id for r in good.collect()) == ["1", "2"]
    assert [r.line for r in rejected.collect()] == ['{"image_id": ']


def test_labels_csv(spark, tmp_path):
    path = write(tmp_path / "l.csv", "image_filename,label\na.png,forest\n")
    assert readers.scan_labels_csv(spark, path).collect() == [("a.png", "forest")]


def test_patch_metadata_key_names(spark, tmp_path):
    csv = write(tmp_path / "m.csv", "patch_name,image_id,x\nP1,,1\n,P2,2\n,,3\n")
    assert sorted(r.patch for r in readers.scan_patch_metadata(spark, csv, "csv").collect()) == ["P1", "P2"]
    js = write(tmp_path / "m.json", json.dumps([{"filename": "P3"}]))
    assert [r.patch for r in readers.scan_patch_metadata(spark, js, "json").collect()] == ["P3"]


def test_patch_labels(spark, tmp_path):
    write(tmp_path / "p" / "A" / "labels_metadata.json", json.dumps({"labels": ["pastures", "water"], "tile_id": "t"}))
    write(tmp_path / "p" / "A" / "patch_labels.json", json.dumps({"labels": ["marine waters"]}))
    write(tmp_path / "p" / "B" / "patch_labels.json", json.dumps({"labels": ["lava"]}))
    write(tmp_path / "p" / "C" / "C_labels_metadata.json", json.dumps({"labels": []}))
    rows = {r.patch: (r.primary, r.label) for r in readers.scan_patch_labels(spark, str(tmp_path / "p")).collect()}
    assert rows == {"A": ("pastures", "agriculture"), "B": ("lava", "lava")}


def test_patch_name_match(spark):
    meta = spark.createDataFrame([("P_1",), ("P_2",), ("none",)], "patch string")
    dirs = spark.createDataFrame([("xP_1_b",), ("xP_1_a",), ("P_2",), ("P_3",)], "dir string")
    rows = {r.patch: r.dir for r in joins.patch_name_match(meta, "patch", dirs, "dir").collect()}
    assert rows == {"P_1": "xP_1_a", "P_2": "P_2"}


def test_bitemporal_pairs_link_each_other(spark, tmp_path):
    pair = {"t1": {"sensor": "Sentinel-2", "object": "lake"}, "t2": {"object": None}, "qa": {"question": "Q?", "answer": "A"}}
    path = write(tmp_path / "p.json", json.dumps([pair]))
    rows = readers.scan_bitemporal_pairs(spark, path).orderBy("scene_id").collect()
    assert [r.paired_scene_id for r in rows] == [rows[1].scene_id, rows[0].scene_id]
    assert [r.object for r in rows] == ["lake | QA: Q? A", None]
    assert rows[1].sensor == "Sentinel-2" and rows[0].acquisition_time is None


def test_stac_items(spark, tmp_path):
    item = {
        "scene_id": "s1", "collection": "sentinel-2-l2a", "datetime": "2024-03-01T05:00:00Z", "bbox": [77.0, 28.5, 77.3, 28.8],
        "assets": ["B04"], "signed_href": "http://x", "properties": {"eo:cloud_cover": 7.5},
    }
    radar = {**item, "scene_id": "s2", "collection": "sentinel-1-grd", "local_image": "/l.tif", "properties": {}}
    path = write(tmp_path / "i.json", json.dumps(item) + "\n" + json.dumps(radar) + "\n")
    rows = {r.scene_id: r for r in readers.scan_stac_items(spark, path).collect()}
    assert rows["s1"].sensor == "Sentinel-2" and rows["s1"].cloud_cover == 7.5 and rows["s1"].file_path == "http://x"
    assert rows["s2"].modality == "sar" and rows["s2"].file_path == "/l.tif" and rows["s2"].cloud_cover is None
    assert rows["s1"].acquisition_time == datetime(2024, 3, 1, 5)
    assert rows["s1"].geometry_wkt == WKT
    full = readers.ingest(readers.scan_stac_items(spark, path))
    assert full.filter(F.col("max_lat") == 28.8).count() == 2


def test_eval_splits(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps({"a": {"split": "test", "aoi": "x"}, "b": {"split": "train", "aoi": "y"}}))
    assert sorted(readers.scan_eval_splits(spark, path).collect()) == [("a", "test", "x"), ("b", "train", "y")]


def test_aliases(spark):
    rows = [
        '{"query": "q1", "max_cloud_cover": "12.5", "geometry": [1, 2], "colour": "red", "extra_params": {"k": "v"}}',
        '{"text_query": "q2", "query": "no", "cloud_cover_max": "many", "target_object": "lake"}',
    ]
    got = readers.normalize_aliases(spark.createDataFrame([(r,) for r in rows], "json string")).collect()
    assert (got[0].text_query, got[0].cloud_cover_max, got[0].aoi) == ("q1", 12.5, "[1,2]")
    assert got[0].extra == {"colour": "red", "k": "v"}
    assert (got[1].text_query, got[1].cloud_cover_max, got[1].object, got[1].extra) == ("q2", None, "lake", {})


def test_sensor_spellings(spark):
    rows = spark.createDataFrame([("SAR",), ("sentinel 2",), ("both",), ("Landsat",)], "s string")
    got = [r[0] for r in rows.select(readers.canonical_sensor(F.col("s"))).collect()]
    assert got == ["Sentinel-1", "Sentinel-2", "both", "Landsat"]


def test_snapshot_round_trip_pushes_filters(spark, tmp_path):
    rows = spark.createDataFrame([scene(i, acquisition_time=datetime(2024, 1, i)) for i in range(1, 6)], schemas.SCENES)
    sinks.write_snapshot(catalog.with_boxes(rows), str(tmp_path / "v1"))
    back = readers.scan_catalog(spark, str(tmp_path / "v1"))
    hits = catalog.filter_bbox(back, (77.1, 28.6, 78.0, 29.0)).filter("dataset_origin = 't'").select("scene_id")
    plan = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(max_lon,77.1)" in plan and "PartitionFilters: [isnotnull(dataset_origin" in plan, plan
    assert "geometry_wkt" not in plan
    assert hits.count() == 5


def test_training_and_history_files(spark, tmp_path):
    a = spark.createDataFrame([("1", "c")], "image_id string, caption string")
    sinks.sink_training_jsonl(a, a, a, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t" / "captions")).collect() == [("c", "1")]
    for tag in ("baseline_1", "run"):
        sinks.sink_eval_history(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "h"), tag)
    assert sorted(r.tag for r in spark.read.json(str(tmp_path / "h")).collect()) == ["baseline_1", "run"]
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, e array<double>")
    sinks.sink_vectors(v, "id", "e", str(tmp_path / "v"))
    assert {r.id: r.vec for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    sinks.sink_manifest(a, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
