"""Registered queries: variants of operators, and sinks and scans whose files are really written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import scores, text as tx
from ..operators import catalog as c, evalkit as ev, examples as ex, joins, pixels as px, retrieval as rt
from ..session import shared_folder
from ..sources import readers, sinks
from ..streaming import jobs
from .bindings import day_text
from .catalog_queries import STAGE1
from .pixel_queries import J, PAIRS, REPORT, joined
from .registry import query, r6
from .retrieval_queries import RETRIEVE, RUNS, _runs
from .text_queries import DOCS


def folder(d, name: str) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


# ---- variants ---------------------------------------------------------------


@query(
    "change_from_fraction",
    J
    + """, g AS (SELECT pair_id, CASE WHEN count_if(NOT matched) = 0 AND count(nir1) = count(*) AND count(nir2) = count(*) AND count(red1) = count(*) AND count(red2) = count(*)
      THEN avg(CASE WHEN abs(dv) > 0.5 THEN 1e0 ELSE 0e0 END) END AS f FROM p GROUP BY pair_id),
    t AS (SELECT *, printf('%.1f%%', round_even(f * 100, 1)) || ' of area shows NDVI shift > 0.5' AS area FROM g)
    SELECT pair_id, CASE WHEN f IS NULL THEN NULL WHEN f > 0.3 THEN 'Significant change detected: ' || area WHEN f > 0.1 THEN 'Moderate change detected: ' || area
      WHEN f > 0.01 THEN 'Minor change detected: ' || area ELSE 'Negligible change detected' END AS change_description FROM t""",
    PAIRS,
)
def _(d):
    changed = px.ndvi_change(joined(d), 0.5)
    return changed.select("pair_id", scores.change_from_fraction(F.col("ndvi_changed_fraction"), 0.5).alias("change_description"))


@query(
    "scene_text_placed",
    """SELECT scene_id, concat_ws(' ', nullif(object, ''), sensor, modality, 'near ' || printf('%.1f', CAST(round_even(CAST(printf('%.2f', x) AS DECIMAL(9, 2)), 1) AS DOUBLE))
      || ',' || printf('%.1f', CAST(round_even(CAST(printf('%.2f', y) AS DECIMAL(9, 2)), 1) AS DOUBLE))) AS scene_text
    FROM (SELECT *, min_lon AS x, min_lat AS y FROM scenes0)""",
    ("scenes0",),
)
def _(d):
    told = tx.scene_text_placed(F.col("object"), F.col("sensor"), F.col("modality"), F.col("geometry_wkt"))
    return d.unpaired.select("scene_id", told.alias("scene_text"))


@query(
    "merge_training_rows",
    """WITH+ f AS (SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN 'Captions' WHEN 1 THEN 'vqa_train' WHEN 2 THEN 'referring' WHEN 3 THEN 'my_grounding' WHEN 4 THEN 'fusion_pairs'
      WHEN 5 THEN 'change_vqa' ELSE 'misc' END AS f, CASE WHEN conv_id % 2 = 0 THEN 's1_' ELSE 'rgb_' END AS p FROM conversations)
    SELECT conv_id, turn, CASE f WHEN 'Captions' THEN 'caption' WHEN 'referring' THEN 'grounding' WHEN 'my_grounding' THEN 'grounding' WHEN 'fusion_pairs' THEN 'fusion'
      ELSE 'vqa' END AS task_type, CASE p WHEN 's1_' THEN 'sar' ELSE 'optical' END AS modality FROM f""",
)
def _(d):
    file = "CASE conv_id % 7 WHEN 0 THEN 'Captions' WHEN 1 THEN 'vqa_train' WHEN 2 THEN 'referring' WHEN 3 THEN 'my_grounding' WHEN 4 THEN 'fusion_pairs' WHEN 5 THEN 'change_vqa' ELSE 'misc' END"
    rows = d.table("conversations").selectExpr(
        "conv_id", "turn", f"'/data/change/' || {file} || '.jsonl' AS file", "CASE WHEN conv_id % 2 = 0 THEN 's1_' ELSE 'rgb_' END || conv_id || '.tif' AS image_id"
    )
    return ex.merge_training_rows(rows, "file").select("conv_id", "turn", "task_type", "modality")


@query(
    "first_per_task",
    "SELECT lang AS task, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50",
)
def _(d):
    return ex.first_per_task(d.view("answers"), "task", ["doc_id"], 50).select("task", "doc_id")


@query(
    "word_ngrams",
    DOCS
    + """SELECT doc_id, count(DISTINCT g) AS n_distinct, count(g) AS n_all FROM (SELECT n.doc_id, w.g FROM n LEFT JOIN
      (SELECT doc_id, list_aggregate(l[i:i + 2], 'string_agg', ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM
        (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS l FROM n))) w ON w.doc_id = n.doc_id) GROUP BY doc_id""",
)
def _(d):
    grams = tx.ngrams(F.coalesce(tx.words(tx.query_norm(F.col("text"))), F.array().cast("array<string>")), 3)
    rows = d.documents.select("doc_id", grams.alias("g"))
    return rows.select("doc_id", F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"), F.size("g").cast("bigint").alias("n_all"))


KM = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(
    "scenes_within_km",
    f"""WITH+ s AS (SELECT scene_id, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat FROM scenes0),
    q AS (SELECT query_id, (q_min_lon + q_max_lon) / 2 AS lon, (q_min_lat + q_max_lat) / 2 AS lat FROM search),
    k AS (SELECT query_id, scene_id, {KM.format(a="s", b="q")} AS km FROM s JOIN q ON abs(s.lat - q.lat) < 1)
    SELECT query_id, scene_id, round(km, 6) AS km_apart FROM k WHERE km <= 40""",
    ("scenes0", "search"),
)
def _(d):
    s = d.unpaired.selectExpr("scene_id", "(min_lon + max_lon) / 2 AS lon", "(min_lat + max_lat) / 2 AS lat")
    q = d.queries.selectExpr("query_id", "(q_min_lon + q_max_lon) / 2 AS q_lon", "(q_min_lat + q_max_lat) / 2 AS q_lat")
    found = joins.within_km(s, q, 40.0, ("lon", "lat"), ("q_lon", "q_lat"), ("scene_id", "query_id"))
    return found.select("query_id", "scene_id", r6("km_apart", "km_apart"))


SAID = fv.CONFIDENCE_TEXTS


@query(
    "confidence_band_inputs",
    RETRIEVE.replace("JOIN scenes0 s", "JOIN scenes s")
    + f"""SELECT query_id, scene_id, CASE WHEN low <> '' OR major THEN 'low' WHEN m <> '' THEN 'medium' ELSE 'high' END AS confidence_band,
    CASE WHEN low <> '' THEN '{SAID['low']}' || low WHEN major THEN '{SAID['major']}' WHEN m <> '' THEN '{SAID['medium']}' || m
      ELSE '{SAID['high']}' END AS confidence_reason
    FROM (SELECT *, query_id % 5 = 3 AND query_id % 2 = 0 AS major,
      concat_ws('; ', CASE WHEN change_flag THEN '{SAID['parser_fallback']}' END, CASE WHEN query_id % 9 = 2 THEN '{SAID['model_fallback']}' END) AS low,
      concat_ws('; ', CASE WHEN paired_scene_id IS NULL THEN '{SAID['single']}' END, CASE WHEN cloud_cover > 30 THEN printf('cloud cover %.0f%%', cloud_cover) END,
        CASE WHEN query_id % 4 IN (1, 2) THEN '{SAID['registration']}' END, CASE WHEN query_id % 5 = 3 THEN '{SAID['disagreement']}' END) AS m FROM results)""",
    ("scenes", "search"),
)
def _(d):
    flags = d.queries.select(
        "query_id", "change_flag",
        F.when(F.col("query_id") % 4 != 2, F.col("query_id") % 4 != 1).alias("registered"),
        F.struct((F.col("query_id") % 5 == 3).alias("disagreement"), F.when(F.col("query_id") % 2 == 0, "major").otherwise("minor").alias("severity")).alias("check"),
    )
    results = rt.retrieve_batch(d.scenes, d.queries, 10).join(flags, "query_id")
    out = rt.attach_confidence(
        results, F.lit("2002-01-01").cast("timestamp"), F.col("change_flag"), F.col("registered"), F.col("query_id") % 9 == 2, F.col("check")
    )
    return out.select("query_id", "scene_id", "confidence_band", "confidence_reason")


def variation(c: str, moving: str, unit: str, still: str) -> str:
    return f"CASE WHEN {c} > 0.05 THEN 'observed {moving} variation ({unit} abs delta: ' || printf('%.2f', round_even({c}, 2)) || ')' WHEN {c} IS NOT NULL THEN '{still}' END"


@query(
    "change_description_absolute",
    REPORT
    + f""", a AS (SELECT s.*, CASE WHEN s.bad THEN NULL ELSE g.av END AS va, CASE WHEN s.bad THEN NULL ELSE g.aw END AS wa, CASE WHEN s.bad THEN NULL ELSE g.sa END AS ra
      FROM s JOIN g ON g.pair_id = s.pair_id)
    SELECT pair_id, CASE WHEN coalesce(va, wa, ra) IS NULL THEN 'Insufficient data provided for temporal change description.' ELSE concat_ws(' ',
      'Bi-temporal analysis indicates no significant observed temporal change (change score: 0.0000).',
      'Sentinel-2 optical metrics show ' || nullif(concat_ws(', ', {variation('va', 'vegetation index', 'NDVI', 'stable vegetation index (NDVI)')},
        {variation('wa', 'water index', 'NDWI', 'stable water index (NDWI)')}), '') || '.',
      'Sentinel-1 SAR metrics show ' || {variation('ra', 'SAR backscatter', 'log-ratio', 'stable SAR backscatter intensity')} || '.') END AS change_description FROM a""",
    PAIRS,
)
def _(d):
    report = px.change_report(joined(d))
    no = F.lit(None).cast("double")
    told = scores.change_description(no, no, no, no, *[F.col(f"mean_abs_{n}_delta") for n in ("ndvi", "ndwi", "sar")])
    return report.select("pair_id", told.alias("change_description"))


@query(
    "explained_results",
    RETRIEVE.replace("JOIN scenes0 s", "JOIN scenes s")
    + """SELECT query_id, rank, scene_id, 'This result is ranked #' || rank || ' with a composite score of ' || printf('%.2f', CAST(round_even(CAST(round(score, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)) || '. The image was acquired by ' || sensor
      || ' on ' || coalesce(strftime(acquisition_time, '%Y-%m-%d'), 'an unknown date') || ' over ' || substr(geometry_wkt, 1, 30)
      || '... No additional model outputs available. These findings are consistent with the query criteria. Confidence: '
      || CASE WHEN m <> '' THEN 'Medium — ' || m ELSE 'High — primary models, clear observation, good registration' END || '.' AS note
    FROM (SELECT *, concat_ws('; ', CASE WHEN paired_scene_id IS NULL THEN 'single observation' END, CASE WHEN cloud_cover > 30 THEN printf('cloud cover %.0f%%', cloud_cover) END) AS m FROM results)""",
    ("scenes", "search"),
)
def _(d):
    results = rt.attach_confidence(rt.retrieve_batch(d.scenes, d.queries, 10), F.lit("2002-01-01").cast("timestamp"))
    out = rt.explained_results(results.withColumn("score", F.round("score", 6)), d.scenes)
    return out.select("query_id", "rank", "scene_id", "note")


# ---- files that are written and read back -----------------------------------

SCENE = """SELECT scene_id, sensor, modality, strftime(acquisition_time, '%Y-%m-%d') AS day, min_lon, min_lat, max_lon, max_lat,
    object, file_path, round(cloud_cover, 6) AS cloud_cover, dataset_origin FROM """


def scene_rows(df):
    return df.select(
        "scene_id", "sensor", "modality", day_text("acquisition_time").alias("day"), "min_lon", "min_lat", "max_lon", "max_lat", "object",
        "file_path", r6("cloud_cover", "cloud_cover"), "dataset_origin",
    )


@query("scan_catalog_snapshot", SCENE + "scenes0", ("scenes0",))
def _(d):
    path = folder(d, "snapshot")
    sinks.write_snapshot(d.unpaired, path)
    return scene_rows(readers.scan_catalog(d.spark, path))


@query(
    "catalog_upsert_stream",
    """WITH+ b AS (SELECT * REPLACE (CASE WHEN scene_no % 6 = 0 THEN 'third' WHEN scene_no % 4 = 0 THEN 'second' ELSE object END AS object) FROM scenes0
      UNION ALL SELECT * REPLACE ('n' || scene_id AS scene_id, 'added' AS object) FROM scenes0 WHERE scene_no % 9 = 0) """
    + SCENE
    + "b",
    ("scenes0",),
)
def _(d):
    """Three sets of files of a stream, one micro-batch each; what is read is the last snapshot."""
    at = lambda df, n: df.withColumn("ingested_at", F.timestamp_seconds(F.lit(1_700_000_000 + n)))
    s, source, root = d.unpaired, folder(d, "feed"), folder(d, "catalog")
    added = s.filter("scene_no % 9 = 0").withColumns({"scene_id": F.concat(F.lit("n"), "scene_id"), "object": F.lit("added")})
    parts = [
        at(s, 0), at(s.filter("scene_no % 4 = 0").withColumn("object", F.lit("second")), 10),
        at(s.filter("scene_no % 6 = 0").withColumn("object", F.lit("third")), 20).unionByName(at(added, 20)),
    ]
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = d.spark.readStream.schema(part.schema).parquet(source)
        jobs.catalog_upsert_stream(stream, root, f"{root}-state", buckets=8).awaitTermination()
    return scene_rows(jobs.read_snapshot(d.spark, root))


@query("scan_labels_csv", "SELECT 'doc, ' || doc_id || '.tif' AS image_filename, lang AS label FROM documents")
def _(d):
    path = folder(d, "labels")
    rows = d.documents.select(F.concat(F.lit("doc, "), "doc_id", F.lit(".tif")).alias("image_filename"), F.col("lang").alias("label"))
    rows.write.option("header", True).csv(path)
    return readers.scan_labels_csv(d.spark, path)


@query("scan_scene_json", SCENE + "scenes0", ("scenes0",))
def _(d):
    path = folder(d, "json")
    rows = d.unpaired.withColumn("acquisition_time", F.date_format("acquisition_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows.write.json(path)
    types = "scene_id string, sensor string, modality string, acquisition_time timestamp, min_lon double, min_lat double, max_lon double, max_lat double, object string, file_path string, cloud_cover double, dataset_origin string"
    return scene_rows(readers.scan_scene_json(d.spark, path, types, array=False))


@query(
    "sink_training_jsonl_rows",
    """SELECT 'captions' AS kind, scene_id || '.tif' AS image_id, 1 AS n FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL
    UNION ALL SELECT 'vqa', scene_id || '.tif', 5 FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL
    UNION ALL SELECT 'referring', scene_id || '.tif', 1 FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL""",
    ("scenes0",),
)
def _(d):
    path, rows = folder(d, "training"), c.filter_trainable(d.unpaired)
    sinks.sink_training_jsonl(ex.make_captions(rows), ex.make_vqa(rows), ex.make_referring(rows), path)
    out = None
    for kind in ("captions", "vqa", "referring"):
        part = d.spark.read.schema("image_id string").json(f"{path}/{kind}").groupBy("image_id").agg(F.count("*").cast("int").alias("n"))
        part = part.select(F.lit(kind).alias("kind"), F.concat(F.regexp_extract("image_id", r"(s\d{9})", 1), F.lit(".tif")).alias("image_id"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sink_vectors_rows",
    """WITH+ e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM e GROUP BY id)
    SELECT e.id, CAST(i - 1 AS INT) AS i, round(x / n, 6) AS x FROM e JOIN n ON e.id = n.id""",
)
def _(d):
    path = folder(d, "vectors")
    sinks.sink_vectors(d.table("embeddings"), "vec_id", "embedding", path)
    return d.spark.read.parquet(path).select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", r6("x", "x"))


@query("sink_eval_history_rows", RUNS + "SELECT 'baseline_x' AS tag, date AS day, metric, round(value, 6) AS value FROM runs UNION ALL SELECT 'again', date, metric, round(value, 6) FROM runs WHERE metric = 'error'")
def _(d):
    path, runs = folder(d, "history"), _runs(d).select(F.col("date").alias("day"), "metric", "value")
    sinks.sink_eval_history(runs, path, "baseline_x")
    sinks.sink_eval_history(runs.filter("metric = 'error'"), path, "again")
    back = d.spark.read.schema("tag string, day date, metric string, value double").json(path)
    return back.select("tag", "day", "metric", r6("value", "value"))


@query(
    "sink_manifest_file",
    """SELECT count(*) AS total_scenes, 0 AS paired_scenes, count_if(file_path IS NULL) || ' scenes missing file_path' AS last_caveat,
    string_agg(DISTINCT dataset_origin, ',' ORDER BY dataset_origin) AS sources FROM scenes0""",
    ("scenes0",),
)
def _(d):
    path = folder(d, "manifest")
    sinks.sink_manifest(c.catalog_manifest(d.unpaired.withColumn("paired_scene_id", F.lit(None).cast("string"))), path)
    back = d.spark.read.schema("total_scenes bigint, paired_scenes int, caveats array<string>, sources array<string>").json(path)
    return back.select("total_scenes", "paired_scenes", F.element_at("caveats", -1).alias("last_caveat"), F.array_join("sources", ",").alias("sources"))
