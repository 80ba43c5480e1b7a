"""Registered queries: catalog scans, filters, lookups, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import catalog as c, examples, guardrail, joins
from ..sources.readers import with_boxes
from ..sources.sinks import vectors_table
from .bindings import day_text
from .registry import query, r6

ID = ["scene_id"]
BASIC = ["scene_id", "sensor", "modality"]


def ids(df):
    return df.select("scene_id")


@query(
    "scan_catalog",
    """SELECT scene_id, sensor, modality, strftime(acquisition_time, '%Y-%m-%d') AS day, min_lon, min_lat, max_lon, max_lat,
    object, file_path, round(cloud_cover, 6) AS cloud_cover, dataset_origin FROM scenes0""",
    ("scenes0",),
)
def _(d):
    raw = d.unpaired.drop("min_lon", "min_lat", "max_lon", "max_lat")
    return with_boxes(raw).select(
        *BASIC, day_text("acquisition_time").alias("day"), "min_lon", "min_lat", "max_lon", "max_lat", "object",
        "file_path", r6("cloud_cover", "cloud_cover"), "dataset_origin",
    )


@query(
    "catalog_filter",
    """SELECT scene_id, sensor, object FROM scenes0 WHERE sensor = 'Sentinel-2' AND modality = 'optical'
    AND object ILIKE '%LAND%' AND acquisition_time >= TIMESTAMP '1996-01-01' AND acquisition_time <= TIMESTAMP '1999-06-30'
    AND dataset_origin = 'cdvqa'""",
    ("scenes0",),
)
def _(d):
    return c.catalog_filter(
        d.unpaired, "Sentinel-2", "optical", "LAND", "1996-01-01", "1999-06-30", "cdvqa"
    ).select("scene_id", "sensor", "object")


@query(
    "sort_recent",
    "SELECT scene_id, strftime(acquisition_time, '%Y-%m-%d') AS day FROM scenes0 ORDER BY acquisition_time DESC NULLS LAST, scene_id",
    ("scenes0",),
)
def _(d):
    return c.sort_recent(d.unpaired.select("scene_id", "acquisition_time")).select(
        "scene_id", day_text("acquisition_time").alias("day")
    )


@query(
    "catalog_get",
    """SELECT scene_id, sensor, object FROM scenes0
    WHERE scene_id IN (SELECT 's' || lpad(CAST(c_custkey * 3 AS VARCHAR), 9, '0') FROM customer)""",
    ("scenes0",),
)
def _(d):
    wanted = d.table("customer").selectExpr("'s' || lpad(CAST(c_custkey * 3 AS STRING), 9, '0') AS scene_id")
    return c.catalog_get(d.unpaired, wanted).select("scene_id", "sensor", "object")


@query(
    "catalog_page",
    """SELECT scene_id, (SELECT count(*) FROM scenes0 WHERE sensor = 'Sentinel-1' AND modality = 'sar') AS total
    FROM scenes0 WHERE sensor = 'Sentinel-1' AND modality = 'sar'
    ORDER BY acquisition_time DESC NULLS LAST, scene_id LIMIT 50 OFFSET 20""",
    ("scenes0",),
)
def _(d):
    return c.catalog_page(d.unpaired, 50, 20, sensor="Sentinel-1", modality="sar").select("scene_id", "total")


@query(
    "catalog_text_search",
    """SELECT scene_id FROM scenes0 WHERE sensor = 'Sentinel-2'
    AND (lower(file_path) LIKE '%9.tif%' OR lower(object) LIKE '%9.tif%' OR lower(modality) LIKE '%9.tif%' OR scene_id LIKE '%9.tif%'
      OR FALSE)
    UNION ALL SELECT scene_id || '+' FROM scenes0 WHERE lower(file_path) LIKE '%wet%' OR lower(object) LIKE '%wet%'
      OR lower(modality) LIKE '%wet%' OR scene_id LIKE '%wet%'""",
    ("scenes0",),
)
def _(d):
    named = d.unpaired.withColumns({"name": F.col("file_path"), "tags": F.array("object", "modality")})
    first = ids(c.catalog_text_search(named, "9.TIF", "Sentinel-2"))
    second = c.catalog_text_search(named, "Wet", sort_by="name").select(F.concat("scene_id", F.lit("+")).alias("scene_id"))
    return first.unionAll(second)


@query(
    "filter_sensor_both",
    """SELECT scene_id, 'one' AS wanted FROM scenes0 WHERE sensor IN ('Sentinel-1', 'both')
    UNION ALL SELECT scene_id, 'both' FROM scenes0""",
    ("scenes0",),
)
def _(d):
    one = c.filter_sensor_both(d.unpaired, "Sentinel-1").select("scene_id", F.lit("one").alias("wanted"))
    return one.unionAll(c.filter_sensor_both(d.unpaired, "both").select("scene_id", F.lit("both").alias("wanted")))


@query(
    "filter_bbox",
    "SELECT scene_id FROM scenes0 WHERE max_lon >= 72.05 AND min_lon <= 80 AND max_lat >= 10.05 AND min_lat <= 20",
    ("scenes0",),
)
def _(d):
    return ids(c.filter_bbox(d.unpaired, (72.05, 10.05, 80.0, 20.0)))


@query(
    "filter_date_range",
    """SELECT scene_id, 'closed' AS kind FROM scenes0 WHERE acquisition_time IS NULL
      OR (acquisition_time >= TIMESTAMP '1997-02-01' AND acquisition_time <= TIMESTAMP '1998-02-28')
    UNION ALL SELECT scene_id, 'open' FROM scenes0 WHERE acquisition_time IS NULL OR acquisition_time >= TIMESTAMP '2000-01-01'
    UNION ALL SELECT scene_id, 'whole day' FROM scenes0 WHERE acquisition_time IS NULL OR acquisition_time < TIMESTAMP '1996-01-02'""",
    ("scenes0",),
)
def _(d):
    s = d.unpaired
    parts = [
        (c.filter_date_range(s, "1997-02-01", "1998-02-28"), "closed"),
        (c.filter_date_range(s, "2000-01-01"), "open"),
        (c.filter_date_range(s, None, "1996-01-01", end_inclusive_day=True), "whole day"),
    ]
    out = None
    for rows, kind in parts:
        part = rows.select("scene_id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionAll(part)
    return out


@query("filter_sensor_in", "SELECT scene_id FROM scenes0 WHERE sensor IS NULL OR sensor IN ('Sentinel-1', 'both')", ("scenes0",))
def _(d):
    return ids(c.filter_sensor_in(d.unpaired, ["Sentinel-1", "both"]))


@query(
    "filter_object_fuzzy",
    """SELECT scene_id FROM scenes0 WHERE object IS NOT NULL
    AND (contains(lower(object), 'wetlands') OR contains('wetlands', lower(object)))""",
    ("scenes0",),
)
def _(d):
    return ids(c.filter_object_fuzzy(d.unpaired, "Wetlands"))


@query(
    "filter_any_object",
    """SELECT scene_id FROM scenes0 WHERE sensor = 'Sentinel-2'
    AND (contains(lower(coalesce(object, '')), 'river') OR contains(lower(coalesce(object, '')), 'land'))""",
    ("scenes0",),
)
def _(d):
    return ids(c.filter_any_object(d.unpaired, ["River", "land"], "Sentinel-2"))


@query(
    "filter_trainable",
    """SELECT scene_id, (SELECT count(*) FROM scenes0 WHERE coalesce(file_path, '') = '') AS without_path
    FROM scenes0 WHERE coalesce(file_path, '') <> '' AND coalesce(object, '') <> ''""",
    ("scenes0",),
)
def _(d):
    missing = d.unpaired.agg(F.count_if(~c.has_path())).scalar()
    return c.filter_trainable(d.unpaired).select("scene_id").withColumn("without_path", missing)


@query("filter_modality", "SELECT scene_id, modality FROM scenes0 WHERE modality IN ('sar', 'optical')", ("scenes0",))
def _(d):
    return c.filter_modality(d.unpaired, ["sar", "optical"]).select("scene_id", "modality")


@query(
    "filter_guardrail",
    """SELECT doc_id, CASE WHEN contains(lower(p), 'consistent with') AND NOT contains(lower(p), 'confirms')
      AND NOT contains(lower(p), 'detects') AND NOT contains(lower(p), 'proves') THEN p ELSE text END AS text
    FROM (SELECT doc_id, text, text || CASE doc_id % 4 WHEN 0 THEN ' Consistent with rain' WHEN 1 THEN ' consistent with, and Proves it'
      WHEN 2 THEN '' ELSE ' confirms' END AS p FROM documents)""",
)
def _(d):
    polished = F.concat(
        "text",
        F.when(F.col("doc_id") % 4 == 0, " Consistent with rain")
        .when(F.col("doc_id") % 4 == 1, " consistent with, and Proves it")
        .when(F.col("doc_id") % 4 == 2, "")
        .otherwise(" confirms"),
    )
    rows = d.table("documents").select("doc_id", "text", polished.alias("p"))
    return guardrail.filter_guardrail(rows, "p", "text").select("doc_id", "text")


@query(
    "schema_check",
    """SELECT doc_id, CASE WHEN NOT json_valid(structured_query) THEN 'json_parse'
      WHEN q IS NULL THEN 'query_text missing'
      WHEN t NOT IN ('search','vqa','caption','grounding','change','fusion','sar_change','sar_grounding') THEN 'task_type'
      WHEN s NOT IN ('Sentinel-1','Sentinel-2','both') THEN 'sensor'
      WHEN lower(f) NOT IN ('true','false') THEN 'change_flag' END AS reject_reason
    FROM (SELECT doc_id, structured_query,
      CASE WHEN json_valid(structured_query) THEN json_extract_string(structured_query, '$.query_text') END AS q,
      CASE WHEN json_valid(structured_query) THEN json_extract_string(structured_query, '$.task_type') END AS t,
      CASE WHEN json_valid(structured_query) THEN json_extract_string(structured_query, '$.sensor') END AS s,
      CASE WHEN json_valid(structured_query) THEN json_extract_string(structured_query, '$.change_flag') END AS f FROM generated)
    UNION ALL SELECT event_id + 1000000000, CASE WHEN json_valid(props) THEN 'query_text missing' ELSE 'json_parse' END FROM events""",
    ("generated",),
)
def _(d):
    docs = examples.schema_check(d.view("generated"), "structured_query").select("doc_id", "reject_reason")
    ev = examples.schema_check(d.table("events"), "props").select(
        (F.col("event_id") + 1000000000).alias("doc_id"), "reject_reason"
    )
    return docs.unionAll(ev)


@query(
    "stac_search_filter",
    """SELECT scene_id, aoi, sensor, rank FROM (SELECT s.scene_id, s.aoi, s.sensor,
      row_number() OVER (PARTITION BY s.aoi, s.sensor ORDER BY s.acquisition_time DESC NULLS LAST, s.scene_id) AS rank
      FROM (SELECT *, CASE WHEN scene_no % 5 = 0 THEN ['vv'] ELSE ['B04', 'B08', 'vv'] END AS assets FROM scenes0) s
      JOIN (SELECT aoi, min(min_lon) + 1 AS x0, min(min_lat) + 1 AS y0, max(max_lon) - 1 AS x1, max(max_lat) - 1 AS y1 FROM scenes0 GROUP BY aoi) a
      ON s.aoi = a.aoi WHERE acquisition_time >= TIMESTAMP '1996-01-01' AND acquisition_time <= TIMESTAMP '1999-12-31'
      AND (cloud_cover IS NULL OR cloud_cover < 20) AND list_contains(assets, 'B08') AND list_contains(assets, 'B04')
      AND s.max_lon >= x0 AND s.min_lon <= x1 AND s.max_lat >= y0 AND s.min_lat <= y1) WHERE rank <= 4""",
    ("scenes0",),
)
def _(d):
    assets = F.when(F.col("scene_no") % 5 == 0, F.array(F.lit("vv"))).otherwise(
        F.array(F.lit("B04"), F.lit("B08"), F.lit("vv"))
    )
    areas = d.unpaired.groupBy("aoi").agg(
        (F.min("min_lon") + 1).alias("min_lon"), (F.min("min_lat") + 1).alias("min_lat"),
        (F.max("max_lon") - 1).alias("max_lon"), (F.max("max_lat") - 1).alias("max_lat"),
    )
    hits = c.stac_search_filter(
        d.unpaired.withColumn("assets", assets), areas, "1996-01-01", "1999-12-31", 20.0, ["B08", "B04"], 4
    )
    return hits.select("scene_id", "aoi", "sensor", "rank")


@query(
    "catalog_upsert",
    """WITH+ b AS (SELECT scene_id, CAST(-1 AS BIGINT) AS batch, object FROM scenes0
      UNION ALL SELECT scene_id, 1, 'first' FROM scenes0 WHERE scene_no % 4 = 0
      UNION ALL SELECT scene_id, 2, 'second' FROM scenes0 WHERE scene_no % 6 = 0
      UNION ALL SELECT scene_id, 2, 'rival' FROM scenes0 WHERE scene_no % 12 = 0
      UNION ALL SELECT 'new' || scene_id, 1, 'added' FROM scenes0 WHERE scene_no % 9 = 0)
    SELECT scene_id, object FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY batch DESC, object DESC) AS r FROM b) WHERE r = 1""",
    ("scenes0",),
)
def _(d):
    s = d.unpaired.select("scene_id", "object", "scene_no")

    def batch(every, number, label, key=F.col("scene_id")):
        return s.filter(F.col("scene_no") % every == 0).select(
            key.alias("scene_id"), F.lit(label).alias("object"), F.lit(number).alias("batch")
        )

    added = batch(9, 1, "added", F.concat(F.lit("new"), "scene_id"))
    rows = batch(4, 1, "first").unionAll(batch(6, 2, "second")).unionAll(batch(12, 2, "rival")).unionAll(added)
    return c.catalog_upsert(s.drop("scene_no"), rows)


# ---- pairs, statistics, gates ----------------------------------------------


@query("pair_consecutive", "SELECT scene_id, paired_scene_id FROM scenes", ("scenes",))
def _(d):
    return d.scenes.select("scene_id", "paired_scene_id")


@query(
    "pair_lookup",
    """SELECT a.scene_id, a.paired_scene_id, b.sensor AS pair_sensor, b.object AS pair_object
    FROM scenes a JOIN scenes b ON a.paired_scene_id = b.scene_id""",
    ("scenes",),
)
def _(d):
    return c.pair_lookup(d.scenes).select("scene_id", "paired_scene_id", "pair_sensor", "pair_object")


PAIR_CHECK = """WITH+ q AS (SELECT scene_id, acquisition_time,
    CASE WHEN scene_no % 31 = 0 THEN 'gone' WHEN scene_no % 41 = 0 THEN NULL ELSE paired_scene_id END AS paired_scene_id FROM scenes),
  checked AS (SELECT a.scene_id, a.paired_scene_id, CASE WHEN b.scene_id IS NULL THEN 'missing'
    WHEN b.paired_scene_id IS DISTINCT FROM a.scene_id THEN 'not_mutual'
    WHEN a.acquisition_time = b.acquisition_time THEN 'same_time' ELSE 'valid' END AS reason
    FROM q a LEFT JOIN q b ON a.paired_scene_id = b.scene_id WHERE coalesce(a.paired_scene_id, '') <> '') """


def damaged_pairs(d):
    broken = F.when(F.col("scene_no") % 31 == 0, "gone").when(F.col("scene_no") % 41 != 0, F.col("paired_scene_id"))
    return d.scenes.withColumn("paired_scene_id", broken)


@query("pair_check", PAIR_CHECK + "SELECT * FROM checked", ("scenes",))
def _(d):
    return c.pair_check(damaged_pairs(d))


@query(
    "pair_integrity",
    PAIR_CHECK
    + """SELECT count(*) // 2 AS total_pairs, count_if(reason = 'valid') // 2 AS valid_pairs,
    count_if(reason = 'missing') AS missing, count_if(reason = 'not_mutual') AS not_mutual,
    count_if(reason = 'same_time') AS same_time, count(*) = count_if(reason = 'valid') AS passed FROM checked""",
    ("scenes",),
)
def _(d):
    return c.pair_integrity(damaged_pairs(d))


@query(
    "catalog_stats",
    """SELECT 'total' AS dimension, NULL AS value, count(*) AS n, count(paired_scene_id) AS paired FROM scenes
    UNION ALL SELECT 'dataset_origin', dataset_origin, count(*), count(paired_scene_id) FROM scenes GROUP BY 2
    UNION ALL SELECT 'sensor', sensor, count(*), count(paired_scene_id) FROM scenes GROUP BY 2
    UNION ALL SELECT 'modality', modality, count(*), count(paired_scene_id) FROM scenes GROUP BY 2""",
    ("scenes",),
)
def _(d):
    return c.catalog_stats(d.scenes)


LANDMARKS = """lm(o, x, y) AS (VALUES ('bigearthnet_txt', 11.0::DOUBLE, 48.0::DOUBLE), ('bigearthnet_txt', 2.0, 48.0),
  ('cdvqa', -122.0, 37.0), ('cdvqa', -118.0, 34.0), ('gee_assam', 91.7, 26.1), ('gee_assam', 94.2, 27.5)),
  near AS (SELECT scene_id, bool_or(sqrt(pow(greatest(min_lon - x, 0, x - max_lon), 2) + pow(greatest(min_lat - y, 0, y - max_lat), 2)) < 5) AS near
    FROM {scenes} s JOIN lm ON s.dataset_origin = lm.o GROUP BY scene_id) """


@query(
    "landmark_check",
    "WITH+ base AS (SELECT *, scene_no % 37 = 0 AS far FROM scenes0), moved AS (SELECT scene_id, dataset_origin, "
    "CASE WHEN far THEN min_lon + 200 ELSE min_lon END AS min_lon, min_lat, CASE WHEN far THEN max_lon + 200 ELSE max_lon END AS max_lon, "
    "max_lat FROM base), "
    + LANDMARKS.format(scenes="moved")
    + """SELECT m.scene_id, coalesce(near, FALSE) OR ((min_lon + max_lon) / 2 BETWEEN -180 AND 180 AND (min_lat + max_lat) / 2 BETWEEN -90 AND 90) AS landmark_match
    FROM moved m LEFT JOIN near n ON m.scene_id = n.scene_id""",
    ("scenes0",),
)
def _(d):
    far = F.when(F.col("scene_no") % 37 == 0, 200.0).otherwise(0.0)
    moved = d.unpaired.withColumns({"min_lon": F.col("min_lon") + far, "max_lon": F.col("max_lon") + far})
    return c.landmark_check(moved).select("scene_id", "landmark_match")


CRS = (
    "WITH+ base AS (SELECT *, scene_no % 3 = 0 AS bad FROM scenes0), moved AS (SELECT scene_id, dataset_origin, acquisition_time, "
    "CASE WHEN bad THEN min_lon + 200 ELSE min_lon END AS min_lon, CASE WHEN scene_no % 5 = 0 THEN NULL ELSE min_lat END AS min_lat, "
    "CASE WHEN bad THEN max_lon + 200 ELSE max_lon END AS max_lon, max_lat FROM base), "
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_origin ORDER BY acquisition_time DESC NULLS LAST, scene_id) AS r FROM moved){where}), "
    + LANDMARKS.format(scenes="top")
)
CRS_CHECKS = """SELECT scene_id, dataset_origin, chk AS "check", chk = 'crs_verification' AS passed, CASE WHEN chk = 'crs_verification' THEN landmark END AS landmark_match
    FROM (SELECT t.scene_id, t.dataset_origin, CASE WHEN min_lon IS NULL OR min_lat IS NULL THEN 'geometry_valid'
      WHEN NOT (min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180 AND min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90) THEN 'lat_lon_bounds'
      ELSE 'crs_verification' END AS chk,
      coalesce(near, FALSE) OR ((min_lon + max_lon) / 2 BETWEEN -180 AND 180 AND (min_lat + max_lat) / 2 BETWEEN -90 AND 90) AS landmark
      FROM top t LEFT JOIN near n ON t.scene_id = n.scene_id)"""


def _moved(d):
    """Scenes of which some lie out of range and some have no lower bound."""
    far = F.when(F.col("scene_no") % 3 == 0, 200.0).otherwise(0.0)
    return d.unpaired.withColumns(
        {
            "min_lon": F.col("min_lon") + far,
            "max_lon": F.col("max_lon") + far,
            "min_lat": F.when(F.col("scene_no") % 5 != 0, F.col("min_lat")),
        }
    )


@query("crs_gate", CRS.replace("{where}", "") + CRS_CHECKS, ("scenes0",))
def _(d):
    return c.crs_gate(_moved(d))


@query("crs_gate_sample", CRS.replace("{where}", " WHERE r <= 20") + CRS_CHECKS, ("scenes0",))
def _(d):
    return c.crs_gate(_moved(d), 20)


@query(
    "catalog_manifest",
    """WITH+ p AS (SELECT CASE WHEN b.paired_scene_id = a.scene_id AND a.acquisition_time IS DISTINCT FROM b.acquisition_time THEN 1
      WHEN b.paired_scene_id = a.scene_id AND a.acquisition_time IS NULL THEN 1 ELSE 0 END AS ok
      FROM scenes a LEFT JOIN scenes b ON a.paired_scene_id = b.scene_id WHERE a.paired_scene_id IS NOT NULL),
    crs AS (SELECT coalesce(bool_and(coalesce(min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180
      AND min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90, FALSE)), TRUE) AS ok FROM scenes)
    SELECT '1.0' AS catalog_version, (SELECT count(*) FROM scenes) AS total_scenes, (SELECT count(paired_scene_id) FROM scenes) AS paired_scenes,
      (SELECT ok FROM crs) AS crs_passed, (SELECT count(*) = sum(ok) FROM p) AS pairs_passed, (SELECT count(*) // 2 FROM p) AS total_pairs,
      (SELECT CAST(sum(ok) AS BIGINT) // 2 FROM p) AS valid_pairs,
      CASE WHEN (SELECT ok FROM crs) THEN '' ELSE 'CRS verification failed for some scenes; ' END
       || CASE WHEN (SELECT count(*) = sum(ok) FROM p) THEN '' ELSE 'Pair integrity check failed for some pairs; ' END
       || (SELECT count(*) FROM scenes WHERE file_path IS NULL) || ' scenes missing file_path' AS caveats,
      (SELECT string_agg(o, ',' ORDER BY o) FROM (SELECT DISTINCT dataset_origin AS o FROM scenes)) AS sources""",
    ("scenes",),
)
def _(d):
    return c.catalog_manifest(d.scenes).withColumns(
        {"caveats": F.array_join("caveats", "; "), "sources": F.array_join("sources", ",")}
    )


@query(
    "per_group_limit",
    """SELECT scene_id, rank FROM (SELECT scene_id, row_number() OVER (PARTITION BY aoi, sensor
    ORDER BY acquisition_time DESC NULLS LAST, scene_id) AS rank FROM scenes0) WHERE rank <= 3""",
    ("scenes0",),
)
def _(d):
    return c.per_group_limit(d.unpaired, ["aoi", "sensor"], 3).select("scene_id", "rank")


# ---- sinks (what is written) ------------------------------------------------


@query(
    "sink_manifest",
    """SELECT count(*) AS total_scenes, count_if(file_path IS NULL) AS missing_paths,
    string_agg(DISTINCT dataset_origin, ',' ORDER BY dataset_origin) AS sources FROM scenes0""",
    ("scenes0",),
)
def _(d):
    m = c.catalog_manifest(d.unpaired.withColumn("paired_scene_id", F.lit(None).cast("string")))
    written = F.from_json(F.to_json(F.struct("*")), m.schema)
    m = m.select(written.alias("j")).select("j.*")
    last = F.element_at("caveats", -1)
    return m.select(
        "total_scenes",
        F.regexp_extract(last, r"^(\d+) scenes", 1).cast("bigint").alias("missing_paths"),
        F.array_join("sources", ",").alias("sources"),
    )


@query(
    "sink_vectors",
    """WITH+ e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    n AS (SELECT id, sqrt(sum(x * x)) AS n FROM e GROUP BY id)
    SELECT e.id, CAST(i - 1 AS INT) AS i, round(x / n, 6) AS x FROM e JOIN n ON e.id = n.id""",
)
def _(d):
    v = vectors_table(d.table("embeddings"), "vec_id", "embedding")
    return v.select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", r6("x", "x"))


@query(
    "sink_training_jsonl",
    """SELECT 'captions' AS kind, count(*) AS n FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL
    UNION ALL SELECT 'vqa', 5 * count(*) FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL
    UNION ALL SELECT 'referring', count(*) FROM scenes0 WHERE file_path IS NOT NULL AND object IS NOT NULL""",
    ("scenes0",),
)
def _(d):
    rows = c.filter_trainable(d.unpaired)
    parts = [
        ("captions", examples.make_captions(rows), "image_id string, caption string"),
        ("vqa", examples.make_vqa(rows), "image_id string, question string, answer string"),
        ("referring", examples.make_referring(rows), "image_id string, expression string, bbox array<double>"),
    ]
    out = None
    for kind, df, schema in parts:
        # the JSON lines as written, read back with the declared schema
        back = df.select(F.from_json(F.to_json(F.struct("*")), schema).alias("r")).filter(F.col("r.image_id").isNotNull())
        part = back.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionAll(part)
    return out


# ---- joins ------------------------------------------------------------------


def sql_first_box(boxes, default):
    lines = " ".join(
        f"WHEN lon BETWEEN {a} AND {cc} AND lat BETWEEN {b} AND {dd} THEN '{label}'" for _, a, b, cc, dd, label in boxes
    )
    return f"CASE {lines} {default} END"


@query(
    "point_in_box_label",
    f"""SELECT scene_id, {sql_first_box(fv.LAND_COVER_BOXES, "WHEN lat > 28 AND lon > 75 AND lon < 78 THEN 'agriculture' WHEN lat < 10 THEN 'forest' ELSE 'mixed'")} AS land_cover,
    {sql_first_box(fv.SAR_LAND_COVER_BOXES, "ELSE 'mixed'")} AS sar_land_cover
    FROM (SELECT scene_id, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat FROM scenes0)""",
    ("scenes0",),
)
def _(d):
    both = joins.point_in_box_label(
        joins.point_in_box_label(d.unpaired, sar=True).withColumnRenamed("land_cover", "sar_land_cover")
    )
    return both.select("scene_id", "land_cover", "sar_land_cover")


@query(
    "label_left_join",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(d):
    labels = d.table("labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return joins.label_left_join(d.table("documents").select("doc_id"), labels, "doc_id", "label")


@query(
    "label_map_join",
    "WITH+ m(f, t) AS (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in fv.LAND_COVER_CLASSES.items())
    + """), fine AS (SELECT scene_id, coalesce(CASE scene_no % 23 WHEN 21 THEN 'moon dust' WHEN 22 THEN NULL
      ELSE (SELECT f FROM (SELECT f, row_number() OVER (ORDER BY f) - 1 AS i FROM m) WHERE i = scene_no % 20) END, 'none') AS fine FROM scenes0)
    SELECT scene_id, fine, coalesce(m.t, fine) AS label FROM fine LEFT JOIN m ON fine.fine = m.f""",
    ("scenes0",),
)
def _(d):
    names = F.array(*[F.lit(k) for k in sorted(fv.LAND_COVER_CLASSES)])
    fine = (
        F.when(F.col("scene_no") % 23 == 21, "moon dust")
        .when(F.col("scene_no") % 23 == 22, "none")
        .otherwise(F.get(names, (F.col("scene_no") % 20).cast("int")))
    )
    return joins.label_map_join(d.unpaired.select("scene_id", fine.alias("fine")), "fine")


@query(
    "footprint_overlap_pairs",
    """WITH+ b AS (SELECT scene_id, scene_no, CASE WHEN scene_no % 19 = 0 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs,
      CASE WHEN scene_no % 43 = 0 THEN 0 ELSE 3 END AS bands, min_lon, min_lat, CASE WHEN scene_no % 3 = 0 THEN max_lon - 0.03 ELSE max_lon END AS max_lon, max_lat, paired_scene_id FROM scenes),
    j AS (SELECT a.scene_id AS id_1, a.paired_scene_id AS id_2, a.crs AS c1, b.crs AS c2, a.bands AS n1, b.bands AS n2,
      greatest(0, least(a.max_lon, b.max_lon) - greatest(a.min_lon, b.min_lon)) * greatest(0, least(a.max_lat, b.max_lat) - greatest(a.min_lat, b.min_lat))
       / least((a.max_lon - a.min_lon) * (a.max_lat - a.min_lat), (b.max_lon - b.min_lon) * (b.max_lat - b.min_lat)) AS ov
      FROM b a JOIN b ON a.paired_scene_id = b.scene_id)
    SELECT id_1, id_2, round(ov, 6) AS overlap, c1 = c2 AND ov >= 0.8 AND n1 >= 1 AND n2 >= 1 AS compatible,
      CASE WHEN c1 <> c2 THEN 'CRS mismatch: ' || c1 || ' vs ' || c2 WHEN ov < 0.8 THEN printf('Footprint overlap %.1f%% < 80%% of smaller extent', ov * 100)
      WHEN n1 < 1 OR n2 < 1 THEN 'One or both images have no bands' ELSE 'Compatible' END AS reason FROM j""",
    ("scenes",),
)
def _(d):
    no = F.col("scene_no")
    bounds = d.scenes.withColumns(
        {
            "crs": F.when(no % 19 == 0, "EPSG:32643").otherwise("EPSG:4326"),
            "bands": F.when(no % 43 == 0, 0).otherwise(3),
            "max_lon": F.when(no % 3 == 0, F.col("max_lon") - 0.03).otherwise(F.col("max_lon")),
        }
    )
    pairs = d.scenes.filter(F.col("paired_scene_id").isNotNull()).select(
        F.col("scene_id").alias("id_1"), F.col("paired_scene_id").alias("id_2")
    )
    return joins.footprint_overlap_pairs(pairs, bounds).withColumn("overlap", F.round("overlap", 6))


INTERVAL = """WITH+ daily AS (SELECT aoi, CAST(acquisition_time AS DATE) AS day, max(scene_id) AS optical_id FROM scenes0
    WHERE modality IN ('optical', 'multispectral') AND acquisition_time IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT s.scene_id AS sar_id, s.aoi, d.optical_id, d.day, row_number() OVER (PARTITION BY s.scene_id ORDER BY {order}) AS r
    FROM scenes0 s JOIN daily d ON s.aoi = d.aoi AND d.day BETWEEN CAST(s.acquisition_time AS DATE) - 3 AND CAST(s.acquisition_time AS DATE) + 3
    WHERE s.modality = 'sar')
  SELECT sar_id, aoi, optical_id, strftime(day, '%Y-%m-%d') AS optical_day FROM j WHERE r = 1"""


def interval(d, prefer):
    pairs = joins.optical_sar_interval_join(d.unpaired, "aoi", prefer=prefer)
    return pairs.select("sar_id", "aoi", "optical_id", day_text("optical_date").alias("optical_day"))


@query("optical_sar_interval_join", INTERVAL.format(order="d.day"), ("scenes0",))
def _(d):
    return interval(d, "earliest")


@query(
    "optical_sar_interval_join_nearest",
    INTERVAL.format(order="abs(date_diff('day', CAST(s.acquisition_time AS DATE), d.day)), d.day"),
    ("scenes0",),
)
def _(d):
    return interval(d, "nearest")


STAGE1 = """WITH+ hits AS (SELECT q.query_id, s.scene_id, q.* EXCLUDE (query_id), s.* EXCLUDE (scene_id) FROM search q JOIN scenes0 s ON
    (q.q_min_lon IS NULL OR (s.max_lon >= q.q_min_lon AND s.min_lon <= q.q_max_lon AND s.max_lat >= q.q_min_lat AND s.min_lat <= q.q_max_lat))
    AND (s.acquisition_time IS NULL OR ((q.start_date IS NULL OR s.acquisition_time >= q.start_date) AND (q.end_date IS NULL OR s.acquisition_time <= q.end_date)))
    AND (q.sensors IS NULL OR list_contains(q.sensors, s.sensor))
    AND (q.query_object IS NULL OR (s.object IS NOT NULL AND (contains(lower(s.object), lower(q.query_object)) OR contains(lower(q.query_object), lower(s.object)))))) """


@query("query_scene_join", STAGE1 + "SELECT query_id, scene_id FROM hits", ("scenes0", "search"))
def _(d):
    return joins.query_scene_join(d.unpaired, d.queries).select("query_id", "scene_id")


@query("stage1_filter", STAGE1 + "SELECT query_id, scene_id FROM hits", ("scenes0", "search"))
def _(d):
    return joins.query_scene_join(d.unpaired, d.queries).select("query_id", "scene_id")


@query(
    "relax_empty",
    STAGE1
    + """, newest AS (SELECT scene_id FROM scenes0 ORDER BY acquisition_time DESC NULLS LAST, scene_id LIMIT 50)
    SELECT query_id, scene_id FROM hits
    UNION ALL SELECT q.query_id, n.scene_id FROM (SELECT query_id FROM search WHERE query_id NOT IN (SELECT query_id FROM hits)) q CROSS JOIN newest n""",
    ("scenes0", "search"),
)
def _(d):
    from ..operators.retrieval import relax_empty

    hits = joins.query_scene_join(d.unpaired, d.queries)
    return relax_empty(d.unpaired, d.queries, hits, 50).select("query_id", "scene_id")


@query(
    "detect_modality",
    """WITH+ f AS (SELECT doc_id, 'dir/' || CASE doc_id % 7 WHEN 0 THEN 'pc_sar_' WHEN 1 THEN 'S2_' WHEN 2 THEN 'paired_' WHEN 3 THEN 'Sentinel-1_'
      WHEN 4 THEN 'img_' WHEN 5 THEN 'combined_rgb' ELSE 'BigEarthNet' END || doc_id || '.tif' AS p FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(n, 'sar|s1_|sentinel-1|sentinel1|grd|_vv_|_vh_') THEN 'sar'
      WHEN regexp_matches(n, 'fusion|paired|combined') THEN 'fusion'
      WHEN regexp_matches(n, 's2_|sentinel-2|sentinel2|optical|rgb|ms_|msi_|pc_opt_|bigearthnet') THEN 'optical' ELSE 'unknown' END AS modality
    FROM (SELECT doc_id, lower(string_split(p, '/')[-1]) AS n FROM f)""",
)
def _(d):
    prefix = (
        "CASE doc_id % 7 WHEN 0 THEN 'pc_sar_' WHEN 1 THEN 'S2_' WHEN 2 THEN 'paired_' WHEN 3 THEN 'Sentinel-1_' "
        "WHEN 4 THEN 'img_' WHEN 5 THEN 'combined_rgb' ELSE 'BigEarthNet' END"
    )
    paths = d.table("documents").selectExpr("doc_id", f"'dir/' || {prefix} || CAST(doc_id AS STRING) || '.tif' AS p")
    return paths.select("doc_id", tx.detect_modality(F.col("p")).alias("modality"))
