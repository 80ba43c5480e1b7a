"""Registered queries: column functions and parsers over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scores, text as tx, vectors
from ..functions.geo import Box
from ..operators import joins
from ..sources import readers, schemas
from .registry import query, r6

TABLES = ("scenes0",)


@query(
    "haversine_km",
    """WITH+ p AS (SELECT scene_id, (min_lon + max_lon) / 2 AS lon, (min_lat + max_lat) / 2 AS lat FROM scenes0),
    h AS (SELECT scene_id, pow(sin((radians(20e0) - radians(lat)) / 2), 2)
      + cos(radians(lat)) * cos(radians(20e0)) * pow(sin((radians(78e0) - radians(lon)) / 2), 2) AS h FROM p)
    SELECT scene_id, round(2 * 6371e0 * asin(sqrt(h)), 6) AS km FROM h""",
    TABLES,
)
def _(d):
    lon, lat = Box.named().centre()
    return d.unpaired.select("scene_id", r6(geo.haversine_km(lon, lat, F.lit(78.0), F.lit(20.0)), "km"))


@query(
    "bbox_to_wkt",
    """SELECT o_orderkey, 'POLYGON((' || a || ' ' || b || ', ' || c || ' ' || b || ', ' || c || ' ' || e || ', ' || a || ' ' || e || ', ' || a || ' ' || b || '))' AS wkt
    FROM (SELECT o_orderkey, o_orderkey % 180 AS a, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 90 END AS b,
      o_orderkey % 180 + 1 AS c, o_custkey % 90 + 2 AS e FROM orders)""",
)
def _(d):
    a, b = F.col("o_orderkey") % 180, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 90)
    box = Box(a, b, a + 1, F.col("o_custkey") % 90 + 2)
    return d.table("orders").select("o_orderkey", geo.box_wkt(box).alias("wkt"))


@query(
    "bbox_around_point",
    """SELECT o_orderkey, x - 0.25 AS min_lon, y - 0.25 AS min_lat, x + 0.25 AS max_lon, y + 0.25 AS max_lat
    FROM (SELECT o_orderkey, (o_orderkey % 1440) / 4e0 - 180 AS x, (o_custkey % 720) / 4e0 - 90 AS y FROM orders)""",
)
def _(d):
    x, y = (F.col("o_orderkey") % 1440) / 4 - 180, (F.col("o_custkey") % 720) / 4 - 90
    box = geo.box_around(x, y, 0.25)
    return d.table("orders").select("o_orderkey", *box.aliased())


@query(
    "polygon_to_bbox",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN least(x, y, 3) END AS min_lon, CASE WHEN o_orderkey % 7 <> 0 THEN least(y, 5, x) END AS min_lat,
      CASE WHEN o_orderkey % 7 <> 0 THEN greatest(x, y, 3) END AS max_lon, CASE WHEN o_orderkey % 7 <> 0 THEN greatest(y, 5, x) END AS max_lat
    FROM (SELECT o_orderkey, (o_orderkey % 360)::DOUBLE AS x, (o_custkey % 180)::DOUBLE AS y FROM orders)""",
)
def _(d):
    x, y = (F.col("o_orderkey") % 360).cast("double"), (F.col("o_custkey") % 180).cast("double")
    ring = F.array(F.array(x, y), F.array(y, F.lit(5.0)), F.array(F.lit(3.0), x))
    empty = F.array().cast("array<array<array<double>>>")
    box = geo.polygon_box(F.when(F.col("o_orderkey") % 7 != 0, F.array(ring)).otherwise(empty))
    return d.table("orders").select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


@query(
    "cosine",
    """WITH+ e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN list_transform(embedding, lambda x: 0e0) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
    p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN list_inner_product(a, a) * list_inner_product(b, b) = 0 THEN 0e0
      ELSE round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) END AS sim FROM p""",
)
def _(d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    e = d.table("embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 7, zero).otherwise(v).alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", r6(vectors.cosine(F.col("v"), F.col("w")), "sim"))


@query(
    "strip_json_fence",
    """SELECT doc_id, len(ls)::INTEGER AS n, array_to_string(ls, '|') AS lines FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM documents)""",
)
def _(d):
    t, fence = F.coalesce("text", F.lit("")), F.lit("```")
    shown = (
        F.when(F.col("doc_id") % 4 == 0, t)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here it is:\n"), fence, F.lit("json\n"), t, F.lit("\n"), fence, F.lit("\nDone.")))
        .when(F.col("doc_id") % 4 == 2, F.concat(fence, F.lit("\n"), t, fence))
        .otherwise(F.concat(fence, F.lit("json\n"), t))
    )
    lines = tx.strip_json_fence(shown)
    return d.documents.select("doc_id", F.size(lines).alias("n"), F.array_join(lines, "|").alias("lines"))


@query(
    "to_utc",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + to_hours(10)
      - to_minutes(CASE o_orderkey % 5 WHEN 1 THEN 330 ELSE 0 END), '%Y-%m-%d %H:%M:%S') END AS utc FROM orders""",
)
def _(d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.col("o_orderkey") % 5
    text = (
        F.when(form == 0, F.concat(day, F.lit("T10:00:00Z")))
        .when(form == 1, F.concat(day, F.lit("T10:00:00+05:30")))
        .when(form == 2, F.concat(day, F.lit("T10:00:00")))
        .when(form == 3, F.concat(day, F.lit(" 10:00:00.000Z")))
        .otherwise("not a time")
    )
    return d.table("orders").select("o_orderkey", F.date_format(tx.to_utc(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "result_explanation",
    """SELECT scene_id, 'This result is ranked #' || (scene_no % 9 + 1) || ' with a composite score of ' || printf('%.2f', (scene_no % 8) / 8e0)
      || '. The image was acquired by ' || sensor || ' on ' || strftime(acquisition_time, '%Y-%m-%d') || ' over ' || substr('POLYGON((' || object || ' of some length to be cut', 1, 30)
      || '... ' || CASE WHEN scene_no % 3 = 0 THEN 'Seen before.' ELSE 'No additional model outputs available.' END
      || ' These findings are consistent with the query criteria.' AS explanation FROM scenes0""",
    TABLES,
)
def _(d):
    no = F.col("scene_no")
    wkt = F.concat(F.lit("POLYGON(("), F.col("object"), F.lit(" of some length to be cut"))
    told = scores.result_explanation(
        no % 9 + 1, (no % 8) / 8.0, F.col("sensor"), F.date_format("acquisition_time", "yyyy-MM-dd"), wkt,
        F.when(no % 3 == 0, "Seen before."),
    )
    return d.unpaired.select("scene_id", told.alias("explanation"))


@query(
    "normalize_aliases",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'q' || o_custkey WHEN 1 THEN 'text ' || o_custkey END AS text_query,
      CASE WHEN o_orderkey % 3 <> 2 THEN 'Sentinel-1' END AS sensor,
      CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 100)::DOUBLE END AS cloud_cover_max,
      CASE o_orderkey % 4 WHEN 2 THEN 'b' ELSE NULL END AS other, CASE WHEN o_orderkey % 4 = 2 THEN o_custkey::VARCHAR END AS deep FROM orders""",
)
def _(d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    parts = F.array_compact(F.array(
        F.when(key % 3 == 0, F.concat(F.lit('"query":"q'), cust, F.lit('"'))),
        F.when(key % 3 == 1, F.concat(F.lit('"text_query":"text '), cust, F.lit('","query":"never"'))),
        F.when(key % 3 != 2, F.lit('"sensor_type":"Sentinel-1"')),
        F.when(key % 4 == 0, F.concat(F.lit('"max_cloud_cover":'), (F.col("o_custkey") % 100).cast("string"))),
        F.when(key % 4 == 1, F.lit('"cloud_cover_max":"no number"')),
        F.when(key % 4 == 2, F.concat(F.lit('"other":"b","extra_params":{"deep":"'), cust, F.lit('"}'))),
    ))
    rows = d.table("orders").select("o_orderkey", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))
    extra = lambda name: F.try_element_at("extra", F.lit(name)).alias(name)
    return readers.normalize_aliases(rows).select("o_orderkey", "text_query", "sensor", "cloud_cover_max", extra("other"), extra("deep"))


@query(
    "patch_name_match",
    """WITH+ m AS (SELECT p_partkey, 'S2_' || p_partkey || '_x' AS name FROM part),
    f AS (SELECT 'tile/' || CASE WHEN p_partkey % 3 = 0 THEN 'A_' ELSE 'B_' END || 'S2_' || p_partkey || '_x.dir' AS dir, p_partkey FROM part WHERE p_partkey % 4 <> 1
      UNION ALL SELECT 'tile/0_S2_' || p_partkey || '_x', p_partkey FROM part WHERE p_partkey % 10 = 0)
    SELECT m.p_partkey, min(f.dir) AS dir FROM m JOIN f ON m.p_partkey = f.p_partkey GROUP BY m.p_partkey""",
)
def _(d):
    part, key = d.table("part"), F.col("p_partkey")
    name = F.concat(F.lit("S2_"), key.cast("string"), F.lit("_x"))
    side = F.when(key % 3 == 0, "A_").otherwise("B_")
    folders = part.filter(key % 4 != 1).select(F.concat(F.lit("tile/"), side, name, F.lit(".dir")).alias("dir"))
    folders = folders.unionByName(part.filter(key % 10 == 0).select(F.concat(F.lit("tile/0_"), name).alias("dir")))
    found = joins.patch_name_match(part.select("p_partkey", name.alias("name")), "name", folders, "dir")
    return found.select("p_partkey", "dir")


# ---- parsers over JSON text made from the tables ------------------------------


def _parsed(df, schema: str, *keep: str):
    """Rows of a schema from a JSON column ``value``."""
    return df.select(*keep, F.from_json("value", schema).alias("__r")).select(*keep, "__r.*")


LINE = """CASE doc_id % 5 WHEN 0 THEN '{{"image_id":"' || doc_id || '","caption":"' || lang || '","more":1}}' WHEN 1 THEN '{{"image_id":"' || doc_id
  WHEN 2 THEN '  ' WHEN 3 THEN '["' || doc_id || '"]' ELSE ' {{"caption":"only ' || source || '"}} ' END""".format()


@query(
    "parse_jsonl",
    "WITH+ l AS (SELECT doc_id, " + LINE + """ AS v FROM documents)
    SELECT 'good' AS kind, CASE WHEN d.doc_id % 5 = 0 THEN d.doc_id::VARCHAR END AS image_id,
      CASE WHEN d.doc_id % 5 = 0 THEN lang ELSE 'only ' || source END AS caption, NULL AS line FROM documents d WHERE d.doc_id % 5 IN (0, 4)
    UNION ALL SELECT 'rejected', NULL, NULL, v FROM l WHERE doc_id % 5 IN (1, 3)""",
)
def _(d):
    lines = d.documents.selectExpr(LINE + " AS value")
    good, rejected = readers.parse_jsonl(lines, "image_id string, caption string")
    none = F.lit(None).cast("string")
    good = good.select(F.lit("good").alias("kind"), "image_id", "caption", none.alias("line"))
    return good.unionByName(rejected.select(F.lit("rejected").alias("kind"), none.alias("image_id"), none.alias("caption"), "line"))


@query(
    "parse_stac_items",
    """SELECT 'it' || o_orderkey AS scene_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Sentinel-2' ELSE 'Sentinel-1' END AS sensor,
      CASE WHEN o_orderkey % 3 = 0 THEN 'optical' ELSE 'sar' END AS modality, strftime(o_orderdate, '%Y-%m-%d') AS day,
      CASE WHEN o_orderkey % 4 = 0 THEN 'local' || o_orderkey ELSE 'http' || o_orderkey END AS file_path,
      CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 100)::DOUBLE END AS cloud_cover, 'unknown' AS object, 'stac' AS dataset_origin,
      (o_orderkey % 170)::DOUBLE AS min_lon, (o_custkey % 80)::DOUBLE AS min_lat, (o_orderkey % 170 + 1)::DOUBLE AS max_lon, (o_custkey % 80 + 1)::DOUBLE AS max_lat
    FROM orders WHERE o_orderkey % 7 <> 0""",
)
def _(d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    item = F.struct(
        F.when(key % 7 != 0, F.concat(F.lit("it"), key)).alias("scene_id"),
        F.when(key % 3 == 0, "sentinel-2-l2a").otherwise("sentinel-1-grd").alias("collection"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("datetime"),
        F.array(key % 170, cust % 80, key % 170 + 1, cust % 80 + 1).alias("bbox"),
        F.concat(F.lit("http"), key).alias("signed_href"),
        F.when(key % 4 == 0, F.concat(F.lit("local"), key)).alias("local_image"),
        F.when(key % 3 == 0, F.create_map(F.lit("eo:cloud_cover"), (cust % 100).cast("string"))).alias("properties"),
    )
    raw = _parsed(d.table("orders").select(F.to_json(item).alias("value")), schemas.STAC_ITEM)
    return readers.parse_stac_items(raw).select(
        "scene_id", "sensor", "modality", F.date_format("acquisition_time", "yyyy-MM-dd").alias("day"), "file_path", "cloud_cover",
        "object", "dataset_origin", "min_lon", "min_lat", "max_lon", "max_lat",
    )


@query(
    "parse_bitemporal",
    """WITH+ p AS (SELECT o_orderkey AS k, i FROM orders, range(1, 3) t(i))
    SELECT k, i AS side, CASE WHEN k % 3 = 0 AND i = 1 THEN 'Sentinel-1' ELSE 'Sentinel-2' END AS sensor,
      CASE WHEN i = 1 THEN CASE WHEN k % 2 = 0 THEN 'field | ' ELSE '' END || 'QA: what of ' || k || ' ' || CASE WHEN k % 5 = 0 THEN '' ELSE 'a' || k END
        WHEN k % 4 = 0 THEN 'later' END AS object, 'f' || k || '_' || i AS file_path, TRUE AS pairs_meet FROM p""",
)
def _(d):
    k = F.col("o_orderkey")
    side = lambda i, sensor, obj: F.struct(
        sensor.alias("sensor"), F.concat(F.lit("f"), k, F.lit(f"_{i}")).alias("file_path"), obj.alias("object")
    )
    question = F.struct(
        F.concat(F.lit("what of "), k).alias("question"), F.when(k % 5 != 0, F.concat(F.lit("a"), k)).alias("answer")
    )
    first = side(1, F.when(k % 3 == 0, "Sentinel-1"), F.when(k % 2 == 0, "field"))
    second = side(2, F.lit(None).cast("string"), F.when(k % 4 == 0, "later"))
    value = F.to_json(F.struct(first.alias("t1"), second.alias("t2"), question.alias("qa")))
    rows = readers.parse_bitemporal(_parsed(d.table("orders").select(value.alias("value")), schemas.BITEMPORAL))
    place = lambda c: F.substring_index(c, "-t", -1).cast("int")
    met = (F.substring_index("scene_id", "-t", 1) == F.substring_index("paired_scene_id", "-t", 1)) & (
        place("scene_id") + place("paired_scene_id") == 3
    )
    return rows.select(
        F.regexp_extract("file_path", r"^f(\d+)_", 1).cast("bigint").alias("k"), place("scene_id").cast("bigint").alias("side"),
        "sensor", "object", "file_path", met.alias("pairs_meet"),
    )


@query(
    "parse_patch_labels",
    """WITH+ f AS (SELECT 'patch' || p_partkey AS patch, p_partkey AS k FROM part)
    SELECT patch, CASE WHEN k % 4 = 1 THEN 'pastures' WHEN k % 4 = 2 THEN 'lava' ELSE 'urban fabric' END AS "primary",
      CASE WHEN k % 4 = 1 THEN 'agriculture' WHEN k % 4 = 2 THEN 'lava' ELSE 'urban' END AS label FROM f WHERE k % 4 <> 3""",
)
def _(d):
    k = F.col("p_partkey")
    folder = F.concat(F.lit("root/patch"), k, F.lit("/"))
    new = F.when(k % 4 == 1, F.array(F.lit("pastures"), F.lit("other"))).when(k % 4 == 2, F.array(F.lit("lava"))).when(
        k % 4 == 3, F.array().cast("array<string>")
    )
    newer = d.table("part").filter(k % 4 != 0).select(F.concat(folder, F.lit("patch"), k, F.lit("_labels_metadata.json")).alias("file"), new.alias("labels"))
    older = d.table("part").filter(k % 4 != 3).select(F.concat(folder, F.lit("patch_labels.json")).alias("file"), F.array(F.lit("urban fabric")).alias("labels"))
    return readers.parse_patch_labels(newer.unionByName(older)).select("patch", "primary", "label")


@query(
    "named_patches",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'name' || p_partkey WHEN p_partkey % 3 = 1 THEN 'id' || p_partkey ELSE 'file' || p_partkey END AS patch
    FROM part WHERE p_partkey % 11 <> 5""",
)
def _(d):
    k = F.col("p_partkey")
    known = k % 11 != 5
    raw = d.table("part").select(
        "p_partkey",
        F.when(known & (k % 3 == 0), F.concat(F.lit("name"), k)).otherwise("").alias("patch_name"),
        F.when(known & (k % 3 != 2), F.concat(F.lit("id"), k)).alias("image_id"),
        F.when(known, F.concat(F.lit("file"), k)).alias("filename"),
    )
    return readers.named_patches(raw).select("p_partkey", "patch")
