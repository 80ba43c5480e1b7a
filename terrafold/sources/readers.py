"""Readers: catalog snapshots, JSON, JSON lines, CSV, patch folders, pair files, STAC items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import geo
from ..functions.text import to_utc
from ..operators.catalog import with_boxes
from ..operators.examples import merge_training_rows
from ..operators.joins import label_map_join
from . import schemas


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stored catalog snapshot (Parquet partitioned by ``dataset_origin``)."""
    return spark.read.parquet(path)


def scan_scene_json(spark: SparkSession, path: str, schema: str = schemas.SCENES, array: bool = True) -> DataFrame:
    """Scenes, queries or results of a fixed schema from JSON; one bad value fails the load.

    A file is a JSON array, which one task reads, or with ``array=False`` has an object a line and can be split.
    """
    return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)


def decode_wavelengths(scenes: DataFrame) -> DataFrame:
    """The ingest variant's JSON text of band wavelengths as a map."""
    return scenes.withColumn("wavelengths_nm", F.from_json("wavelengths_nm", "map<string,double>"))


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (good rows, rejected lines); blank lines are ignored.

    Lines are read as text and parsed once per output, so a rejected line is
    kept whole.
    """
    return parse_jsonl(spark.read.text(path), schema)


def parse_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """``scan_jsonl_tolerant`` over lines in a column ``value``."""
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("__ok", F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    good = parsed.filter("__ok").select(F.from_json("value", schema).alias("r")).select("r.*")
    rejected = parsed.filter(~F.col("__ok")).select(F.col("value").alias("line"))
    return good, rejected


def scan_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image_filename string, label string").option("header", True).csv(path)


def scan_training_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Training examples of all JSON-lines files of a folder, each with the task its file's name tells."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("__file"))
    return merge_training_rows(rows, "__file").drop("__file")


def scan_patch_metadata(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Patch list from CSV or JSON; the key may have any of three names."""
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
    return named_patches(raw)


def named_patches(raw: DataFrame) -> DataFrame:
    """Rows that name a patch under one of the three keys, the first one that is not empty."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("patch_name", "image_id", "filename") if c in raw.columns]
    return raw.withColumn("patch", F.coalesce(*names)).filter(F.col("patch").isNotNull())


def scan_patch_labels(spark: SparkSession, root: str) -> DataFrame:
    """``patch, primary, label``: one label file per patch folder, in either naming.

    ``labels_metadata.json`` (with or without the patch name in front) wins
    over ``patch_labels.json``; folders without labels give no row.
    """
    files = (
        spark.read.schema(schemas.PATCH_LABELS)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*labels*.json")
        .json(root)
        .select("*", F.col("_metadata.file_path").alias("__f"))
    )
    return parse_patch_labels(files.withColumnRenamed("__f", "file"))


def parse_patch_labels(files: DataFrame) -> DataFrame:
    """``patch, primary, label`` from the label lists of files (``file``, ``labels``)."""
    parts = F.split("file", "/")
    files = files.select(
        F.element_at(parts, -2).alias("patch"),
        F.element_at(parts, -1).endswith("patch_labels.json").cast("int").alias("__old"),
        F.get("labels", F.lit(0)).alias("primary"),
    )
    best = files.groupBy("patch").agg(F.min_by("primary", "__old").alias("primary"))
    return label_map_join(best.filter(F.col("primary").isNotNull()), "primary", fv.LAND_COVER_CLASSES)


def scan_bitemporal_pairs(spark: SparkSession, path: str, origin: str = "cdvqa") -> DataFrame:
    """Two scene rows per pair, each pointing at the other; the question and answer go to the first one's object."""
    return parse_bitemporal(spark.read.schema(schemas.BITEMPORAL).option("multiLine", True).json(path), origin)


def parse_bitemporal(raw: DataFrame, origin: str = "cdvqa") -> DataFrame:
    """``scan_bitemporal_pairs`` over rows of ``schemas.BITEMPORAL``."""
    pair = F.sha2(F.to_json(F.struct("t1", "t2", "qa")), 256)
    ids = raw.withColumn("__p", F.substring(pair, 1, 32))
    sides = ids.select("__p", "qa", F.posexplode(F.array("t1", "t2")).alias("i", "s"))
    qa = F.concat(
        F.lit("QA: "), F.coalesce("qa.question", F.lit("")), F.lit(" "), F.coalesce("qa.answer", F.lit(""))
    )
    has_object = F.coalesce("s.object", F.lit("")) != ""
    first = F.when(has_object, F.concat(F.col("s.object"), F.lit(" | "), qa)).otherwise(qa)
    here, there = F.col("i") + 1, 2 - F.col("i")
    return sides.select(
        F.concat("__p", F.lit("-t"), here.cast("string")).alias("scene_id"),
        F.coalesce("s.sensor", F.lit("Sentinel-2")).alias("sensor"),
        F.coalesce("s.modality", F.lit("optical")).alias("modality"),
        F.lit(None).cast("timestamp").alias("acquisition_time"),
        F.coalesce("s.geometry_wkt", F.lit("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))")).alias("geometry_wkt"),
        F.col("s.file_path").alias("file_path"),
        F.col("s.cloud_cover").alias("cloud_cover"),
        F.when(F.col("i") == 0, first).otherwise(F.col("s.object")).alias("object"),
        F.concat("__p", F.lit("-t"), there.cast("string")).alias("paired_scene_id"),
        F.lit(origin).alias("dataset_origin"),
    )


def canonical_sensor(sensor: Column) -> Column:
    """``Sentinel-1``, ``Sentinel-2`` or ``both`` from the spellings in use."""
    s = F.regexp_replace(F.lower(sensor), r"[\s_]+", "-")
    return (
        F.when(s == "both", "both")
        .when(s.rlike(r"sentinel-?1|^sar$|^s1"), "Sentinel-1")
        .when(s.rlike(r"sentinel-?2|^optical$|^s2"), "Sentinel-2")
        .otherwise(sensor)
    )


def scan_stac_items(spark: SparkSession, path: str, origin: Column | None = None, label: Column | None = None) -> DataFrame:
    """Saved STAC items (one JSON object per line) as scene rows with boxes."""
    return parse_stac_items(spark.read.schema(schemas.STAC_ITEM).json(path), origin, label)


def parse_stac_items(raw: DataFrame, origin: Column | None = None, label: Column | None = None) -> DataFrame:
    """``scan_stac_items`` over rows of ``schemas.STAC_ITEM``."""
    optical = F.contains("collection", F.lit("sentinel-2"))
    box = geo.Box(*[F.get("bbox", F.lit(i)) for i in range(4)])
    return raw.filter(F.col("scene_id").isNotNull()).select(
        "scene_id",
        F.when(optical, "Sentinel-2").otherwise("Sentinel-1").alias("sensor"),
        F.when(optical, "optical").otherwise("sar").alias("modality"),
        to_utc(F.col("datetime")).alias("acquisition_time"),
        geo.box_wkt(box).alias("geometry_wkt"),
        F.coalesce("local_image", "signed_href").alias("file_path"),
        F.try_element_at("properties", F.lit("eo:cloud_cover")).try_cast("double").alias("cloud_cover"),
        (label if label is not None else F.lit("unknown")).alias("object"),
        F.lit(None).cast("string").alias("paired_scene_id"),
        (origin if origin is not None else F.lit("stac")).alias("dataset_origin"),
        "assets",
        *box.aliased(),
    )


def scan_eval_splits(spark: SparkSession, path: str) -> DataFrame:
    """``scene_id, split, aoi`` from one JSON object keyed by scene."""
    text = spark.read.option("wholetext", True).text(path)
    table = F.from_json("value", "map<string, struct<split: string, aoi: string>>")
    return text.select(F.explode(table).alias("scene_id", "s")).select("scene_id", "s.split", "s.aoi")


ALIASES = {
    "text_query": ["text_query", "query", "text"],
    "aoi": ["aoi", "bbox", "geometry"],
    "date_range": ["date_range", "date", "dates"],
    "sensor": ["sensor", "sensor_type"],
    "object": ["object", "target_object", "objects"],
    "cloud_cover_max": ["cloud_cover_max", "max_cloud_cover"],
    "resolution_max": ["resolution_max", "max_resolution"],
}
NUMERIC = {"cloud_cover_max", "resolution_max"}


def normalize_aliases(rows: DataFrame, json: str = "json") -> DataFrame:
    """Query objects with alternative field names: known fields by name, unknown keys kept in ``extra``.

    The first spelling present wins; a number that does not parse becomes null.
    """
    fields = F.from_json(json, "map<string,string>")
    base = rows.withColumn("__m", fields)
    known = sorted({a for names in ALIASES.values() for a in names} | {"extra_params"})

    def pick(names):
        out = None
        for n in names:
            has = F.map_contains_key("__m", F.lit(n))
            value = F.try_element_at("__m", F.lit(n))
            out = F.when(has, value) if out is None else out.when(has, value)
        return out

    columns = {
        target: pick(names).try_cast("double") if target in NUMERIC else pick(names)
        for target, names in ALIASES.items()
    }
    nested = F.coalesce(
        F.from_json(F.try_element_at("__m", F.lit("extra_params")), "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    loose = F.map_filter("__m", lambda k, v: ~k.isin(*known) & ~F.map_contains_key(nested, k))
    return base.withColumns({**columns, "extra": F.map_concat(loose, nested)}).drop("__m")


def ingest(*sources: DataFrame) -> DataFrame:
    """Union of scene sources with canonical sensors and boxes, ready for ``catalog_upsert``."""
    names = [c.split(" ")[0].strip() for c in schemas.SCENES.split(", ")]
    out = None
    for source in sources:
        part = source.select(*names)
        out = part if out is None else out.unionByName(part)
    return with_boxes(out.withColumn("sensor", canonical_sensor(F.col("sensor"))))
