"""Scene catalog: filters, lookups, pairing, statistics, quality gates, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import geo
from ..functions.geo import Box
from .ordered import ROWS_PER_CHUNK, balanced_chunks, first_rows, with_neighbours



def newest_first() -> list[Column]:
    return [F.desc_nulls_last("acquisition_time"), F.asc("scene_id")]


def with_boxes(scenes: DataFrame) -> DataFrame:
    """Materialise ``min_lon … max_lat`` beside the WKT text."""
    box = geo.wkt_box(F.col("geometry_wkt"))
    return scenes.withColumn("__box", box).select(
        *scenes.columns, *[F.col(f"__box.{n}").alias(n) for n in Box._fields]
    )


# ---- filters ---------------------------------------------------------------


def end_bound(end: Column, end_inclusive_day: bool) -> Column:
    """Inclusive upper bound; with ``end_inclusive_day`` the whole last day counts."""
    if not end_inclusive_day:
        return end
    return F.date_trunc("day", end) + F.expr("INTERVAL '86399.999999' SECOND")


def catalog_filter(
    scenes: DataFrame,
    sensor: str | None = None,
    modality: str | None = None,
    object_like: str | None = None,
    start=None,
    end=None,
    origin: str | None = None,
    limit: int | None = None,
    end_inclusive_day: bool = False,
) -> DataFrame:
    """Equality, case-insensitive substring and inclusive time filters, newest first."""
    out = scenes
    if sensor is not None:
        out = out.filter(F.col("sensor") == sensor)
    if modality is not None:
        out = out.filter(F.col("modality") == modality)
    if object_like is not None:
        out = out.filter(F.col("object").ilike(f"%{object_like}%"))
    if start is not None:
        out = out.filter(F.col("acquisition_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("acquisition_time") <= end_bound(F.lit(end).cast("timestamp"), end_inclusive_day))
    if origin is not None:
        out = out.filter(F.col("dataset_origin") == origin)
    out = out.orderBy(*newest_first())
    return out if limit is None else out.limit(limit)


def sort_recent(scenes: DataFrame) -> DataFrame:
    return scenes.orderBy(*newest_first())


def catalog_get(scenes: DataFrame, ids: DataFrame) -> DataFrame:
    """Scenes whose id is in a table of ids; Spark broadcasts the id table when its size allows."""
    return scenes.join(ids.select("scene_id").distinct(), "scene_id", "left_semi")


def catalog_page(scenes: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    """One page of the filtered catalog, newest first, with the total of the filtered set."""
    hits = catalog_filter(scenes, **filters)
    total = hits.agg(F.count("*").alias("n")).scalar()
    page = hits.offset(offset).limit(limit)
    return page.withColumn("total", total)


def catalog_text_search(
    scenes: DataFrame, text: str, sensor: str | None = None, sort_by: str = "date", name: str = "name", tags: str = "tags"
) -> DataFrame:
    """Case-insensitive substring in the name, any tag or the id."""
    needle = text.lower()
    hit = (
        F.coalesce(F.lower(name).contains(needle), F.lit(False))
        | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(needle)), F.lit(False))
        | F.lower("scene_id").contains(needle)
    )
    out = scenes.filter(hit)
    if sensor is not None:
        out = out.filter(F.col("sensor") == sensor)
    return out.orderBy(*(newest_first() if sort_by == "date" else [F.asc(name), F.asc("scene_id")]))


def sensor_or_both(scene_sensor: Column, wanted: Column) -> Column:
    return wanted.isNull() | (wanted == "both") | (scene_sensor == wanted) | (scene_sensor == "both")


def filter_sensor_both(scenes: DataFrame, sensor: str | None) -> DataFrame:
    """A scene passes when its sensor is the wanted one or ``both``; wanting ``both`` passes all."""
    if sensor is None or sensor == "both":
        return scenes
    return scenes.filter(F.col("sensor").isin(sensor, "both"))


def matches_box(scene: Box, query: Box) -> Column:
    """Touching counts. No query box passes all; a scene without a box fails."""
    return ~query.known() | (scene.known() & geo.boxes_touch(scene, query))


def filter_bbox(scenes: DataFrame, box) -> DataFrame:
    if box is None:
        return scenes
    return scenes.filter(geo.boxes_touch(Box.named(), Box.literal(box)))


def matches_dates(when_: Column, start: Column, end: Column, end_inclusive_day: bool = False) -> Column:
    """Inclusive and open-ended; a scene without a date passes."""
    bound = end_bound(end, end_inclusive_day)
    return when_.isNull() | ((start.isNull() | (when_ >= start)) & (end.isNull() | (when_ <= bound)))


def filter_date_range(scenes: DataFrame, start=None, end=None, end_inclusive_day: bool = False) -> DataFrame:
    t = F.col("acquisition_time")
    out = scenes
    if start is not None:
        out = out.filter(t.isNull() | (t >= F.lit(start).cast("timestamp")))
    if end is not None:
        out = out.filter(t.isNull() | (t <= end_bound(F.lit(end).cast("timestamp"), end_inclusive_day)))
    return out


def matches_sensor(sensor: Column, wanted: Column) -> Column:
    return wanted.isNull() | sensor.isNull() | F.array_contains(wanted, sensor)


def filter_sensor_in(scenes: DataFrame, sensors: list[str] | None) -> DataFrame:
    if sensors is None:
        return scenes
    return scenes.filter(F.col("sensor").isNull() | F.col("sensor").isin(*sensors))


def matches_object(obj: Column, wanted: Column) -> Column:
    """Either text contains the other, ignoring case; a scene without an object fails."""
    a, b = F.lower(obj), F.lower(wanted)
    return wanted.isNull() | (obj.isNotNull() & (F.contains(a, b) | F.contains(b, a)))


def filter_object_fuzzy(scenes: DataFrame, wanted: str | None) -> DataFrame:
    return scenes if wanted is None else scenes.filter(matches_object(F.col("object"), F.lit(wanted)))


def filter_any_object(scenes: DataFrame, objects: list[str], sensor: str | None = None) -> DataFrame:
    """Any of the words is a substring of the object."""
    out = scenes
    if objects:
        wanted = F.array(*[F.lit(o.lower()) for o in objects])
        out = out.filter(F.exists(wanted, lambda o: F.contains(F.lower(F.coalesce("object", F.lit(""))), o)))
    return out if sensor is None else out.filter(F.col("sensor") == sensor)


def has_path() -> Column:
    return F.coalesce("file_path", F.lit("")) != ""


def filter_trainable(scenes: DataFrame) -> DataFrame:
    """Scenes with both a file and a label."""
    return scenes.filter(has_path() & (F.coalesce("object", F.lit("")) != ""))


def filter_modality(df: DataFrame, modalities: list[str], column: str = "modality") -> DataFrame:
    return df.filter(F.col(column).isin(*modalities))


def stac_search_filter(
    items: DataFrame,
    aois: DataFrame,
    start,
    end,
    cloud_max: float | None,
    required_assets: list[str],
    per_group: int,
) -> DataFrame:
    """At most ``per_group`` newest items per (AOI, sensor) that match box, dates, clouds and assets.

    ``aois`` holds ``aoi`` and a box; ``items`` carries ``aoi`` and an ``assets`` array.
    """
    t = F.col("acquisition_time")
    ok = (t >= F.lit(start).cast("timestamp")) & (t <= F.lit(end).cast("timestamp"))
    if cloud_max is not None:
        ok = ok & (F.col("cloud_cover").isNull() | (F.col("cloud_cover") < cloud_max))
    for asset in required_assets:
        ok = ok & F.array_contains("assets", asset)
    areas = aois.select("aoi", *[F.col(n).alias("a_" + n) for n in Box._fields])
    hits = items.filter(ok).join(areas, "aoi").filter(geo.boxes_touch(Box.named(), Box.named("a_")))
    kept = first_rows(hits, ["aoi", "sensor"], newest_first(), per_group)
    return kept.drop(*["a_" + n for n in Box._fields])


def per_group_limit(scenes: DataFrame, keys: list[str], n: int) -> DataFrame:
    return first_rows(scenes, keys, newest_first(), n)


# ---- pairing ---------------------------------------------------------------


def pair_consecutive(scenes: DataFrame, keys: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Link each scene to the next scene of its place and sensor, the last one to its predecessor."""
    chunked = balanced_chunks(scenes, keys, ["acquisition_time", "scene_id"], rows_per_chunk, always=False)
    linked = with_neighbours(chunked, keys, "acquisition_time", "scene_id", "__prev", "__next")
    return linked.withColumn("paired_scene_id", F.coalesce("__next.id", "__prev.id")).drop("__prev", "__next", "__chunk")


def pair_lookup(scenes: DataFrame) -> DataFrame:
    """Each paired scene with the scene it points to."""
    other = scenes.select(
        F.col("scene_id").alias("paired_scene_id"),
        F.col("sensor").alias("pair_sensor"),
        F.col("acquisition_time").alias("pair_time"),
        F.col("object").alias("pair_object"),
    )
    return scenes.join(other, "paired_scene_id")


def pair_check(scenes: DataFrame) -> DataFrame:
    """One row per paired scene: ``missing``, ``not_mutual``, ``same_time`` or ``valid``."""
    left = scenes.filter(F.coalesce("paired_scene_id", F.lit("")) != "").select(
        "scene_id", "paired_scene_id", "acquisition_time"
    )
    right = scenes.select(
        F.col("scene_id").alias("r_id"), F.col("paired_scene_id").alias("r_pair"), F.col("acquisition_time").alias("r_t")
    )
    reason = (
        F.when(F.col("r_id").isNull(), "missing")
        .when(~F.col("r_pair").eqNullSafe(F.col("scene_id")), "not_mutual")
        .when(F.col("r_t") == F.col("acquisition_time"), "same_time")
        .otherwise("valid")
    )
    joined = left.join(right, F.col("paired_scene_id") == F.col("r_id"), "left")
    return joined.select("scene_id", "paired_scene_id", reason.alias("reason"))


def pair_integrity(scenes: DataFrame) -> DataFrame:
    """One row: pairs in total and valid (each is seen from both ends), failures by kind, verdict."""
    r = F.col("reason")
    return (
        pair_check(scenes)
        .agg(
            F.count("*").alias("n"),
            F.count_if(r == "valid").alias("ok"),
            F.count_if(r == "missing").alias("missing"),
            F.count_if(r == "not_mutual").alias("not_mutual"),
            F.count_if(r == "same_time").alias("same_time"),
        )
        .select(
            F.floor(F.col("n") / 2).alias("total_pairs"),
            F.floor(F.col("ok") / 2).alias("valid_pairs"),
            "missing",
            "not_mutual",
            "same_time",
            (F.col("n") == F.col("ok")).alias("passed"),
        )
    )


# ---- statistics and gates --------------------------------------------------


def catalog_stats(scenes: DataFrame) -> DataFrame:
    """``(dimension, value, n, paired)`` by origin, sensor, modality and in total, in one pass.

    Counting per combination first keeps the grouping-set expansion off the scene rows.
    """
    has_pair = F.col("paired_scene_id").isNotNull()
    combos = scenes.groupBy("dataset_origin", "sensor", "modality").agg(
        F.count("*").alias("__n"), F.count_if(has_pair).alias("__p")
    )
    dims = [F.col("dataset_origin"), F.col("sensor"), F.col("modality")]
    sets = combos.groupingSets(
        [[dims[0]], [dims[1]], [dims[2]], []], *dims
    ).agg(F.grouping_id().alias("__g"), F.sum("__n").alias("n"), F.sum("__p").alias("paired"))
    which = F.create_map(
        *[F.lit(x) for kv in {3: "dataset_origin", 5: "sensor", 6: "modality", 7: "total"}.items() for x in kv]
    )
    return sets.select(
        F.element_at(which, F.col("__g").cast("int")).alias("dimension"), F.coalesce(*dims).alias("value"), "n", "paired"
    )


def landmark_check(scenes: DataFrame, landmarks=None, max_degrees: float = 5.0) -> DataFrame:
    """Flag scenes near a landmark of their origin; without one, a centre in range is enough.

    ``landmarks`` is a short list of ``(origin, lon, lat)``; it travels as literals, so no shuffle is needed.
    """
    box = Box.named()
    near = F.lit(False)
    for origin, lon, lat in landmarks or fv.LANDMARKS:
        close = geo.point_to_box_degrees(F.lit(lon), F.lit(lat), box) < max_degrees
        near = near | ((F.col("dataset_origin") == origin) & close)
    lon, lat = box.centre()
    in_range = lon.between(-180, 180) & lat.between(-90, 90)
    return scenes.withColumn("landmark_match", F.coalesce(near, F.lit(False)) | F.coalesce(in_range, F.lit(False)))


def crs_gate(scenes: DataFrame, per_origin: int | None = None) -> DataFrame:
    """All scenes, or the newest ``per_origin`` of every origin: geometry parses, bounds in range, landmark flag."""
    checked = scenes
    if per_origin is not None:
        checked = first_rows(scenes, ["dataset_origin"], newest_first(), per_origin).drop("rank")
    box = Box.named()
    in_range = (
        box.min_lon.between(-180, 180)
        & box.max_lon.between(-180, 180)
        & box.min_lat.between(-90, 90)
        & box.max_lat.between(-90, 90)
    )
    check = (
        F.when(~box.known(), "geometry_valid").when(~in_range, "lat_lon_bounds").otherwise("crs_verification")
    )
    flagged = landmark_check(checked)
    passed = check == "crs_verification"
    return flagged.select(
        "scene_id",
        "dataset_origin",
        check.alias("check"),
        passed.alias("passed"),
        F.when(passed, F.col("landmark_match")).alias("landmark_match"),
    )


def catalog_manifest(scenes: DataFrame, version: str = "1.0") -> DataFrame:
    """One row: totals, both gates, caveats and sources."""
    totals = scenes.agg(
        F.count("*").alias("total_scenes"),
        F.count_if(F.col("paired_scene_id").isNotNull()).alias("paired_scenes"),
        F.count_if(~has_path()).alias("missing_paths"),
    )
    origins = scenes.select("dataset_origin").distinct().agg(
        F.array_sort(F.collect_list("dataset_origin")).alias("sources")
    )
    crs = crs_gate(scenes).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("crs_passed"))
    pairs = pair_integrity(scenes).select("total_pairs", "valid_pairs", F.col("passed").alias("pairs_passed"))
    one = F.lit(1).alias("__k")  # every side is a single aggregate row
    row = totals.select("*", one)
    for side in (origins, crs, pairs):
        row = row.join(side.select("*", one), "__k")
    caveats = F.filter(
        F.array(
            F.when(~F.col("crs_passed"), "CRS verification failed for some scenes"),
            F.when(~F.col("pairs_passed"), "Pair integrity check failed for some pairs"),
            F.when(
                F.col("missing_paths") > 0,
                F.concat(F.col("missing_paths").cast("string"), F.lit(" scenes missing file_path")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    return row.select(
        F.lit(version).alias("catalog_version"),
        "total_scenes",
        "paired_scenes",
        "crs_passed",
        "pairs_passed",
        "total_pairs",
        "valid_pairs",
        caveats.alias("caveats"),
        "sources",
    )


# ---- upsert ----------------------------------------------------------------


def catalog_upsert(existing: DataFrame, batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Insert-or-replace: the row of the highest batch number wins, stored rows rank below any batch.

    Rows of one id and batch number are ordered by their content, so the winner does
    not depend on the order of the rows. The result is a new snapshot; write it to a new path (``sources.sinks.write_snapshot``).
    """
    stored = existing.withColumn(batch, F.lit(-1).cast("long"))
    both = stored.unionByName(batches.withColumn(batch, F.col(batch).cast("long")), allowMissingColumns=True)
    return newest_versions(both, [F.desc(batch)]).drop(batch)


def newest_versions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per ``scene_id``: the first by ``order``, ties by the greatest content, column by column by name, nulls last."""
    content = [
        F.desc_nulls_last(F.to_json(c.name) if "map<" in c.dataType.simpleString() else c.name)
        for c in sorted(rows.schema, key=lambda c: c.name)
    ]
    return first_rows(rows, ["scene_id"], [*order, *content], 1).drop("rank")
