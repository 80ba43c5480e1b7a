"""Spatial, interval and text joins written as equi-joins Spark can shuffle."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import geo
from ..functions.geo import Box
from ..session import materialize
from .catalog import matches_box, matches_dates, matches_sensor
from .space import Cells, Tiles, sample_boxes

QUERY_BOX = "q_"


def hot_key_salts(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """``keys, __salts`` of the keys holding more than ``rows_per_task`` rows (usually none)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__salts"))


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], row_id: str, rows_per_task: int) -> DataFrame:
    """Inner equi-join that spreads the hot keys of ``large`` and repeats only their ``small`` rows."""
    hot = hot_key_salts(large, keys, rows_per_task)
    salts = F.coalesce("__salts", F.lit(1))
    left = large.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(row_id), salts).cast("int"))
    right = small.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("__salts").join(right.drop("__salts"), [*keys, "__salt"]).drop("__salt")


def gridded(
    left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], rows_per_task: int, shuffled: bool = False
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the keys of an equi-join whose hot keys are cut on both sides.

    Keys are counted on both sides first (combined on the map side). A key with more than ``rows_per_task`` rows on
    a side, and any on the other, becomes a grid: each side is cut by a hash of its id and repeated for the
    pieces of the other, so a task meets at most about ``rows_per_task`` rows of either side. ``shuffled`` keeps the counts
    from being broadcast.
    """
    counts = [x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((left, "__a"), (right, "__b"))]
    pieces = lambda n: F.ceil(F.col(n) / rows_per_task).cast("int")
    hot = counts[0].join(counts[1].hint("merge") if shuffled else counts[1], keys).select(*keys, pieces("__a").alias("__a"), pieces("__b").alias("__b"))
    hot = materialize(hot.filter("__a > 1 OR __b > 1"))
    if not hot.head(1):
        return left, right, keys

    def cut(side: DataFrame, row_id: str, mine: str, other: str) -> DataFrame:
        # a row for every so many rows of a side: few, which Spark cannot know of a checkpoint
        side = side.join(F.broadcast(hot), keys, "left").fillna(1, ["__a", "__b"])
        own = F.pmod(F.xxhash64(row_id), F.col(mine)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.withColumn(f"__i{mine}", own).withColumn(f"__i{other}", every).drop("__a", "__b")

    return cut(left, ids[0], "__a", "__b"), cut(right, ids[1], "__b", "__a"), [*keys, "__i__a", "__i__b"]


def gridded_join(
    left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], rows_per_task: int, shuffled: bool = False
) -> DataFrame:
    """Inner equi-join whose hot keys are cut on both sides (``gridded``).

    ``shuffled`` keeps either side from being broadcast: Spark's estimates leave out by how much ``explode`` multiplies rows.
    """
    left, right, grid = gridded(left, right, keys, ids, rows_per_task, shuffled)
    return left.join(right.hint("merge") if shuffled else right, grid).drop("__i__a", "__i__b")


NO_DATE = -(2**31)
#: Places beside the cells: scenes with a box of few cells, as queries without such a box look for them, and all other scenes.
ANYWHERE, WIDE = -1, -2


def _period(days: int) -> Column:
    number = F.floor(F.unix_timestamp("acquisition_time") / (86400 * days))
    return F.coalesce(number, F.lit(NO_DATE)).cast("int")


def _query_periods(first: int | None, last: int | None, days: int) -> Column:
    """The periods a query may match. Open ends stop at the catalog's own range; undated scenes
    have a period of their own that every query visits."""
    none = F.array().cast("array<int>")
    bound = 86400 * days
    lo = F.greatest(F.floor(F.unix_timestamp("start_date") / bound).cast("int"), F.lit(first).cast("int"))
    # one day more, because the end may be widened to the whole last day
    hi = F.least(F.floor((F.unix_timestamp("end_date") + 86400) / bound).cast("int"), F.lit(last).cast("int"))
    dated = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)
    return F.concat(F.array(F.lit(NO_DATE)), F.coalesce(dated, none))


def _matching_objects(scenes: DataFrame, queries: DataFrame) -> DataFrame:
    """``__wanted, __o``: for every wanted text the scene objects that contain it or are contained in it, once per distinct pair of texts."""
    objects = scenes.select("__object").filter(F.col("__object").isNotNull()).distinct()
    wanted = queries.select("__wanted").filter(F.length("__wanted") > 0).distinct()
    inside = substring_pairs(objects, "__object", wanted, "__wanted").select(F.col("needle").alias("w"), F.col("hay").alias("o"))
    around = substring_pairs(wanted, "__wanted", objects, "__object").select(F.col("hay").alias("w"), F.col("needle").alias("o"))
    empty = wanted.select(F.col("__wanted").alias("w"), F.lit("").alias("o"))  # an empty object is in every text
    pairs = inside.union(around).union(empty).distinct()
    return pairs.select(F.col("w").alias("__wanted"), F.concat(F.lit("is "), F.col("o")).alias("__o"))


def keyed_sides(
    scenes: DataFrame, queries: DataFrame, period_days: int = 365, max_cells: int = 64, cells: Cells | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scenes and queries with the keys ``__place, __p, __o``: a place, a period and an object.

    Both sides carry the same kind of key, so that one equi-join finds all pairs:

    - place: the cells that a box touches (``space.Cells``, adapted to both sides). A pair of
      boxes counts in the cell of the lower left corner of what they share. Boxes in more than ``max_cells`` cells, broken and
      absent ones have no cell; scenes with such boxes are in the place ``WIDE``, which all queries visit, and queries with
      such boxes visit all other scenes in ``ANYWHERE``.
    - period: that of the scene's date, or none.
    - object: a scene is under its own and under any; a query is under those that match its wanted text, or any.
    """
    sb, qb = Box.named(), Box.named(QUERY_BOX)
    day = F.floor(F.unix_timestamp("acquisition_time") / (86400 * period_days)).cast("int")
    total = scenes.agg(F.count_if(sb.known()), F.min(day), F.max(day)).first()
    asked = queries.agg(F.count_if(qb.known())).first()[0]
    if cells is None:
        parts = [sample_boxes(df, box, key, n) for df, box, key, n in ((scenes, sb, "scene_id", total[0]), (queries, qb, "query_id", asked))]
        cells = Cells(*parts, (total[0] / max(len(parts[0]), 1), asked / max(len(parts[1]), 1)))
    # lower-cased once per row, not once per candidate pair
    scenes = scenes.withColumn("__object", F.lower("object"))
    queries = queries.withColumn("__wanted", F.lower("query_object"))
    numbers = lambda c: F.transform(c["cells"], lambda x: x["cell"])
    at = lambda *names: F.array(*[F.lit(n) for n in names])

    left = scenes.withColumns({"__c": cells.column(sb, max_cells), "__p": _period(period_days)})
    places = F.when(F.col("__c.wide"), at(WIDE)).otherwise(F.concat(numbers(F.col("__c")), at(ANYWHERE)))
    named = F.when(F.col("__object").isNotNull(), F.concat(F.lit("is "), F.col("__object")))
    left = left.withColumn("__place", F.explode(places)).drop("__c")
    left = left.withColumn("__o", F.explode(F.array_compact(F.array(F.lit("any"), named))))

    bound = "struct<cell:int,x0:double,y0:double,x1:double,y1:double>"
    nowhere = lambda n: F.from_json(F.lit(f'{{"cell": {n}}}'), bound)
    right = queries.withColumn("__c", cells.column(qb, max_cells))
    local = qb.known() & ~F.col("__c.wide")
    spots = F.when(local, F.concat(F.col("__c.cells"), F.array(nowhere(WIDE)))).otherwise(F.array(nowhere(ANYWHERE), nowhere(WIDE)))
    right = right.withColumn("__spot", F.explode(spots)).withColumn("__p", F.explode(_query_periods(total[1], total[2], period_days)))
    right = right.withColumn("__place", F.col("__spot.cell")).drop("__c")
    right = right.join(_matching_objects(scenes, queries), "__wanted", "left").withColumn("__o", F.coalesce("__o", F.lit("any")))

    return left, right


#: Buckets that the objects of scenes are dealt to for queries without a tile; scenes without an object have one more. Least rows of a task.
BUCKETS, LEAST_ROWS = 16, 1024


def placed_sides(scenes: DataFrame, queries: DataFrame, rows_per_task: int) -> tuple[DataFrame, DataFrame, int]:
    """Scenes and queries with the keys ``__place, __bucket``, and the rows of a side that a task should hold; ``__object`` and ``__wanted`` are in lower case.

    Each query with a box is in one tile (``space.Tiles``), with all scenes it may touch: scenes are copied, queries are not, and all its scenes meet
    it in one group unless that is cut. Queries without a box, or with a very large one, are in the place ``ANYWHERE``, where scenes are
    dealt by their object; there a query goes to the buckets of the objects that match its text.
    """
    sb, qb = Box.named(), Box.named(QUERY_BOX)
    total = scenes.agg(F.count("*").alias("n"), F.count_if(sb.known()).alias("known")).first()
    asked = queries.agg(F.count("*").alias("n"), F.count_if(qb.known()).alias("known")).first()
    rows = max(1, min(rows_per_task, max(LEAST_ROWS, total["n"] // 16)))
    sizes = ((scenes, sb, "scene_id", total["known"]), (queries, qb, "query_id", asked["known"]))
    parts = [sample_boxes(df, box, key, n) if asked["known"] else np.empty((0, 4)) for df, box, key, n in sizes]
    tiles = Tiles(*parts, (total["known"] / max(len(parts[0]), 1), asked["known"] / max(len(parts[1]), 1)), rows)
    scenes = scenes.withColumn("__object", F.lower("object"))
    queries = queries.withColumn("__wanted", F.lower("query_object")).withColumn("__tile", tiles.home(qb) if len(tiles.reach) else F.lit(None).cast("int"))
    roaming = queries.filter(F.col("__tile").isNull())
    lost = queries.agg(F.count_if(F.col("__tile").isNull())).first()[0]
    spot = lambda place, bucket: F.struct(place.alias("__place"), bucket.cast("int").alias("__bucket"))
    bucket = lambda text: F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")

    spots = []
    if len(tiles.reach):
        spots.append(F.transform(tiles.touched(sb), lambda t: spot(t, F.lit(0))))
    if lost:
        spots.append(F.array(spot(F.lit(ANYWHERE), F.when(F.col("__object").isNull(), BUCKETS).otherwise(bucket(F.col("__object"))))))
    none = F.array().cast("array<struct<__place:int,__bucket:int>>")
    left = scenes.withColumn("__s", F.explode(F.concat(none, *spots))).select(*scenes.columns, "__s.*")

    found = _matching_objects(scenes, roaming).select("__wanted", bucket(F.substring("__o", 4, 2**31 - 1)).alias("b"))
    found = found.groupBy("__wanted").agg(F.collect_set("b").alias("__b"))
    every = F.sequence(F.lit(0), F.lit(BUCKETS))
    visits = F.when(F.length("__wanted") > 0, F.coalesce("__b", F.array().cast("array<int>"))).otherwise(every)
    roaming = roaming.join(found, "__wanted", "left").withColumn("__bucket", F.explode(visits)).withColumn("__place", F.lit(ANYWHERE))
    names = [*(c for c in queries.columns if c != "__tile"), "__place", "__bucket"]
    settled = queries.filter(F.col("__tile").isNotNull()).withColumns({"__place": F.col("__tile"), "__bucket": F.lit(0)})
    return left, settled.select(*names).unionByName(roaming.select(*names)), rows


def scene_candidates(
    scenes: DataFrame, queries: DataFrame, period_days: int = 365, max_cells: int = 64, rows_per_task: int = 2_000_000, cells: Cells | None = None
) -> DataFrame:
    """Scenes × queries that share a place, a period and an object (``keyed_sides``), each pair once; the filters are not applied yet."""
    sb, qb = Box.named(), Box.named(QUERY_BOX)
    left, right = keyed_sides(scenes, queries, period_days, max_cells, cells)
    met = gridded_join(left, right, ["__place", "__p", "__o"], ("scene_id", "query_id"), rows_per_task)
    shared = geo.intersection(sb, qb)
    x, y, spot = shared.min_lon, shared.min_lat, F.col("__spot")
    own = (x >= spot["x0"]) & (x < spot["x1"]) & (y >= spot["y0"]) & (y < spot["y1"])
    return met.filter((F.col("__place") < 0) | own).drop("__place", "__p", "__o", "__spot")


def query_scene_join(
    scenes: DataFrame,
    queries: DataFrame,
    period_days: int = 365,
    max_cells: int = 64,
    rows_per_task: int = 2_000_000,
    end_inclusive_day: bool = False,
) -> DataFrame:
    """All (query, scene) pairs that pass the box, date, sensor and object filters.

    ``queries``: ``query_id, q_min_lon … q_max_lat, start_date, end_date,
    sensors array<string>, query_object`` (all but the id may be null).
    Candidates meet in one equi-join (``scene_candidates``) and are then checked on all four filters. Spark broadcasts
    a side when its measured size allows and shuffles otherwise; keys that are hot on either side are spread.
    """
    columns = [*queries.columns, *scenes.columns]
    has, wanted = F.col("__object"), F.col("__wanted")
    fuzzy = wanted.isNull() | (has.isNotNull() & (F.contains(has, wanted) | F.contains(wanted, has)))
    met = scene_candidates(scenes, queries, period_days, max_cells, rows_per_task)
    return met.filter(
        matches_box(Box.named(), Box.named(QUERY_BOX))
        & matches_dates(F.col("acquisition_time"), F.col("start_date"), F.col("end_date"), end_inclusive_day)
        & matches_sensor(F.col("sensor"), F.col("sensors"))
        & fuzzy
    ).select(*columns)


def within_km(
    left: DataFrame, right: DataFrame, km: float, left_point: tuple[str, str], right_point: tuple[str, str], ids: tuple[str, str],
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """All pairs of rows whose points (longitude, latitude) are at most ``km`` apart on the sphere, with ``km_apart``.

    Points are put on the unit sphere, where ``km`` is a chord, and into cubes as wide as that chord. A point meets those
    of its own cube and of the 26 around it. So poles and the 180th meridian are places like any other, and cells
    do not narrow with the latitude. Rows without a point, or with one that is no number, meet nothing. Cubes that are
    crowded are cut on both sides.
    """
    half = min(km / geo.EARTH_RADIUS_KM / 2, math.pi / 2)
    chord = max(2 * math.sin(half), 1e-9) * (1 + 1e-9) + 1e-12

    def cubes(df: DataFrame, point: tuple[str, str]) -> tuple[DataFrame, list[Column]]:
        lon, lat = (F.radians(F.col(c).cast("double")) for c in point)
        usable = F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) < 1e6) & (F.abs(lat) < 1e6), F.lit(False))
        xyz = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
        return df.filter(usable), [F.floor(c / chord).cast("int") for c in xyz]

    one, at = cubes(left, left_point)
    other, place = cubes(right, right_point)
    one = one.withColumns({f"__{n}": c for n, c in zip("xyz", at)})
    for n, c in zip("xyz", place):
        other = other.withColumn(f"__{n}", F.explode(F.array(*[c + d for d in (-1, 0, 1)])))
    # a point is 27 rows of ``other``; broadcast by the estimate of one they would all pass through the driver
    met = gridded_join(one, other, ["__x", "__y", "__z"], ids, rows_per_task, shuffled=True).drop("__x", "__y", "__z")
    met = met.withColumn("km_apart", geo.haversine_km(*[F.col(c) for c in (*left_point, *right_point)]))
    return met.filter(F.col("km_apart") <= km)


def optical_sar_interval_join(
    scenes: DataFrame, area: str, days: int = 3, prefer: str = "earliest"
) -> DataFrame:
    """Each radar scene with one optical scene of its area within ±``days`` days.

    Optical scenes are first reduced to one per (area, day), the largest id,
    and each is offered to the days around it; the best offer per (area, day)
    is settled on that reduced table. The radar side, usually large, then
    needs a single many-to-one join.
    """
    day = F.to_date("acquisition_time")
    optical = (
        scenes.filter(F.col("modality").isin("optical", "multispectral") & F.col("acquisition_time").isNotNull())
        .groupBy(F.col(area).alias("__area"), day.alias("optical_date"))
        .agg(F.max("scene_id").alias("optical_id"))
    )
    offsets = F.array(*[F.lit(i) for i in range(-days, days + 1)])
    offers = optical.select("*", F.explode(offsets).alias("__off")).withColumn(
        "__day", F.date_add("optical_date", F.col("__off"))
    )
    order = F.struct("optical_date") if prefer == "earliest" else F.struct(F.abs("__off"), F.col("optical_date"))
    best = offers.groupBy("__area", "__day").agg(
        F.min_by(F.struct("optical_id", "optical_date"), order).alias("__best")
    )
    radar = scenes.filter((F.col("modality") == "sar") & F.col("acquisition_time").isNotNull()).withColumn("__d", day)
    joined = radar.join(best, (F.col(area) == F.col("__area")) & (F.col("__d") == F.col("__day")))
    return joined.select(
        F.col("scene_id").alias("sar_id"),
        F.col(area).alias(area),
        F.col("__d").alias("sar_date"),
        F.col("__best.optical_id").alias("optical_id"),
        F.col("__best.optical_date").alias("optical_date"),
        F.col("object").alias("object"),
    )


def footprint_overlap_pairs(pairs: DataFrame, bounds: DataFrame, min_share: float = 0.8) -> DataFrame:
    """Check scene pairs: same CRS, enough overlap of the smaller extent, at least one band each.

    ``pairs``: ``id_1, id_2``; ``bounds``: ``scene_id, crs, bands`` and the box.
    """

    def side(n):
        return bounds.select(
            F.col("scene_id").alias(f"id_{n}"),
            F.col("crs").alias(f"crs_{n}"),
            F.col("bands").alias(f"bands_{n}"),
            *[F.col(f).alias(f"b{n}_{f}") for f in Box._fields],
        )

    joined = pairs.join(side(1), "id_1", "left").join(side(2), "id_2", "left")
    b1, b2 = Box.named("b1_"), Box.named("b2_")
    smaller = F.least(b1.area(), b2.area())
    share = F.when(smaller > 0, F.try_divide(geo.intersection_area(b1, b2), smaller))
    reason = (
        F.when(F.col("crs_1").isNull() | F.col("crs_2").isNull(), "Unreadable file")
        .when(
            F.col("crs_1") != F.col("crs_2"),
            F.concat(F.lit("CRS mismatch: "), F.col("crs_1"), F.lit(" vs "), F.col("crs_2")),
        )
        .when(
            share < min_share,
            F.format_string("Footprint overlap %.1f%% < 80%% of smaller extent".replace("80", f"{min_share * 100:.0f}"), share * 100),
        )
        .when((F.col("bands_1") < 1) | (F.col("bands_2") < 1), "One or both images have no bands")
        .otherwise("Compatible")
    )
    return joined.select("id_1", "id_2", share.alias("overlap"), (reason == "Compatible").alias("compatible"), reason.alias("reason"))


# ---- text joins ------------------------------------------------------------


def substring_pairs(hay: DataFrame, hay_col: str, needle: DataFrame, needle_col: str) -> DataFrame:
    """All (hay, needle) text pairs where the needle occurs in the hay, as an equi-join.

    Each hay text is cut into its substrings of exactly the lengths that occur
    among the needles, and those are joined on equality.
    """
    needles = needle.select(F.col(needle_col).alias("needle")).filter(F.length("needle") > 0).distinct()
    lengths = needles.agg(F.collect_set(F.length("needle"))).scalar()
    hays = hay.select(F.col(hay_col).alias("hay")).filter(F.col("hay").isNotNull()).distinct()
    sized = hays.select("hay", F.explode(lengths).alias("__n")).filter(F.length("hay") >= F.col("__n"))
    starts = F.sequence(F.lit(1), F.length("hay") - F.col("__n") + 1)
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("hay"), i, F.col("__n"))))
    return sized.select("hay", F.explode(parts).alias("needle")).join(needles, "needle")


def gazetteer_column(places: list[tuple]) -> Column:
    """The gazetteer as one array literal, in order."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("place"),
                *[F.lit(float(v)).alias(n) for n, v in zip(Box._fields, box)],
            )
            for name, *box in places
        ]
    )


def geocode(location: Column, places: list[tuple] | None = None) -> Column:
    """Place struct of a location text: exact name first, else the first place that contains it or is contained."""
    text = F.lower(F.trim(location))
    table = gazetteer_column(places or fv.GAZETTEER)
    exact = F.get(F.filter(table, lambda g: g["place"] == text), F.lit(0))
    partial = F.get(
        F.filter(table, lambda g: F.contains(text, g["place"]) | F.contains(g["place"], text)), F.lit(0)
    )
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(exact, partial))


def _attach_place(df: DataFrame, hit: DataFrame, location: str) -> DataFrame:
    joined = df.join(hit, F.lower(F.trim(F.col(location))) == hit["__loc"], "left").drop("__loc")
    return joined


def geocode_join(df: DataFrame, location: str = "location", gazetteer: DataFrame | None = None) -> DataFrame:
    """Add ``place`` and its ``p_`` box to every row; null when the place is unknown.

    The built-in gazetteer is a few dozen fixed rows and is searched in place,
    without a join. A gazetteer table (``ordinal, place`` and a box) of any
    size is matched on the distinct location texts with equi-joins.
    """
    names = ["place", *Box._fields]
    if gazetteer is None:
        found = df.withColumn("__g", geocode(F.col(location)))
        return found.select(
            *df.columns, F.col("__g.place").alias("place"), *[F.col(f"__g.{n}").alias("p_" + n) for n in Box._fields]
        )
    places = gazetteer.select("ordinal", F.lower("place").alias("place"), *Box._fields)
    texts = df.select(F.lower(F.trim(F.col(location))).alias("__loc")).filter(F.col("__loc") != "").distinct()
    inside = substring_pairs(texts, "__loc", places, "place").select(
        F.col("hay").alias("__loc"), F.col("needle").alias("place")
    )
    around = substring_pairs(places, "place", texts, "__loc").select(
        F.col("needle").alias("__loc"), F.col("hay").alias("place")
    )
    matches = inside.unionByName(around).join(places, "place")
    order = F.struct(F.col("place") != F.col("__loc"), F.col("ordinal"))
    best = matches.groupBy("__loc").agg(F.min_by(F.struct(*names), order).alias("__g"))
    hit = best.select(
        "__loc", F.col("__g.place").alias("place"), *[F.col(f"__g.{n}").alias("p_" + n) for n in Box._fields]
    )
    return _attach_place(df, hit, location)


def land_cover_of(lon: Column, lat: Column, boxes: list[tuple], rules: bool) -> Column:
    out = None
    for _, x0, y0, x1, y1, label in boxes:
        inside = lon.between(x0, x1) & lat.between(y0, y1)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    if rules:
        out = out.when((lat > 28) & (lon > 75) & (lon < 78), "agriculture").when(lat < 10, "forest")
    return out.otherwise("mixed")


def point_in_box_label(scenes: DataFrame, boxes: list[tuple] | None = None, sar: bool = False) -> DataFrame:
    """Land cover of the scene centre: first box that holds it, then latitude rules, else ``mixed``."""
    lon, lat = Box.named().centre()
    if boxes is None:
        boxes = fv.SAR_LAND_COVER_BOXES if sar else fv.LAND_COVER_BOXES
    return scenes.withColumn("land_cover", land_cover_of(lon, lat, boxes, rules=not sar))


def label_left_join(files: DataFrame, labels: DataFrame, key: str, label: str, default: str = "unknown") -> DataFrame:
    return files.join(labels.select(key, label), key, "left").withColumn(
        label, F.coalesce(F.col(label), F.lit(default))
    )


def label_map_join(
    df: DataFrame, column: str, mapping: dict[str, str] | DataFrame | None = None, target: str = "label"
) -> DataFrame:
    """Fine class to coarse class; a class without a mapping passes through.

    A dict is inlined as a map literal; a table (``fine, coarse``) is joined.
    """
    if mapping is None:
        mapping = fv.LAND_COVER_CLASSES
    if isinstance(mapping, dict):
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return df.withColumn(target, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
    pairs = mapping.select(F.col("fine").alias("__fine"), F.col("coarse").alias("__coarse"))
    joined = df.join(pairs, F.col(column) == F.col("__fine"), "left")
    return joined.withColumn(target, F.coalesce("__coarse", F.col(column))).drop("__fine", "__coarse")


def patch_name_match(meta: DataFrame, name: str, directories: DataFrame, directory: str) -> DataFrame:
    """Metadata rows with the first directory (by name) whose name contains theirs."""
    pairs = substring_pairs(directories, directory, meta, name)
    first = pairs.groupBy("needle").agg(F.min("hay").alias(directory))
    return meta.join(first, F.col(name) == F.col("needle")).drop("needle")
