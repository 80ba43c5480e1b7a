"""Pixel tables: change metrics, radar features, scalings and speckle filters.

A pixel table has one row per pixel: ``pair_id`` or ``scene_id``, ``row``,
``col`` and one double column per band. Metrics are plain aggregates, so Spark
combines them on the map side and one giant scene is not one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import fixed_values as fv
from ..functions import bands
from ..functions.scores import change_description
from .ordered import _match_keys, with_group_stats
from .selection import exact_percentiles

SHAPE_ERROR = "shape mismatch: pixels of t1 and t2 do not align"
MISSING_BANDS = "missing required bands"


def pixel_pair_join(t1: DataFrame, t2: DataFrame, band_names: list[str]) -> DataFrame:
    """Align two epochs on (pair, row, col); ``matched`` is false for a pixel only one epoch has."""
    keys = ["pair_id", "row", "col"]
    left = t1.select(*keys, F.lit(True).alias("__1"), *[F.col(b).alias(f"{b}_t1") for b in band_names])
    right = t2.select(*keys, F.lit(True).alias("__2"), *[F.col(b).alias(f"{b}_t2") for b in band_names])
    joined = left.join(right, keys, "full_outer")
    return joined.withColumn("matched", F.col("__1").isNotNull() & F.col("__2").isNotNull()).drop("__1", "__2")


def pixel_pair_errors(joined: DataFrame) -> DataFrame:
    """One row per pair whose epochs do not have the same pixels."""
    return (
        joined.groupBy("pair_id")
        .agg(F.count("*").alias("pixels"), F.count_if(~F.col("matched")).alias("unmatched"))
        .filter(F.col("unmatched") > 0)
        .withColumn("error", F.lit(SHAPE_ERROR))
    )


def aligned_pixels(joined: DataFrame) -> DataFrame:
    """Pixels of the pairs that align completely; the others are error rows, not partial results."""
    return joined.join(pixel_pair_errors(joined).select("pair_id"), "pair_id", "left_anti").drop("matched")


def _delta_metrics(joined: DataFrame, delta: Column, name: str, threshold: float, needed: list[str]) -> DataFrame:
    """mean, mean absolute and changed fraction of a delta per pair, or an error."""
    absent = F.lit(False)
    for column in needed:
        absent = absent | F.col(column).isNull()
    rows = joined.withColumns({"__d": delta, "__absent": F.col("matched") & absent})
    agg = rows.groupBy("pair_id").agg(
        F.count_if(~F.col("matched")).alias("__unmatched"),
        F.count_if(F.col("__absent")).alias("__missing"),
        F.count("*").alias("n_pixels"),
        F.avg("__d").alias("__mean"),
        F.avg(F.abs("__d")).alias("__abs"),
        F.avg((F.abs("__d") > threshold).cast("double")).alias("__changed"),
        F.stddev_pop("__d").alias("__std"),
    )
    error = F.when(F.col("__unmatched") > 0, SHAPE_ERROR).when(F.col("__missing") > 0, MISSING_BANDS)
    ok = error.isNull()
    return agg.select(
        "pair_id",
        "n_pixels",
        F.when(ok, F.col("__mean")).alias(f"mean_{name}_delta"),
        F.when(ok, F.col("__abs")).alias(f"mean_abs_{name}_delta"),
        F.when(ok, F.col("__std")).alias(f"std_{name}_delta"),
        F.when(ok, F.col("__changed")).alias(f"{name}_changed_fraction"),
        error.alias("error"),
    )


def ndvi_delta() -> Column:
    return bands.ndvi(F.col("nir_t2"), F.col("red_t2")) - bands.ndvi(F.col("nir_t1"), F.col("red_t1"))


def ndwi_delta() -> Column:
    return bands.ndwi(F.col("green_t2"), F.col("nir_t2")) - bands.ndwi(F.col("green_t1"), F.col("nir_t1"))


def ndvi_change(joined: DataFrame, threshold: float = fv.NDVI_CHANGE_THRESHOLD) -> DataFrame:
    out = _delta_metrics(joined, ndvi_delta(), "ndvi", threshold, ["nir_t1", "nir_t2", "red_t1", "red_t2"])
    return out.drop("std_ndvi_delta")


def ndwi_change(joined: DataFrame, threshold: float = fv.NDVI_CHANGE_THRESHOLD) -> DataFrame:
    """Water-index metrics; ``has_ndwi`` is false (and the metrics null) when a green band is missing."""
    out = _delta_metrics(joined, ndwi_delta(), "ndwi", threshold, ["nir_t1", "nir_t2", "green_t1", "green_t2"])
    missing = F.coalesce(F.col("error") == MISSING_BANDS, F.lit(False))
    return out.drop("std_ndwi_delta").withColumns(
        {"has_ndwi": F.col("error").isNull(), "error": F.when(~missing, F.col("error"))}
    )


def sar_log_ratio_change(
    joined: DataFrame, threshold: float = fv.SAR_CHANGE_THRESHOLD, eps: float = bands.LOG_EPSILON
) -> DataFrame:
    """Per pair: mean, spread, mean absolute and changed fraction of the VV log10 ratio."""
    ratio = bands.sar_log_ratio(F.col("vv_t1"), F.col("vv_t2"), eps)
    return _delta_metrics(joined, ratio, "sar", threshold, ["vv_t1", "vv_t2"])


def change_report(joined: DataFrame) -> DataFrame:
    """Signed and absolute mean deltas, change score and report sentence of every pair, in one aggregate."""
    sar = bands.sar_log_ratio(F.col("vv_t1"), F.col("vv_t2"))
    rows = joined.withColumns({"__v": ndvi_delta(), "__w": ndwi_delta(), "__s": sar})

    def whole(name):
        """A mean over the pair, only if every pixel has a value."""
        return F.count(name) == F.count("*")

    def mean(expr, name):
        return F.when(whole(name), F.avg(expr))

    agg = rows.groupBy("pair_id").agg(
        F.count_if(~F.col("matched")).alias("__unmatched"),
        mean(F.col("__v"), "__v").alias("mean_ndvi_delta"),
        mean(F.abs("__v"), "__v").alias("mean_abs_ndvi_delta"),
        mean(F.col("__w"), "__w").alias("mean_ndwi_delta"),
        mean(F.abs("__w"), "__w").alias("mean_abs_ndwi_delta"),
        mean(F.col("__s"), "__s").alias("mean_sar_delta"),
        mean(F.abs("__s"), "__s").alias("mean_abs_sar_delta"),
    )
    metrics = [c for c in agg.columns if c.startswith("mean_")]
    good = F.col("__unmatched") == 0
    agg = agg.select(
        "pair_id",
        *[F.when(good, F.col(c)).alias(c) for c in metrics],
        F.when(~good, SHAPE_ERROR).alias("error"),
    )
    scored = agg.withColumn(
        "change_score",
        bands.change_score(F.col("mean_abs_ndvi_delta"), F.col("mean_abs_ndwi_delta"), F.col("mean_abs_sar_delta")),
    )
    return scored.withColumn(
        "change_description",
        change_description(
            *map(F.col, ("change_score", "mean_ndvi_delta", "mean_ndwi_delta", "mean_sar_delta")),
            *map(F.col, ("mean_abs_ndvi_delta", "mean_abs_ndwi_delta", "mean_abs_sar_delta")),
        ),
    )


def change_score(joined: DataFrame) -> DataFrame:
    return change_report(joined).select("pair_id", "change_score", "error")


def change_score_simple(joined: DataFrame) -> DataFrame:
    """(|mean NDVI delta| + |mean NDWI delta| + |VV power ratio - 1|) / 3 per pair."""
    rows = joined.withColumns({"__v": ndvi_delta(), "__w": ndwi_delta()})
    agg = rows.groupBy("pair_id").agg(
        F.count_if(~F.col("matched")).alias("__unmatched"),
        F.avg("__v").alias("__v"),
        F.avg("__w").alias("__w"),
        F.avg("vv_t1").alias("__1"),
        F.avg("vv_t2").alias("__2"),
    )
    ratio = F.when(F.col("__1") == 0, F.lit(None).cast("double")).otherwise(F.try_divide("__2", "__1"))
    score = bands.change_score_simple(F.col("__v"), F.col("__w"), ratio)
    return agg.select("pair_id", F.when(F.col("__unmatched") == 0, score).alias("change_score_simple"))


def sar_features(pixels: DataFrame, reference: DataFrame | None = None, key: str = "scene_id") -> DataFrame:
    """Water and built-up fraction, mean decibels and mean log-ratio per radar scene.

    A missing VH band is replaced by VV. Without a reference scene the
    log-ratio is the mean of (x - mean x), which is 0 up to rounding.
    """
    vv = bands.to_db(F.col("vv"), bands.FEATURE_EPSILON)
    vh = bands.to_db(F.coalesce("vh", "vv"), bands.FEATURE_EPSILON)
    rows = pixels.filter(F.col("vv").isNotNull()).withColumns({"__vv": vv, "__vh": vh})
    if reference is not None:
        ref = reference.select(
            key, "row", "col", bands.to_db(F.col("vv"), bands.FEATURE_EPSILON).alias("__ref")
        )
        rows = rows.join(ref, [key, "row", "col"], "left").withColumn("__ratio", F.col("__vv") - F.col("__ref"))
    else:
        rows = rows.withColumn("__ratio", F.lit(None).cast("double"))
    built = (F.col("__vv") > fv.BUILTUP_MIN_VV_DB) & (F.col("__vh") > fv.BUILTUP_MIN_VH_DB)
    return rows.groupBy(key).agg(
        F.avg((F.col("__vv") < fv.WATER_MAX_VV_DB).cast("double")).alias("water_fraction"),
        F.avg(built.cast("double")).alias("builtup_fraction"),
        F.avg("__vv").alias("mean_vv_db"),
        F.avg("__vh").alias("mean_vh_db"),
        F.coalesce(F.avg("__ratio"), F.lit(0.0)).alias("log_ratio_mean"),
        F.bool_or(F.col("vh").isNull()).alias("vh_copied"),
    )


# ---- scalings --------------------------------------------------------------


def change_map_minmax(maps: DataFrame, key: str, value: str) -> DataFrame:
    """Min-max scaling per map; a flat map becomes 0.5."""
    stats = with_group_stats(maps, [key], [F.min(value).alias("__lo"), F.max(value).alias("__hi")])
    scaled = bands.rescale(F.col(value), F.col("__lo"), F.col("__hi"), 0.5, 1e-9)
    return stats.withColumn("normalized", scaled).drop("__lo", "__hi")


def change_map_abs(maps: DataFrame, value: str) -> DataFrame:
    return maps.withColumn("normalized", bands.change_map_abs(F.col(value)))


def unpivot_bands(pixels: DataFrame, ids: list[str], band_names: list[str]) -> DataFrame:
    """One row per (pixel, band)."""
    return pixels.unpivot(ids, band_names, "band", "value")


def band_normalize_sigma(long: DataFrame, keys: list[str]) -> DataFrame:
    """Clip to mean ± 2 population sigma per (scene, band) and rescale to 0–1; a flat band becomes 0."""
    stats = with_group_stats(long, keys, [F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")])
    lo, hi = F.col("__m") - 2 * F.col("__s"), F.col("__m") + 2 * F.col("__s")
    held = F.least(F.greatest(F.col("value"), lo), hi)
    scaled = F.when(hi > lo, F.try_divide(held - lo, hi - lo)).otherwise(F.lit(0.0))
    return stats.withColumn("normalized", bands.clamp01(scaled)).drop("__m", "__s")


def band_minmax(long: DataFrame, keys: list[str]) -> DataFrame:
    stats = with_group_stats(long, keys, [F.min("value").alias("__lo"), F.max("value").alias("__hi")])
    span = F.col("__hi") - F.col("__lo")
    scaled = F.when(span > 0, F.try_divide(F.col("value") - F.col("__lo"), span)).otherwise(F.lit(0.0))
    return stats.withColumn("normalized", scaled).drop("__lo", "__hi")


def band_stretch_percentile(
    long: DataFrame, keys: list[str], percentile: float = 99.5, exact: bool = True
) -> DataFrame:
    """Clip to the (100 - p, p) percentiles of the finite values, scale to 0–255, cut to whole numbers (at nine places, so that a last bit does not decide)."""
    probs = [(100 - percentile) / 100.0, percentile / 100.0]
    v = F.col("value")
    infinite = F.isnan(v) | (F.abs(v) == float("inf"))
    finite = long.withColumn("value", F.when(~infinite, v))
    if exact:
        cuts = exact_percentiles(finite, keys, "value", probs)
        limits = cuts.groupBy(*keys).agg(
            F.min("percentile").alias("__lo"), F.max("percentile").alias("__hi")
        )
    else:
        approx = F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), F.lit(10000))
        limits = finite.groupBy(*keys).agg(approx.alias("__a")).select(
            *keys, F.get("__a", F.lit(0)).alias("__lo"), F.get("__a", F.lit(1)).alias("__hi")
        )
    rows = _match_keys(long, limits, keys)
    hi = F.when(F.col("__hi") - F.col("__lo") < 1e-6, F.col("__lo") + 1.0).otherwise(F.col("__hi"))
    held = F.least(F.greatest(v, F.col("__lo")), hi)
    level = F.floor(F.round((held - F.col("__lo")) / (hi - F.col("__lo")) * 255.0, 9)).cast("int")
    return rows.withColumn("level", level).drop("__lo", "__hi")


def pseudo_rgb(pixels: DataFrame, ids: list[str]) -> DataFrame:
    """Radar colour composite of linear VV and VH power, one double column per colour."""
    rgb = bands.pseudo_rgb(bands.to_db(F.col("vv")), bands.to_db(F.col("vh")))
    return pixels.select(*ids, rgb.alias("__c")).select(*ids, "__c.r", "__c.g", "__c.b")


def band_order(long: DataFrame, key: str = "scene_id") -> DataFrame:
    """Bands of a scene by mean intensity, brightest first; of two bands the brighter is VV."""
    means = long.groupBy(key, "band").agg(F.avg("value").alias("mean_intensity"))
    per_scene = W.partitionBy(key)  # a scene has a handful of bands
    ranked = means.withColumns(
        {
            "brightness_rank": F.row_number().over(per_scene.orderBy(F.desc("mean_intensity"), F.asc("band"))),
            "n_bands": F.count("*").over(per_scene),
        }
    )
    r, n = F.col("brightness_rank"), F.col("n_bands")
    role = F.when((n == 2) & (r == 1), "VV").when((n == 2) & (r == 2), "VH")
    return ranked.withColumn("role", role)


# ---- stencils --------------------------------------------------------------


#: Side of a tile in pixels.
TILE = 128


def _box_sums(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums over ``size`` neighbours along an axis. Added one by one, so that a value that is no number stays where it is."""
    n = a.shape[axis] - size + 1
    take = lambda k: a[:, k : k + n] if axis else a[k : k + n]
    total = take(0).copy()
    for k in range(1, size):
        total += take(k)
    return total


def tile_means(
    row: np.ndarray, col: np.ndarray, values: np.ma.MaskedArray, extent: tuple[int, ...], corner: tuple[int, int], half: int, side: int = TILE
) -> tuple[list[np.ndarray], np.ndarray]:
    """Local means of a value and of its square for the pixels of one tile, from the pixels in and around it.

    The tile begins at ``corner`` and the scene reaches from ``extent[0], extent[1]`` to ``extent[2], extent[3]``.
    Gives both means for every place of the tile, and where there is one.
    """
    size = 2 * half + 1
    low = [max(c - half, e) for c, e in zip(corner, extent[:2])]
    high = [min(c + side - 1 + half, e) for c, e in zip(corner, extent[2:])]
    shape = tuple(h - l + 1 for l, h in zip(low, high))
    at = (row - low[0], col - low[1])
    known = ~np.ma.getmaskarray(values)
    dense = np.zeros((4, *shape))  # pixels, known ones, their sum and the sum of squares
    plain = np.ma.getdata(values)
    np.add.at(dense[0], at, 1)
    for k, part in enumerate((np.ones(known.sum()), plain[known], plain[known] ** 2), 1):
        np.add.at(dense[k], (at[0][known], at[1][known]), part)
    # places beyond the scene are mirrored; places beyond the halo of the tile are not looked at
    picks = []
    for axis in (0, 1):
        first, last = corner[axis] - half, min(corner[axis] + side - 1, extent[axis + 2]) + half
        n = extent[axis + 2] - extent[axis] + 1
        whole = np.arange(first, last + 1) - extent[axis]
        whole = np.where((whole < 0) | (whole >= n), whole % (2 * n), whole)
        picks.append(np.where(whole < n, whole, 2 * n - 1 - whole) + extent[axis] - low[axis])
    inside = [(p >= 0) & (p < shape[k]) for k, p in enumerate(picks)]
    safe = [np.clip(p, 0, shape[k] - 1) for k, p in enumerate(picks)]
    dense = dense[:, safe[0]][:, :, safe[1]] * (inside[0][:, None] & inside[1][None, :])
    pixels, count, total, squares = (dense[0][:, half : dense.shape[2] - half], *(_box_sums(d, size, 1) for d in dense[1:]))
    weight = np.where(count > 0, pixels, 0.0)
    share = np.maximum(count, 1)
    means = [np.where(weight > 0, weight * (x / share), 0.0) for x in (total, squares)]
    held = _box_sums(weight, size, 0)
    return [np.where(held > 0, _box_sums(m, size, 0) / np.maximum(held, 1), np.nan) for m in means], held > 0


def box_filter_mean_var(pixels: DataFrame, keys: list[str], value: str = "value", window: int = 5) -> DataFrame:
    """Local mean and variance in a window × window box with mirrored edges (an even window grows by one).

    The box is separable: means along each image row, then along each image
    column, of the pixels that are there; the box is set by positions, and edges are
    the scene's. Scenes are cut into square tiles. A pixel goes to its tile and, near its border, to the neighbours whose
    margin it is in, so both axes are done in one task and pixels are shuffled once, however large the scene.
    """
    half = (window + 1 if window % 2 == 0 else window) // 2
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    ends = {"__r0": F.min(r), "__c0": F.min(c), "__r1": F.max(r), "__c1": F.max(c)}
    extents = pixels.groupBy(*keys).agg(*[x.alias(n) for n, x in ends.items()])
    tile = lambda x: F.floor(x / TILE)
    span = lambda a, b: F.explode(F.sequence(tile(a), tile(b)))
    tiles = extents.withColumn("__tr", span(F.col("__r0"), F.col("__r1"))).withColumn("__tc", span(F.col("__c0"), F.col("__c1")))
    offered = pixels.withColumn("__v", F.col(value).cast("double"))
    offered = offered.withColumn("__tr", span(r - half, r + half)).withColumn("__tc", span(c - half, c + half))
    group = [*keys, "__tr", "__tc"]
    schema = StructType([*pixels.schema.fields, StructField("local_mean", DoubleType()), StructField("local_var", DoubleType())])

    names, side = list(pixels.columns), TILE

    def filtered(rows: pa.Table, scene: pa.Table) -> pa.Table:
        if not rows.num_rows or not scene.num_rows:  # a margin without pixels of its own
            none = pa.array([], pa.float64())
            return rows.select(names).slice(0, 0).append_column("local_mean", none).append_column("local_var", none)
        at = [rows[n].cast(pa.int64()).to_numpy() for n in ("row", "col")]
        corner = tuple(int(scene[n][0].as_py()) * side for n in ("__tr", "__tc"))
        extent = tuple(int(scene[n][0].as_py()) for n in ("__r0", "__c0", "__r1", "__c1"))
        mask = rows["__v"].is_null().to_numpy()
        values = np.ma.masked_array(rows["__v"].fill_null(0.0).to_numpy(), mask)
        (mean, square), known = tile_means(*at, values, extent, corner, half, side)
        own = np.flatnonzero((at[0] >= corner[0]) & (at[0] < corner[0] + side) & (at[1] >= corner[1]) & (at[1] < corner[1] + side))
        place = at[0][own] - corner[0], at[1][own] - corner[1]
        out = rows.select(names).take(pa.array(own))
        missing = ~known[place]
        m, v = mean[place], square[place] - mean[place] ** 2
        return out.append_column("local_mean", pa.array(m, mask=missing)).append_column("local_var", pa.array(v, mask=missing))

    met = offered.groupBy(*group).cogroup(tiles.groupBy(*group))
    return met.applyInArrow(filtered, schema)


def lee_filter(pixels: DataFrame, keys: list[str], value: str = "value", window: int = 5) -> DataFrame:
    """Speckle filter in decibels: mean + w (x - mean), w = var / (var + 1/4)."""
    db = pixels.withColumn("__db", bands.to_db(F.col(value)))
    stats = box_filter_mean_var(db, keys, "__db", window)
    mean, var = F.col("local_mean"), F.col("local_var")
    weight = bands.clamp01(F.try_divide(var, var + 0.25))
    filtered = mean + F.coalesce(weight, F.lit(0.0)) * (F.col("__db") - mean)
    return stats.withColumn("filtered", bands.from_db(filtered)).drop("__db", "local_mean", "local_var")


def lee_filter_enhanced(
    pixels: DataFrame, keys: list[str], value: str = "value", window: int = 7, damping: float = 2.0
) -> DataFrame:
    """Three zones by the local coefficient of variation: mean, weighted, unchanged."""
    db = pixels.withColumn("__db", bands.to_db(F.col(value)))
    stats = box_filter_mean_var(db, keys, "__db", window)
    mean, var = F.col("local_mean"), F.greatest(F.col("local_var"), F.lit(0.0))
    noise = F.sqrt(F.lit(0.5))
    cv = F.sqrt(var) / (F.abs(mean) + 1e-10)
    weighted = F.try_divide(cv * cv - noise * noise, cv * cv * (1 + noise * noise))
    weight = F.when(cv < noise, F.lit(0.0)).when(cv < F.sqrt(F.lit(damping)) * noise, weighted).otherwise(F.lit(1.0))
    filtered = mean + weight * (F.col("__db") - mean)
    return stats.withColumn("filtered", bands.from_db(filtered)).drop("__db", "local_mean", "local_var")
