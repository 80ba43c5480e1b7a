"""Pixel arithmetic: spectral indices, radar decibels, log-ratios, map scaling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOG_EPSILON = 1e-7  # fixed value: power floor and log-ratio epsilon
FEATURE_EPSILON = 1e-10  # fixed value: power floor of the per-scene radar features


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); a zero denominator gives 0."""
    a, b = a.cast("double"), b.cast("double")
    total = a + b
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(a - b, total))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def to_db(power: Column, eps: float = LOG_EPSILON) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(power.cast("double"), F.lit(eps)))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def sar_log_ratio(before: Column, after: Column, eps: float = LOG_EPSILON) -> Column:
    """log10((after + eps) / (before + eps)) of non-negative intensities. The unit is log10, not dB."""
    zero = F.lit(0.0)
    b = F.when(before.isNotNull(), F.greatest(before.cast("double"), zero))
    a = F.when(after.isNotNull(), F.greatest(after.cast("double"), zero))
    return F.log10((a + eps) / (b + eps))


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def change_map_abs(delta: Column) -> Column:
    """|delta| / 2 held in [0, 1]: an index delta cannot exceed 2."""
    return clamp01(F.abs(delta) / 2.0)


def rescale(x: Column, low: Column, high: Column, flat: float, min_span: float) -> Column:
    """(x - low) / (high - low); a span below ``min_span`` gives ``flat``."""
    span = high - low
    return F.when(x.isNull(), None).when(span < min_span, F.lit(flat)).otherwise(F.try_divide(x - low, span))


def pseudo_rgb(vv_db: Column, vh_db: Column) -> Column:
    """Radar colour composite: VV, VH and the ratio shifted by 10 dB."""
    return F.struct(vv_db.alias("r"), vh_db.alias("g"), (vv_db - vh_db + 10.0).alias("b"))


def change_score(mean_abs_ndvi: Column, mean_abs_ndwi: Column, mean_abs_sar: Column) -> Column:
    """Score in [0, 1] from the mean absolute deltas that are present, null when none is."""
    v, w, s = (clamp01(c / 2.0) for c in (mean_abs_ndvi, mean_abs_ndwi, mean_abs_sar))
    optical = F.coalesce(v * 0.5 + w * 0.5, v, w)
    return clamp01(F.coalesce(optical * 0.5 + s * 0.5, optical, s))


def change_score_simple(ndvi_delta: Column, ndwi_delta: Column, sar_ratio: Column) -> Column:
    return (F.abs(ndvi_delta) + F.abs(ndwi_delta) + F.abs(sar_ratio - 1.0)) / 3.0
