"""Ranking scores, confidence bands and report sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .geo import Box, overlap_ratio


def fixed(x: Column, digits: int, pattern: str | None = None) -> Column:
    """Fixed-point text, exact halves to the even digit."""
    return F.format_string(pattern or f"%.{digits}f", F.bround(x.cast("double"), digits))


def score_geo(scene: Box, query: Box) -> Column:
    return F.when(~scene.known() | ~query.known(), F.lit(0.5)).otherwise(overlap_ratio(scene, query))


def score_temporal(when_: Column, start: Column, end: Column) -> Column:
    """1 inside a closed range, falling by 1/365 per whole day before the start, else 0.5."""
    early_days = F.floor((F.unix_timestamp(start) - F.unix_timestamp(when_)) / 86400)
    return (
        F.when(when_.isNull() | (start.isNull() & end.isNull()), F.lit(0.5))
        .when(start.isNotNull() & end.isNotNull() & (when_ >= start) & (when_ <= end), F.lit(1.0))
        .when(start.isNotNull() & (when_ < start), F.greatest(F.lit(0.0), F.lit(1.0) - early_days / 365.0))
        .otherwise(F.lit(0.5))
    )


def score_modality(sensor: Column, query_sensors: Column, cloud: Column, cloud_max: Column) -> Column:
    miss = query_sensors.isNotNull() & sensor.isNotNull() & ~F.array_contains(query_sensors, sensor)
    base = F.when(miss, F.lit(0.3)).otherwise(F.lit(1.0))
    cloudy = F.coalesce(cloud > cloud_max, F.lit(False))
    return base * F.when(cloudy, F.lit(0.5)).otherwise(F.lit(1.0))


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if abs(total - 1.0) > 0.01:
        raise ValueError(f"weights must sum to 1, got {total}")
    return weights


def score_composite(
    geo: Column,
    temporal: Column,
    semantic: Column,
    modality: Column,
    change_flag: Column | None = None,
    weights: dict[str, float] | None = None,
) -> Column:
    def blend(w):
        return geo * w["geo"] + temporal * w["temporal"] + semantic * w["semantic"] + modality * w["modality"]

    plain = blend(check_weights(weights or fv.SCORE_WEIGHTS))
    if change_flag is None:
        return plain
    return F.when(F.coalesce(change_flag, F.lit(False)), blend(fv.CHANGE_SCORE_WEIGHTS)).otherwise(plain)


def confidence(
    used_fallback: Column,
    trace_fallback: Column,
    single_observation: Column,
    cloud: Column,
    registered: Column,
    disagreement: Column | None = None,
    severity: Column | None = None,
) -> Column:
    """``struct<band, reason>`` of a result row."""
    said = fv.CONFIDENCE_TEXTS
    none = F.lit(None).cast("string")
    no = F.lit(False)
    disagreement = no if disagreement is None else F.coalesce(disagreement, no)
    severity = F.lit("minor") if severity is None else F.coalesce(severity, F.lit("minor"))
    low = F.concat_ws(
        "; ",
        F.when(F.coalesce(used_fallback, no), said["parser_fallback"]).otherwise(none),
        F.when(F.coalesce(trace_fallback, no), said["model_fallback"]).otherwise(none),
    )
    medium = F.concat_ws(
        "; ",
        F.when(F.coalesce(single_observation, no), said["single"]).otherwise(none),
        F.when(cloud > 30, fixed(cloud, 0, said["cloud"])).otherwise(none),
        F.when(~registered, said["registration"]).otherwise(none),
        F.when(disagreement, said["disagreement"]).otherwise(none),
    )
    major = disagreement & (severity == "major")

    def verdict(band, reason):
        return F.struct(F.lit(band).alias("band"), reason.alias("reason"))

    return (
        F.when(low != "", verdict("low", F.concat(F.lit(said["low"]), low)))
        .when(major, verdict("low", F.lit(said["major"])))
        .when(medium != "", verdict("medium", F.concat(F.lit(said["medium"]), medium)))
        .otherwise(verdict("high", F.lit(said["high"])))
    )


def observation_age(acquired: Column, as_of: Column) -> Column:
    """Whole days between the acquisition and a given moment."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(acquired)) / 86400)


def _mentions(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def _percent(x: Column) -> Column:
    return fixed(x.cast("double") * 100.0, 1, "%.1f%%")


def cross_check(text: Column, water: Column, builtup: Column) -> Column:
    """``struct<disagreement, severity, details>``: model text against measured radar fractions."""
    none = F.lit(None).cast("string")
    says_water, says_built = _mentions(text, fv.WATER_WORDS), _mentions(text, fv.BUILTUP_WORDS)
    is_water, is_built = water > 0.2, builtup > 0.15
    water_note = (
        F.when(
            is_water & ~says_water,
            F.concat(F.lit("Deterministic shows water ("), _percent(water), F.lit(") but model doesn't mention water")),
        )
        .when(
            ~is_water & says_water,
            F.concat(
                F.lit("Model mentions water but deterministic shows minimal water ("), _percent(water), F.lit(")")
            ),
        )
        .otherwise(none)
    )
    built_note = (
        F.when(
            is_built & ~says_built,
            F.concat(
                F.lit("Deterministic shows built-up ("), _percent(builtup), F.lit(") but model doesn't mention structures")
            ),
        )
        .when(
            ~is_built & says_built,
            F.concat(
                F.lit("Model mentions built-up but deterministic shows minimal built-up ("),
                _percent(builtup),
                F.lit(")"),
            ),
        )
        .otherwise(none)
    )
    details = F.concat_ws("; ", water_note, built_note)
    missed = (is_water & ~says_water) | (is_built & ~says_built)
    return F.struct(
        (details != "").alias("disagreement"),
        F.when(missed, "major").otherwise("minor").alias("severity"),
        F.when(details != "", details).otherwise("No significant disagreement").alias("details"),
    )


def change_magnitude(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return (
        F.when(s < 0.05, "no significant observed temporal change")
        .when(s < 0.30, "minor observed temporal change")
        .when(s < 0.70, "moderate observed temporal change")
        .otherwise("significant observed temporal change")
    )


def change_from_fraction(fraction: Column, threshold: float) -> Column:
    """Sentence from the changed share of the area, in the bands of ``fv.FRACTION_BANDS``."""
    share = fixed(fraction.cast("double") * 100.0, 1, "%.1f%%")
    out = F.when(fraction.isNull(), F.lit(None).cast("string"))
    for least, word in fv.FRACTION_BANDS:
        before, after = fv.FRACTION_TEXT.format(word=word, share="\n", threshold=threshold).split("\n")
        out = out.when(fraction > least, F.concat(F.lit(before), share, F.lit(after)))
    return out.otherwise(F.lit(fv.FRACTION_NONE))


def _trend(mean: Column, what: str, unit: str) -> Column:
    mean = F.round(mean, 9)  # a mean that is zero up to rounding has no sign
    signed = F.concat(F.when(mean < 0, "-").otherwise("+"), fixed(F.abs(mean), 2))
    word = F.when(mean > 0.05, "increase in ").when(mean < -0.05, "decrease in ").otherwise("stable ")
    return F.when(mean.isNotNull(), F.concat(word, F.lit(f"{what} ({unit} delta: "), signed, F.lit(")")))


def _variation(mean_abs: Column, moving: str, unit: str, still: str) -> Column:
    held = fixed(mean_abs, 2, f"observed {moving} variation ({unit} abs delta: %.2f)")
    return F.when(mean_abs > 0.05, held).when(mean_abs.isNotNull(), still)


def change_description(
    score: Column,
    mean_ndvi: Column,
    mean_ndwi: Column,
    mean_sar: Column,
    abs_ndvi: Column | None = None,
    abs_ndwi: Column | None = None,
    abs_sar: Column | None = None,
) -> Column:
    """Report sentence from the score and the signed mean deltas, or the absolute ones where those
    are absent; other absent parts are left out."""
    absent = F.lit(None).cast("double")
    abs_ndvi, abs_ndwi, abs_sar = (absent if x is None else x for x in (abs_ndvi, abs_ndwi, abs_sar))
    held = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    head = F.concat(
        F.lit("Bi-temporal analysis indicates "),
        change_magnitude(held),
        fixed(held, 4, " (change score: %.4f)."),
    )
    optical = F.concat_ws(
        ", ",
        F.coalesce(
            _trend(mean_ndvi, "vegetation index", "NDVI"),
            _variation(abs_ndvi, "vegetation index", "NDVI", "stable vegetation index (NDVI)"),
        ),
        F.coalesce(
            _trend(mean_ndwi, "water index", "NDWI"),
            _variation(abs_ndwi, "water index", "NDWI", "stable water index (NDWI)"),
        ),
    )
    radar = F.coalesce(
        _trend(mean_sar, "SAR backscatter intensity", "log-ratio"),
        _variation(abs_sar, "SAR backscatter", "log-ratio", "stable SAR backscatter intensity"),
    )
    none = F.lit(None).cast("string")
    text = F.concat_ws(
        " ",
        head,
        F.when(optical != "", F.concat(F.lit("Sentinel-2 optical metrics show "), optical, F.lit("."))).otherwise(none),
        F.when(radar.isNotNull(), F.concat(F.lit("Sentinel-1 SAR metrics show "), radar, F.lit("."))).otherwise(none),
    )
    empty = F.coalesce(score, mean_ndvi, mean_ndwi, mean_sar, abs_ndvi, abs_ndwi, abs_sar).isNull()
    return F.when(empty, "Insufficient data provided for temporal change description.").otherwise(text)


def fusion_statement(
    optical_caption: Column, sar_caption: Column, water: Column, builtup: Column, log_ratio: Column
) -> Column:
    none = F.lit(None).cast("string")
    measured = F.concat(
        F.lit("[SAR Deterministic] Water cover "),
        _percent(water),
        F.lit(", built-up "),
        _percent(builtup),
        fixed(log_ratio, 2, ", mean log-ratio %.2f."),
    )
    return F.concat_ws(
        " ",
        F.when(F.coalesce(sar_caption, F.lit("")) != "", F.concat(F.lit("[SAR VLM] "), sar_caption)).otherwise(measured),
        F.concat(F.lit("[VLM Optical] "), optical_caption, F.lit(".")),
        F.when(water > 0.3, "SAR confirms significant water presence (low VV backscatter).").otherwise(none),
        F.when(builtup > 0.2, "SAR indicates built-up structures (high VV+VH backscatter).").otherwise(none),
    )


def result_explanation(
    rank: Column, score: Column, sensor: Column, acquired_text: Column, wkt: Column, summary: Column
) -> Column:
    return F.concat(
        F.lit("This result is ranked #"),
        rank.cast("string"),
        fixed(score, 2, " with a composite score of %.2f. "),
        F.lit("The image was acquired by "),
        sensor,
        F.lit(" on "),
        acquired_text,
        F.lit(" over "),
        F.substring(wkt, 1, 30),
        F.lit("... "),
        F.coalesce(summary, F.lit("No additional model outputs available.")),
        F.lit(" These findings are consistent with the query criteria."),
    )
