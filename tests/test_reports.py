"""Sentences from absolute deltas, and confidence from registration, trace and cross-check."""

from pyspark.sql import functions as F

from terrafold.functions import scores
from terrafold.operators import retrieval as rt


def test_absolute_deltas(spark):
    rows = [(0.2, None, 0.2, 0.01, 0.3), (None, None, 0.01, 0.2, 0.01), (0.2, 0.1, 0.3, None, None), (None,) * 5]
    df = spark.createDataFrame(rows, "s double, v double, av double, aw double, ar double").coalesce(1)
    none = F.lit(None).cast("double")
    text = scores.change_description(F.col("s"), F.col("v"), none, none, F.col("av"), F.col("aw"), F.col("ar"))
    got = [r[0] for r in df.select(text).collect()]
    assert got[0] == (
        "Bi-temporal analysis indicates minor observed temporal change (change score: 0.2000). Sentinel-2 optical metrics show "
        "observed vegetation index variation (NDVI abs delta: 0.20), stable water index (NDWI). "
        "Sentinel-1 SAR metrics show observed SAR backscatter variation (log-ratio abs delta: 0.30)."
    )
    assert got[1].endswith(
        "stable vegetation index (NDVI), observed water index variation (NDWI abs delta: 0.20). "
        "Sentinel-1 SAR metrics show stable SAR backscatter intensity."
    )
    assert got[2].endswith("show increase in vegetation index (NDVI delta: +0.10).")
    assert got[3] == "Insufficient data provided for temporal change description."


def test_attached_confidence(spark):
    kinds = [(True, False, None), (False, False, None), (None, False, None), (True, True, None), (True, False, "minor"), (True, False, "major")]
    df = spark.createDataFrame(kinds, "g boolean, t boolean, sev string").coalesce(1)
    df = df.selectExpr("*", "'p' AS paired_scene_id", "0D AS cloud_cover", "TIMESTAMP '2001-01-01' AS acquisition_time")
    check = F.struct(F.col("sev").isNotNull().alias("disagreement"), F.coalesce("sev", F.lit("minor")).alias("severity"))
    as_of = F.lit("2002-01-01").cast("timestamp")
    got = rt.attach_confidence(df, as_of, registered=F.col("g"), trace_fallback=F.col("t"), cross_check=check)
    assert [r["confidence_band"] for r in got.collect()] == ["high", "medium", "medium", "low", "medium", "low"]
    assert {r["confidence_band"] for r in rt.attach_confidence(df, as_of).collect()} == {"high"}
