"""Registered queries: pixel pairs, change metrics, radar features, scalings, speckle filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import pixels as px
from .registry import query, r6

BANDS = ["nir", "red", "green", "vv"]
PAIRS = ("pixels_t1", "pixels_t2")


def joined(d):
    return px.pixel_pair_join(d.view("pixels_t1"), d.view("pixels_t2"), BANDS)


ND = "CASE WHEN {a} + {b} = 0 THEN 0e0 ELSE ({a} - {b}) / ({a} + {b}) END"


def nd(a, b):
    return ND.format(a=a, b=b)


J = f"""WITH+ j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col,
    a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AS matched, a.nir AS nir1, a.red AS red1, a.green AS green1, a.vv AS vv1,
    b.nir AS nir2, b.red AS red2, b.green AS green2, b.vv AS vv2 FROM pixels_t1 a FULL JOIN pixels_t2 b ON a.pair_id = b.pair_id AND a.row = b.row AND a.col = b.col),
  p AS (SELECT *, {nd('nir2', 'red2')} - {nd('nir1', 'red1')} AS dv, {nd('green2', 'nir2')} - {nd('green1', 'nir1')} AS dw,
    CASE WHEN matched THEN log10((greatest(vv2, 0) + 1e-7) / (greatest(vv1, 0) + 1e-7)) END AS ds FROM j) """


@query(
    "pixel_pair_join",
    J + "SELECT pair_id, row, col, round(nir1, 6) AS nir_t1, round(nir2, 6) AS nir_t2 FROM j WHERE pair_id NOT IN (SELECT pair_id FROM j WHERE NOT matched)",
    PAIRS,
)
def _(d):
    return px.aligned_pixels(joined(d)).select("pair_id", "row", "col", r6("nir_t1", "nir_t1"), r6("nir_t2", "nir_t2"))


@query(
    "pixel_pair_errors",
    J + "SELECT pair_id, count(*) AS pixels, count_if(NOT matched) AS unmatched FROM j GROUP BY pair_id HAVING count_if(NOT matched) > 0",
    PAIRS,
)
def _(d):
    return px.pixel_pair_errors(joined(d)).select("pair_id", "pixels", "unmatched")


def delta_sql(delta, name, threshold, needed, extra=""):
    absent = " OR ".join(f"{n} IS NULL" for n in needed)
    return (
        J
        + f""", g AS (SELECT pair_id, count(*) AS n_pixels, avg({delta}) AS m, avg(abs({delta})) AS a, stddev_pop({delta}) AS s,
      avg(CASE WHEN abs({delta}) > {threshold} THEN 1e0 WHEN {delta} IS NULL THEN NULL ELSE 0e0 END) AS f,
      CASE WHEN count_if(NOT matched) > 0 THEN 'shape mismatch: pixels of t1 and t2 do not align'
        WHEN count_if(matched AND ({absent})) > 0 THEN 'missing required bands' END AS error FROM p GROUP BY pair_id)
    SELECT pair_id, n_pixels, CASE WHEN error IS NULL THEN round(m, 6) END AS mean_{name}_delta, CASE WHEN error IS NULL THEN round(a, 6) END AS mean_abs_{name}_delta,
      CASE WHEN error IS NULL THEN round(f, 6) END AS {name}_changed_fraction, {extra} FROM g"""
    )


def rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("ndvi_change", delta_sql("dv", "ndvi", 0.5, ["nir1", "nir2", "red1", "red2"], "error"), PAIRS)
def _(d):
    return rounded(px.ndvi_change(joined(d)), ["mean_ndvi_delta", "mean_abs_ndvi_delta", "ndvi_changed_fraction"])


@query(
    "ndwi_change",
    delta_sql(
        "dw", "ndwi", 0.5, ["nir1", "nir2", "green1", "green2"],
        "error IS NULL AS has_ndwi, CASE WHEN error LIKE 'shape%' THEN error END AS error",
    ),
    PAIRS,
)
def _(d):
    return rounded(px.ndwi_change(joined(d)), ["mean_ndwi_delta", "mean_abs_ndwi_delta", "ndwi_changed_fraction"])


@query(
    "sar_log_ratio_change",
    delta_sql("ds", "sar", 2.0, ["vv1", "vv2"], "CASE WHEN error IS NULL THEN round(s, 6) END AS std_sar_delta, error"),
    PAIRS,
)
def _(d):
    names = ["mean_sar_delta", "mean_abs_sar_delta", "std_sar_delta", "sar_changed_fraction"]
    return rounded(px.sar_log_ratio_change(joined(d)), names)


REPORT = (
    J
    + """, g AS (SELECT pair_id, count_if(NOT matched) > 0 AS bad, CASE WHEN count(dv) = count(*) THEN avg(dv) END AS mv, CASE WHEN count(dv) = count(*) THEN avg(abs(dv)) END AS av,
      CASE WHEN count(dw) = count(*) THEN avg(dw) END AS mw, CASE WHEN count(dw) = count(*) THEN avg(abs(dw)) END AS aw,
      CASE WHEN count(ds) = count(*) THEN avg(ds) END AS ms, CASE WHEN count(ds) = count(*) THEN avg(abs(ds)) END AS sa FROM p GROUP BY pair_id),
    h AS (SELECT pair_id, bad, CASE WHEN NOT bad THEN mv END AS mv, CASE WHEN NOT bad THEN mw END AS mw, CASE WHEN NOT bad THEN ms END AS ms,
      CASE WHEN NOT bad AND av IS NOT NULL THEN least(av / 2, 1) END AS cv, CASE WHEN NOT bad AND aw IS NOT NULL THEN least(aw / 2, 1) END AS cw, CASE WHEN NOT bad AND sa IS NOT NULL THEN least(sa / 2, 1) END AS cs FROM g),
    o AS (SELECT *, coalesce((cv + cw) / 2, cv, cw) AS opt FROM h),
    s AS (SELECT *, coalesce((opt + cs) / 2, opt, cs) AS score FROM o) """
)


@query(
    "change_score",
    REPORT + "SELECT pair_id, round(score, 6) AS change_score, CASE WHEN bad THEN 'shape mismatch: pixels of t1 and t2 do not align' END AS error FROM s",
    PAIRS,
)
def _(d):
    return rounded(px.change_score(joined(d)), ["change_score"])


def trend(c, what, unit):
    c = f"(round({c}, 9) + 0e0)"
    return (
        f"CASE WHEN {c} > 0.05 THEN 'increase in ' WHEN {c} < -0.05 THEN 'decrease in ' WHEN {c} IS NOT NULL THEN 'stable ' END "
        f"|| '{what} ({unit} delta: ' || printf('%+.2f', {c}) || ')'"
    )


@query(
    "change_description",
    REPORT
    + f"""SELECT pair_id, CASE WHEN score IS NULL THEN 'Insufficient data provided for temporal change description.' ELSE concat_ws(' ',
      'Bi-temporal analysis indicates ' || CASE WHEN score < 0.05 THEN 'no significant' WHEN score < 0.3 THEN 'minor' WHEN score < 0.7 THEN 'moderate' ELSE 'significant' END
        || ' observed temporal change (change score: ' || printf('%.4f', score) || ').',
      'Sentinel-2 optical metrics show ' || nullif(concat_ws(', ', {trend('mv', 'vegetation index', 'NDVI')}, {trend('mw', 'water index', 'NDWI')}), '') || '.',
      'Sentinel-1 SAR metrics show ' || {trend('ms', 'SAR backscatter intensity', 'log-ratio')} || '.') END AS change_description FROM s""",
    PAIRS,
)
def _(d):
    return px.change_report(joined(d)).select("pair_id", "change_description")


@query(
    "change_score_simple",
    J + "SELECT pair_id, CASE WHEN count_if(NOT matched) = 0 AND avg(vv1) <> 0 THEN round((abs(avg(dv)) + abs(avg(dw)) + abs(avg(vv2) / avg(vv1) - 1)) / 3, 6) END AS change_score_simple FROM p GROUP BY pair_id",
    PAIRS,
)
def _(d):
    return rounded(px.change_score_simple(joined(d)), ["change_score_simple"])


@query(
    "change_map_minmax",
    J + """, m AS (SELECT *, min(dv) OVER (PARTITION BY pair_id) AS lo, max(dv) OVER (PARTITION BY pair_id) AS hi FROM p)
    SELECT pair_id, row, col, CASE WHEN dv IS NULL THEN NULL WHEN hi - lo < 1e-9 THEN 0.5e0 ELSE round((dv - lo) / (hi - lo), 6) END AS normalized FROM m""",
    PAIRS,
)
def _(d):
    maps = joined(d).withColumn("delta", px.ndvi_delta())
    return px.change_map_minmax(maps, "pair_id", "delta").select("pair_id", "row", "col", r6("normalized", "normalized"))


@query("change_map_abs", J + "SELECT pair_id, row, col, CASE WHEN ds IS NOT NULL THEN round(least(abs(ds) / 2, 1), 6) END AS normalized FROM p", PAIRS)
def _(d):
    from ..functions.bands import sar_log_ratio

    maps = joined(d).withColumn("delta", sar_log_ratio(F.col("vv_t1"), F.col("vv_t2")))
    return px.change_map_abs(maps, "delta").select("pair_id", "row", "col", r6("normalized", "normalized"))


# ---- radar scenes -------------------------------------------------------------

DB = """WITH+ b AS (SELECT scene_id, row, col, 10 * log10(greatest(vv, 1e-10)) AS v, 10 * log10(greatest(coalesce(vh, vv), 1e-10)) AS h, vh IS NULL AS copied FROM radar),
  f AS (SELECT scene_id, avg(CASE WHEN v < -17 THEN 1e0 ELSE 0e0 END) AS water, avg(CASE WHEN v > -10 AND h > -20 THEN 1e0 ELSE 0e0 END) AS built,
    avg(v) AS mv, avg(h) AS mh, bool_or(copied) AS vh_copied FROM b GROUP BY scene_id) """


@query(
    "sar_features",
    DB
    + """SELECT scene_id, round(water, 6) AS water_fraction, round(built, 6) AS builtup_fraction, round(mv, 6) AS mean_vv_db, round(mh, 6) AS mean_vh_db, 0e0 AS log_ratio_mean, vh_copied FROM f""",
    ("radar",),
)
def _(d):
    out = px.sar_features(d.view("radar"))
    return rounded(out, ["water_fraction", "builtup_fraction", "mean_vv_db", "mean_vh_db"])


@query(
    "sar_features_reference",
    DB + "SELECT a.scene_id, round(avg(a.v - (10 * log10(greatest(r.vv * 2, 1e-10)))), 6) AS log_ratio_mean FROM b a JOIN radar r ON a.scene_id = r.scene_id AND a.row = r.row AND a.col = r.col GROUP BY 1",
    ("radar",),
)
def _(d):
    radar = d.view("radar")
    return px.sar_features(radar, radar.withColumn("vv", F.col("vv") * 2)).select("scene_id", r6("log_ratio_mean", "log_ratio_mean"))


@query(
    "cross_check",
    DB
    + """, t AS (SELECT d.doc_id, d.text || CASE d.doc_id % 4 WHEN 0 THEN ' a lake' WHEN 1 THEN ' urban area' WHEN 2 THEN ' river and settlement' ELSE '' END AS text, f.water, f.built
      FROM documents d JOIN f ON f.scene_id = d.doc_id % (SELECT count(*) FROM f)),
    k AS (SELECT *, regexp_matches(lower(text), 'water|lake|river|flood|wet') AS sw, regexp_matches(lower(text), 'building|built-up|urban|structure|settlement') AS sb,
      water > 0.2 AS dw, built > 0.15 AS db, printf('%.1f%%', water * 100) AS pw, printf('%.1f%%', built * 100) AS pb FROM t),
    n AS (SELECT *, concat_ws('; ', CASE WHEN dw AND NOT sw THEN 'Deterministic shows water (' || pw || ') but model doesn''t mention water'
      WHEN NOT dw AND sw THEN 'Model mentions water but deterministic shows minimal water (' || pw || ')' END,
      CASE WHEN db AND NOT sb THEN 'Deterministic shows built-up (' || pb || ') but model doesn''t mention structures'
      WHEN NOT db AND sb THEN 'Model mentions built-up but deterministic shows minimal built-up (' || pb || ')' END) AS det FROM k)
    SELECT doc_id, det <> '' AS disagreement, CASE WHEN (dw AND NOT sw) OR (db AND NOT sb) THEN 'major' ELSE 'minor' END AS severity,
      CASE WHEN det = '' THEN 'No significant disagreement' ELSE det END AS details FROM n""",
    ("radar",),
)
def _(d):
    features = px.sar_features(d.view("radar"))
    count = features.agg(F.count("*")).scalar()
    tail = F.when(F.col("doc_id") % 4 == 0, " a lake").when(F.col("doc_id") % 4 == 1, " urban area").when(
        F.col("doc_id") % 4 == 2, " river and settlement"
    ).otherwise("")
    docs = d.table("documents").select("doc_id", F.concat("text", tail).alias("text"))
    rows = docs.withColumn("scene_id", F.col("doc_id") % count).join(features, "scene_id")
    check = scores.cross_check(F.col("text"), F.col("water_fraction"), F.col("builtup_fraction"))
    return rows.select("doc_id", check.alias("c")).select("doc_id", "c.*")


LONG = """WITH+ l AS (SELECT scene_id, row, col, 'vv' AS band, vv AS value FROM radar UNION ALL SELECT scene_id, row, col, 'vh', vh FROM radar WHERE vh IS NOT NULL) """


def bands_long(d):
    return px.unpivot_bands(d.view("radar"), ["scene_id", "row", "col"], ["vv", "vh"]).filter(F.col("value").isNotNull())


PIX = ["scene_id", "row", "col", "band"]


@query(
    "band_normalize_sigma",
    LONG
    + """, s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM l WINDOW w AS (PARTITION BY scene_id, band))
    SELECT scene_id, row, col, band, round(CASE WHEN d > 0 THEN least(greatest((least(greatest(value, m - 2 * d), m + 2 * d) - (m - 2 * d)) / (4 * d), 0), 1) ELSE 0e0 END, 6) AS normalized FROM s""",
    ("radar",),
)
def _(d):
    return px.band_normalize_sigma(bands_long(d), ["scene_id", "band"]).select(*PIX, r6("normalized", "normalized"))


@query(
    "band_minmax",
    LONG
    + """SELECT scene_id, row, col, band, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0e0 END, 6) AS normalized FROM
    (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM l WINDOW w AS (PARTITION BY scene_id, band))""",
    ("radar",),
)
def _(d):
    return px.band_minmax(bands_long(d), ["scene_id", "band"]).select(*PIX, r6("normalized", "normalized"))


STRETCH = """, c AS (SELECT scene_id, band, quantile_cont(value, {lo}::DOUBLE) AS lo, quantile_cont(value, {hi}::DOUBLE) AS h0 FROM {src} GROUP BY 1, 2),
  e AS (SELECT *, CASE WHEN h0 - lo < 1e-6 THEN lo + 1 ELSE h0 END AS hi FROM c)
  SELECT l.scene_id, l.row, l.col, l.band, CAST(floor(round((least(greatest(value, lo), hi) - lo) / (hi - lo) * 255e0, 9)) AS INT) AS level
  FROM {src} l JOIN e ON l.scene_id = e.scene_id AND l.band = e.band"""


@query("band_stretch_percentile", LONG + STRETCH.format(lo=0.02, hi=0.98, src="l"), ("radar",))
def _(d):
    return px.band_stretch_percentile(bands_long(d), ["scene_id", "band"], 98.0).select(*PIX, "level")


@query(
    "pseudo_rgb",
    """SELECT scene_id, row, col, round(10 * log10(greatest(vv, 1e-7)), 6) AS r, round(10 * log10(greatest(vh, 1e-7)), 6) AS g,
    round(10 * log10(greatest(vv, 1e-7)) - 10 * log10(greatest(vh, 1e-7)) + 10, 6) AS b FROM radar WHERE vh IS NOT NULL""",
    ("radar",),
)
def _(d):
    rgb = px.pseudo_rgb(d.view("radar").filter("vh IS NOT NULL"), ["scene_id", "row", "col"])
    return rounded(rgb, ["r", "g", "b"])


@query(
    "band_order",
    LONG
    + """, m AS (SELECT scene_id, band, avg(value) AS v FROM l GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY v DESC, band) AS rn, count(*) OVER (PARTITION BY scene_id) AS n FROM m)
    SELECT scene_id, band, round(v, 6) AS mean_intensity, rn AS brightness_rank, CASE WHEN n = 2 THEN CASE rn WHEN 1 THEN 'VV' ELSE 'VH' END END AS role FROM r""",
    ("radar",),
)
def _(d):
    out = px.band_order(bands_long(d))
    return out.select("scene_id", "band", r6("mean_intensity", "mean_intensity"), "brightness_rank", "role")


# ---- stencils: mirrored edges, 5 x 5 ------------------------------------------

LINE = """{name}e AS (SELECT s.*, min({axis}) OVER w AS a, max({axis}) OVER w AS b FROM {src} s WINDOW w AS (PARTITION BY scene_id)),
  {name}c AS (SELECT *, 2 * (b - a + 1) * k + CASE m WHEN 0 THEN {axis} - a ELSE -1 - ({axis} - a) END AS pos FROM {name}e, range(-{half}, {half} + 1) t(k), range(0, 2) u(m)),
  {name}n AS (SELECT *, {axis} - a AS i FROM {name}c WHERE pos >= -{half} AND pos <= b - a + {half}),
  {name} AS (SELECT * EXCLUDE (a, b, k, m, pos, i, mean, sq, m2, q2), m2 AS mean, q2 AS sq FROM (SELECT *, avg(mean) OVER w AS m2, avg(sq) OVER w AS q2 FROM {name}n
    WINDOW w AS (PARTITION BY scene_id, {line} ORDER BY pos RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)) WHERE pos = i)"""


def stencil(value: str, half: int) -> str:
    return (
        f"WITH+ base AS (SELECT scene_id, row, col, value, {value} AS x, {value} AS mean, {value} * {value} AS sq FROM raster), "
        + LINE.format(name="h", src="base", line="row", axis="col", half=half)
        + ", "
        + LINE.format(name="v", src="h", line="col", axis="row", half=half)
        + ", s AS (SELECT scene_id, row, col, x, mean, sq - mean * mean AS var FROM v) "
    )


@query(
    "box_filter_mean_var",
    stencil("value", 2) + "SELECT scene_id, row, col, round(mean, 6) AS local_mean, round(var, 6) AS local_var FROM s",
    ("raster",),
)
def _(d):
    out = px.box_filter_mean_var(d.view("raster"), ["scene_id"])
    return out.select("scene_id", "row", "col", r6("local_mean", "local_mean"), r6("local_var", "local_var"))


TO_DB = "(10 * log10(greatest(value, 1e-7)))"


@query(
    "lee_filter",
    stencil(TO_DB, 2)
    + "SELECT scene_id, row, col, round(pow(10, (mean + least(greatest(var / (var + 0.25e0), 0), 1) * (x - mean)) / 10), 6) AS filtered FROM s",
    ("raster",),
)
def _(d):
    return px.lee_filter(d.view("raster"), ["scene_id"]).select("scene_id", "row", "col", r6("filtered", "filtered"))


@query(
    "lee_filter_enhanced",
    stencil(TO_DB, 3)
    + """SELECT scene_id, row, col, round(pow(10, (mean + CASE WHEN cv < sqrt(0.5e0) THEN 0 WHEN cv < 1 THEN (cv * cv - 0.5e0) / (cv * cv * 1.5e0) ELSE 1 END * (x - mean)) / 10), 6) AS filtered
    FROM (SELECT *, sqrt(greatest(var, 0)) / (abs(mean) + 1e-10) AS cv FROM s)""",
    ("raster",),
)
def _(d):
    return px.lee_filter_enhanced(d.view("raster"), ["scene_id"]).select("scene_id", "row", "col", r6("filtered", "filtered"))


@query(
    "fusion_statement",
    DB
    + """SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN '[SAR VLM] dark water' ELSE '[SAR Deterministic] Water cover ' || printf('%.1f%%', water * 100) || ', built-up ' || printf('%.1f%%', built * 100)
      || ', mean log-ratio 0.00.' END || ' [VLM Optical] fields.' || CASE WHEN water > 0.3 THEN ' SAR confirms significant water presence (low VV backscatter).' ELSE '' END
      || CASE WHEN built > 0.2 THEN ' SAR indicates built-up structures (high VV+VH backscatter).' ELSE '' END AS statement FROM f""",
    ("radar",),
)
def _(d):
    rows = px.sar_features(d.view("radar"))
    caption = F.when(F.col("scene_id") % 3 == 0, "dark water")
    text = scores.fusion_statement(
        F.lit("fields"), caption, F.col("water_fraction"), F.col("builtup_fraction"), F.col("log_ratio_mean")
    )
    return rows.select("scene_id", text.alias("statement"))
