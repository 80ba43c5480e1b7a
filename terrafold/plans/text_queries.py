"""Registered queries: query log, sessions, duplicates, training data, gates, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import catalog, evalkit as ev, examples as ex, joins, querylog as ql, textsim as ts
from .bindings import day_text
from .registry import query, r6

AS_OF = "2001-05-15"


def sql_any(text, words):
    body = "|".join(w.replace("-", "\\-") for w in words)
    return f"regexp_matches({text}, '{body}')"


TASK = "CASE " + " ".join(f"WHEN {sql_any('lower(q)', kws)} THEN '{t}'" for t, kws in fv.TASK_KEYWORDS.items()) + " ELSE 'search' END"
S1, S2 = (sql_any("lower(q)", fv.SENSOR_KEYWORDS[s]) for s in ("Sentinel-1", "Sentinel-2"))
SENSOR = f"CASE WHEN {S1} AND {S2} THEN 'both' WHEN {S1} THEN 'Sentinel-1' WHEN {S2} THEN 'Sentinel-2' END"
OBJECT = "CASE " + " ".join(f"WHEN contains(lower(q), '{w}') THEN '{w}'" for w in fv.OBJECT_KEYWORDS) + " END"
NAME = "[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)*"
STOP = "[" + ", ".join(f"'{w}'" for w in fv.NON_LOCATION_WORDS) + "]"
# look-behind written out: a run may not begin the text or follow a full stop
RUNS = f"regexp_extract_all(regexp_replace(regexp_replace(q, '^\\w+', ''), '\\. \\w+', '. ', 'g'), '\\b({NAME})\\b', 1)"
PLACED = f"regexp_extract(q, '(?:near|around|in|of|over)\\s+({NAME})', 1)"
LOCATION = (
    f"CASE WHEN {PLACED} <> '' AND NOT list_contains({STOP}, regexp_split_to_array(lower({PLACED}), '\\s+')[1]) THEN {PLACED} "
    f"ELSE list_filter({RUNS}, lambda r: NOT list_has_any(regexp_split_to_array(lower(r), '\\s+'), {STOP}))[-1] END"
)
ISO = "regexp_extract_all(q, '\\d{4}-\\d{2}-\\d{2}')"
MN = f"regexp_extract_all(q, '(?i)({fv.MONTH_PATTERN})\\s+(\\d{{4}})', 1)"
YN = f"regexp_extract_all(q, '(?i)({fv.MONTH_PATTERN})\\s+(\\d{{4}})', 2)"
YEAR = "regexp_extract(q, '(?i)(?:from|in|during|year)\\s+(\\d{4})', 1)"
MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in fv.MONTH_PREFIXES) + "]"


def month_date(i):
    return f"make_date(CAST({YN}[{i}] AS BIGINT), list_position({MONTH_LIST}, lower(substr({MN}[{i}], 1, 3))), 1)"


START = (
    f"CASE WHEN len({ISO}) >= 1 THEN CAST({ISO}[1] AS DATE) WHEN len({MN}) >= 1 THEN {month_date(1)} "
    f"WHEN {YEAR} <> '' THEN CAST({YEAR} || '-01-01' AS DATE) WHEN contains(lower(q), 'last year') THEN DATE '2000-01-01' "
    "WHEN contains(lower(q), 'last month') THEN DATE '2001-04-01' END"
)
END = (
    f"CASE WHEN len({ISO}) >= 2 THEN CAST({ISO}[2] AS DATE) WHEN len({ISO}) = 1 THEN CAST({ISO}[1] AS DATE) "
    f"WHEN len({MN}) >= 2 THEN last_day({month_date(2)}) WHEN len({MN}) = 1 THEN last_day({month_date(1)}) "
    f"WHEN {YEAR} <> '' THEN CAST({YEAR} || '-12-31' AS DATE) WHEN contains(lower(q), 'last year') THEN DATE '2000-12-31' "
    "WHEN contains(lower(q), 'last month') THEN DATE '2001-04-30' END"
)
TRIGGERS = fv.REFERRING_TRIGGERS
REFERRING = "CASE " + " ".join(
    f"WHEN contains(lower(q), '{t}') THEN trim(substr(q, position('{t}' IN lower(q)) + {len(t)}), ' .')" for t in TRIGGERS
) + " END"
LABELS = f"""WITH+ src AS (SELECT query_id, query_text AS q FROM query_text),
  lab AS (SELECT query_id, q, {TASK} AS task_type, {SENSOR} AS sensor, {OBJECT} AS object, {LOCATION} AS location, {START} AS start_date, {END} AS end_date FROM src) """
QT = ("query_text",)


def labelled(d):
    return ql.label_queries(d.view("query_text"), F.lit(AS_OF).cast("date"))


for _field, _expr in (("task_type", TASK), ("sensor", SENSOR), ("object", OBJECT), ("location", LOCATION)):
    _name = {"task_type": "label_task"}.get(_field, f"label_{_field}")

    @query(_name, f"WITH+ src AS (SELECT query_id, query_text AS q FROM query_text) SELECT query_id, {_expr} AS {_field} FROM src", QT)
    def _(d, _field=_field):
        return labelled(d).select("query_id", _field)


@query("label_dates", LABELS + "SELECT query_id, strftime(start_date, '%Y-%m-%d') AS start_day, strftime(end_date, '%Y-%m-%d') AS end_day FROM lab", QT)
def _(d):
    return labelled(d).select("query_id", day_text("start_date").alias("start_day"), day_text("end_date").alias("end_day"))


@query(
    "label_question",
    LABELS + "SELECT query_id, CASE WHEN task_type = 'vqa' AND contains(q, '?') THEN trim(q) END AS question FROM lab",
    QT,
)
def _(d):
    return labelled(d).select("query_id", "question")


@query("label_referring", LABELS + f"SELECT query_id, CASE WHEN task_type IN ('caption', 'grounding') THEN {REFERRING} END AS referring_expression FROM lab", QT)
def _(d):
    return labelled(d).select("query_id", "referring_expression")


@query(
    "label_queries",
    LABELS
    + """SELECT query_id, task_type, sensor, object, location, strftime(start_date, '%Y-%m-%d') AS start_day, task_type = 'change' AS change_flag,
    regexp_replace(md5(lower(trim(q))), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS stable_id FROM lab""",
    QT,
)
def _(d):
    return labelled(d).select(
        "query_id", "task_type", "sensor", "object", "location", day_text("start_date").alias("start_day"), "change_flag", "stable_id"
    )


@query(
    "label_agreement",
    LABELS
    + """, gold AS (SELECT query_id, CASE WHEN kind IN (0) THEN 'search' WHEN kind = 1 THEN 'change' WHEN kind IN (2, 4) THEN 'caption' WHEN kind = 3 THEN 'fusion' ELSE 'search' END AS t,
      CASE WHEN kind IN (0, 2, 4) THEN g_object END AS o, CASE WHEN kind IN (0, 1, 2, 3) THEN g_place END AS p FROM query_text),
    j AS (SELECT lab.*, t, o, p FROM lab JOIN gold ON lab.query_id = gold.query_id)
    SELECT field, n, matches, round(matches * 1e0 / n, 6) AS accuracy FROM (
      SELECT 'task_type' AS field, count(*) AS n, count_if(task_type IS NOT DISTINCT FROM t) AS matches FROM j
      UNION ALL SELECT 'object', count(*), count_if(object IS NOT DISTINCT FROM o) FROM j
      UNION ALL SELECT 'location', count(*), count_if(location IS NOT DISTINCT FROM p) FROM j)""",
    QT,
)
def _(d):
    kind = F.col("kind")
    task = F.when(kind == 1, "change").when(kind.isin(2, 4), "caption").when(kind == 3, "fusion").otherwise("search")
    gold = d.view("query_text").select(
        "query_id",
        task.alias("task_type"),
        F.when(kind.isin(0, 2, 4), F.col("g_object")).alias("object"),
        F.when(kind.isin(0, 1, 2, 3), F.col("g_place")).alias("location"),
    )
    return ql.label_agreement(labelled(d), gold, "query_id", ["task_type", "object", "location"]).withColumn("accuracy", F.round("accuracy", 6))


GAZ = "gaz(i, place, x0, y0, x1, y1) AS (VALUES " + ", ".join(
    f"({i}, '{p}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for i, (p, a, b, c, e) in enumerate(fv.GAZETTEER)
) + ")"
GEO = (
    LABELS
    + f""", {GAZ}, locs AS (SELECT DISTINCT location, lower(trim(location)) AS l FROM lab WHERE location IS NOT NULL),
  geo AS (SELECT * FROM (SELECT locs.location, g.*, row_number() OVER (PARTITION BY locs.location ORDER BY g.place <> l, i) AS r FROM locs JOIN gaz g ON contains(l, g.place) OR contains(g.place, l)) WHERE r = 1) """
)


@query("geocode_join", GEO + "SELECT query_id, lab.location, place, x0 AS p_min_lon, y1 AS p_max_lat FROM lab LEFT JOIN geo ON lab.location = geo.location", QT)
def _(d):
    return joins.geocode_join(labelled(d)).select("query_id", "location", "place", "p_min_lon", "p_max_lat")


@query("geocode_join_table", GEO + "SELECT query_id, lab.location, place, x0 AS p_min_lon, y1 AS p_max_lat FROM lab LEFT JOIN geo ON lab.location = geo.location", QT)
def _(d):
    schema = "ordinal int, place string, min_lon double, min_lat double, max_lon double, max_lat double"
    table = d.spark.createDataFrame([(i, *p) for i, p in enumerate(fv.GAZETTEER)], schema)
    return joins.geocode_join(labelled(d), gazetteer=table).select("query_id", "location", "place", "p_min_lon", "p_max_lat")


@query(
    "query_to_search",
    GEO
    + """SELECT query_id, CASE WHEN lab.location IS NOT NULL AND place IS NULL THEN trim(lab.location || ' ' || q) ELSE q END AS text_query, x0 AS q_min_lon, y0 AS q_min_lat, x1 AS q_max_lon, y1 AS q_max_lat,
    CASE sensor WHEN 'both' THEN 'Sentinel-1,Sentinel-2' ELSE sensor END AS sensors, object AS query_object, 20e0 AS cloud_cover_max FROM lab LEFT JOIN geo ON lab.location = geo.location""",
    QT,
)
def _(d):
    out = ql.query_to_search(labelled(d))
    return out.select(
        "query_id", "text_query", "q_min_lon", "q_min_lat", "q_max_lon", "q_max_lat",
        F.array_join("sensors", ",").alias("sensors"), "query_object", "cloud_cover_max",
    )


# ---- sessions ------------------------------------------------------------------


@query(
    "session_ttl",
    """SELECT query_id, session_id, CAST(sum(f) OVER (PARTITION BY session_id ORDER BY ts, query_id) AS BIGINT) AS session_no FROM
    (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS f FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, query_id))""",
    ("log",),
)
def _(d):
    return ql.session_ttl(d.view("log")).select("query_id", "session_id", "session_no")


@query(
    "session_carry_forward",
    """WITH+ k AS (SELECT *, last_value(CASE WHEN NOT is_followup THEN aoi END IGNORE NULLS) OVER w AS ca, last_value(CASE WHEN NOT is_followup THEN time_range END IGNORE NULLS) OVER w AS ct,
      last_value(CASE WHEN NOT is_followup THEN sensor END IGNORE NULLS) OVER w AS cs FROM log
      WINDOW w AS (PARTITION BY session_id ORDER BY ts, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT query_id, CASE WHEN is_followup AND reuse_aoi THEN coalesce(ca, aoi) ELSE aoi END AS aoi, CASE WHEN is_followup AND reuse_time THEN coalesce(ct, time_range) ELSE time_range END AS time_range,
      CASE WHEN is_followup THEN coalesce(cs, sensor) ELSE sensor END AS sensor FROM k""",
    ("log",),
)
def _(d):
    fields = {"aoi": "reuse_aoi", "time_range": "reuse_time", "sensor": "reuse_sensor"}
    return ql.session_carry_forward(d.view("log"), fields).select("query_id", "aoi", "time_range", "sensor")


@query(
    "session_history",
    """SELECT session_id, string_agg(query_text, '|' ORDER BY ts, query_id) AS history FROM
    (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, query_id DESC) AS r FROM log) WHERE r <= 20 GROUP BY session_id""",
    ("log",),
)
def _(d):
    return ql.session_history(d.view("log"), "query_text").select("session_id", F.array_join("history", "|").alias("history"))


@query(
    "session_stream",
    """WITH+ f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS f FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, query_id)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY ts, query_id) AS no FROM f)
    SELECT session_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM s GROUP BY session_id, no""",
    ("log",),
)
def _(d):
    from ..streaming.jobs import session_windows

    out = session_windows(d.view("log"))
    form = "yyyy-MM-dd HH:mm:ss"
    return out.select("session_id", "n", F.date_format("first_ts", form).alias("first_ts"), F.date_format("last_ts", form).alias("last_ts"))


# ---- duplicates and benchmark overlap -------------------------------------------

NORM = "trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
DOCS = (
    "WITH+ n AS (SELECT doc_id, lang, source, text, " + NORM.format(t="text") + " AS norm FROM documents), "
    "w AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS ws FROM n) "
)
BENCH = (
    DOCS
    + ", b AS (SELECT item_id, "
    + NORM.format(t="text")
    + " AS item FROM benchmark), bw AS (SELECT *, list_distinct(list_filter(string_split(item, ' '), lambda x: x <> '')) AS ws FROM b) "
)


@query(
    "dedup_exact",
    DOCS + "SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY norm) THEN 'dup_exact' END AS reject_reason FROM n",
)
def _(d):
    return ts.dedup_exact(d.table("documents"), "doc_id", "text").select("doc_id", "reject_reason")


@query(
    "dedup_near",
    DOCS
    + """, hits AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.lang = b.lang AND b.doc_id < a.doc_id AND len(a.ws) > 0 AND len(b.ws) > 0
      AND len(b.ws) >= 0.9 * len(a.ws) - 1e-9 AND len(a.ws) >= 0.9 * len(b.ws) - 1e-9 WHERE len(list_intersect(a.ws, b.ws)) >= 0.9 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9)
    SELECT w.doc_id, CASE WHEN hits.doc_id IS NOT NULL THEN 'dup_near' END AS reject_reason FROM w LEFT JOIN hits ON w.doc_id = hits.doc_id""",
)
def _(d):
    return ts.dedup_near(d.documents, "doc_id", "text", ["lang"]).select("doc_id", "reject_reason")


def decon_sql(threshold):
    return (
        BENCH
        + f""", j AS (SELECT DISTINCT w.doc_id FROM w, bw WHERE len(w.ws) > 0 AND len(list_intersect(w.ws, bw.ws)) >= {threshold} * (len(w.ws) + len(bw.ws) - len(list_intersect(w.ws, bw.ws))) - 1e-9),
    c AS (SELECT DISTINCT n.doc_id FROM n, b WHERE contains(n.norm, b.item))
    SELECT n.doc_id, CASE WHEN j.doc_id IS NOT NULL THEN 'jaccard' WHEN c.doc_id IS NOT NULL THEN 'contains' END AS reject_reason
    FROM n LEFT JOIN j ON n.doc_id = j.doc_id LEFT JOIN c ON n.doc_id = c.doc_id"""
    )


def decon(d, threshold):
    out = ts.decontaminate(d.documents, "doc_id", "text", d.table("benchmark"), "item_id", "text", threshold)
    return out.select("doc_id", "reject_reason")


@query("decontaminate", decon_sql(0.6))
def _(d):
    return decon(d, 0.6)


@query("decontaminate_loose", decon_sql(0.2))
def _(d):
    return decon(d, 0.2)


@query(
    "except_rejected",
    DOCS + "SELECT doc_id FROM n WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS m FROM n) WHERE doc_id > m)",
)
def _(d):
    docs = d.table("documents")
    rejected = ts.dedup_exact(docs, "doc_id", "text").filter("reject_reason IS NOT NULL")
    return ts.except_rejected(docs, rejected, "doc_id").select("doc_id")


# ---- training examples -----------------------------------------------------------


def pick_sql(options, key, salt):
    index = f"CAST('0x' || substr(md5({key} || '{salt}'), 1, 8) AS BIGINT) % {len(options)}"
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


def fill_sql(text, **values):
    for name, value in values.items():
        text = f"replace({text}, '{{{name.replace('is_', 'is:')}}}', {value})"
    return text


TRAIN = "FROM scenes0 WHERE coalesce(file_path, '') <> '' AND coalesce(object, '') <> ''"


@query(
    "make_captions",
    f"SELECT scene_id || '.tif' AS image_id, {fill_sql(pick_sql(fv.SCENE_CAPTIONS, 'scene_id', 'caption'), label='object', sensor='sensor', modality='modality')} AS caption {TRAIN}",
    ("scenes0",),
)
def _(d):
    return ex.make_captions(catalog.filter_trainable(d.unpaired))


QA = " UNION ALL ".join(f"SELECT '{q}' AS tq, '{a}' AS ta" for q, a in fv.SCENE_QUESTIONS)


@query(
    "make_vqa",
    f"SELECT scene_id || '.tif' AS image_id, replace(tq, '{{label}}', object) AS question, replace(replace(ta, '{{label}}', object), '{{sensor}}', sensor) AS answer FROM (SELECT * {TRAIN}) s CROSS JOIN ({QA}) t",
    ("scenes0",),
)
def _(d):
    return ex.make_vqa(catalog.filter_trainable(d.unpaired))


@query(
    "make_referring",
    f"SELECT scene_id || '.tif' AS image_id, {fill_sql(pick_sql(fv.SCENE_REFERRING, 'scene_id', 'referring'), label='object')} AS expression, '[0.25, 0.25, 0.75, 0.75]' AS bbox {TRAIN}",
    ("scenes0",),
)
def _(d):
    out = ex.make_referring(catalog.filter_trainable(d.unpaired))
    return out.withColumn("bbox", tx.format_bbox(F.col("bbox")))


IS = {f"is_{c}": f"CASE WHEN object = '{c}' THEN 'Yes' ELSE 'No' END" for c in ("urban", "water", "forest", "agriculture")}
LINEAR = "CASE WHEN object = 'urban' THEN 'Yes, visible in the image' ELSE 'Not clearly visible' END"
SAR_QA = " UNION ALL ".join(f"SELECT '{q}' AS tq, '{a}' AS ta" for q, a in fv.SAR_QUESTIONS)
LABEL_QA = " UNION ALL ".join(f"SELECT '{q}' AS tq, '{a}' AS ta" for q, a in fv.LABEL_QUESTIONS)


def three(captions, qa, referring, where):
    src = f"(SELECT * FROM scenes0 WHERE object IS NOT NULL AND {where}) s"
    return f"""SELECT 'caption' AS kind, scene_id AS image_id, NULL AS question, {fill_sql(pick_sql(captions, 'scene_id', 'caption'), label='object')} AS answer FROM {src}
    UNION ALL SELECT 'vqa', scene_id, tq, {fill_sql('ta', label='object', linear=LINEAR, **IS)} FROM {src} CROSS JOIN ({qa}) t
    UNION ALL SELECT 'referring', scene_id, NULL, {fill_sql(pick_sql(referring, 'scene_id', 'referring'), label='object')} FROM {src}"""


def as_three(parts):
    cap, qa, ref = parts
    none = F.lit(None).cast("string").alias("question")
    a = cap.select(F.lit("caption").alias("kind"), "image_id", none, F.col("caption").alias("answer"))
    b = qa.select(F.lit("vqa").alias("kind"), "image_id", "question", "answer")
    c = ref.select(F.lit("referring").alias("kind"), "image_id", none, F.col("expression").alias("answer"))
    return a.unionAll(b).unionAll(c)


@query("make_label_examples", three(fv.LABEL_CAPTIONS, LABEL_QA, fv.LABEL_REFERRING, "modality <> 'sar'"), ("scenes0",))
def _(d):
    rows = d.unpaired.filter("object IS NOT NULL AND modality <> 'sar'")
    return as_three(ex.make_label_examples(rows, "scene_id", "object"))


@query("make_sar_examples", three(fv.SAR_CAPTIONS, SAR_QA, fv.SAR_REFERRING, "modality = 'sar'"), ("scenes0",))
def _(d):
    rows = d.unpaired.filter("object IS NOT NULL AND modality = 'sar'")
    return as_three(ex.make_sar_examples(rows, "scene_id", "object"))


@query(
    "make_fusion_examples",
    f"""WITH+ daily AS (SELECT aoi, CAST(acquisition_time AS DATE) AS day, max(scene_id) AS optical_id FROM scenes0 WHERE modality <> 'sar' AND acquisition_time IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT s.scene_id AS sar_id, coalesce(s.object, 'mixed') AS object, d.optical_id, row_number() OVER (PARTITION BY s.scene_id ORDER BY d.day) AS r FROM scenes0 s
      JOIN daily d ON s.aoi = d.aoi AND d.day BETWEEN CAST(s.acquisition_time AS DATE) - 3 AND CAST(s.acquisition_time AS DATE) + 3 WHERE s.modality = 'sar')
    SELECT 'pc_sar_' || sar_id || '.tif' AS sar_image_id, 'pc_opt_' || optical_id || '.tif' AS optical_image_id, sar_id AS scene_id,
      {fill_sql(pick_sql(fv.FUSION_CAPTIONS, 'sar_id', 'fusion'), label='object')} AS caption FROM j WHERE r = 1""",
    ("scenes0",),
)
def _(d):
    pairs = joins.optical_sar_interval_join(d.unpaired, "aoi").withColumn("object", F.coalesce("object", F.lit("mixed")))
    return ex.make_fusion_examples(pairs, "object")


@query(
    "union_supervision",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'caption' WHEN 'user' THEN 'vqa' ELSE 'grounding' END AS task_type, CASE role WHEN 'system' THEN text END AS caption,
    CASE role WHEN 'user' THEN text END AS question, CASE WHEN role NOT IN ('system', 'user') THEN text END AS expression,
    CASE conv_id % 3 WHEN 0 THEN 'sar' WHEN 1 THEN 'optical' ELSE 'unknown' END AS modality FROM conversations""",
)
def _(d):
    prefix = "CASE conv_id % 3 WHEN 0 THEN 'sar_' WHEN 1 THEN 's2_' ELSE 'img_' END || CAST(conv_id AS STRING) || '.tif' AS image_id"
    rows = d.table("conversations").selectExpr("conv_id", "turn", "role", "text", prefix)
    parts = [
        rows.filter(cond).select("conv_id", "turn", "image_id", F.col("text").alias(name))
        for cond, name in (("role = 'system'", "caption"), ("role = 'user'", "question"), ("role NOT IN ('system', 'user')", "expression"))
    ]
    return ex.union_supervision(*parts).select("conv_id", "turn", "task_type", "caption", "question", "expression", "modality")


PROMPTS = " ".join(
    f"WHEN m = '{m}' AND t = '{t}' THEN '{fv.PROMPT_TEXTS[k].replace(chr(39), chr(39) * 2)}'" for m, t, k in fv.PROMPT_TABLE
)
FALLBACK = fv.PROMPT_TEXTS["optical_vqa"].replace("'", "''")


@query(
    "prompt_select",
    f"""SELECT scene_id, md5(replace(replace(CASE {PROMPTS} ELSE '{FALLBACK}' END, '{{question}}', 'Is there ' || coalesce(object, 'x') || '?'), '{{expression}}', coalesce(object, ''))) AS prompt_md5
    FROM (SELECT scene_id, object, CASE WHEN scene_no % 6 = 4 THEN 'fusion' WHEN modality = 'sar' THEN 'sar' ELSE 'optical' END AS m,
      CASE scene_no % 6 WHEN 0 THEN 'vqa' WHEN 1 THEN 'caption' WHEN 2 THEN 'grounding' WHEN 3 THEN 'change' WHEN 4 THEN 'caption' ELSE 'other' END AS t FROM scenes0)""",
    ("scenes0",),
)
def _(d):
    tasks = F.array(*[F.lit(t) for t in ("vqa", "caption", "grounding", "change", "fusion", "other")])
    rows = d.unpaired.select(
        "scene_id", "modality",
        F.get(tasks, (F.col("scene_no") % 6).cast("int")).alias("task_type"),
        F.concat(F.lit("Is there "), F.coalesce("object", F.lit("x")), F.lit("?")).alias("question"),
        F.col("object").alias("expression"),
    )
    return ex.prompt_select(rows).select("scene_id", F.md5("prompt").alias("prompt_md5"))


VALID = """CASE WHEN NOT json_valid(structured_query) THEN 'json_parse' WHEN doc_id % 11 IN (1, 2, 3, 5) THEN 'schema' WHEN structured_query <> seed_query THEN 'label_drift'
    WHEN trim(query_text) = '' OR length(query_text) > 300 OR regexp_matches(query_text, '\\{.*\\}') THEN 'query_sanity' END"""


@query("validate_pairs", f"SELECT doc_id, {VALID} AS reject_reason FROM generated", ("generated",))
def _(d):
    return ex.validate_pairs(d.view("generated")).select("doc_id", "reject_reason")


@query("sample_limit", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '0'), doc_id LIMIT 100")
def _(d):
    return ex.sample_limit(d.table("documents"), "doc_id", 100).select("doc_id")


@query(
    "stratified_sample",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '0'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    WHERE lang = 'de' OR r <= ceil(0.1 * n)""",
)
def _(d):
    return ex.stratified_sample(d.table("documents"), "lang", "doc_id", 0.1, ["de"]).select("doc_id", "lang")


@query(
    "assign_split_family",
    """WITH+ f AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY md5(source || '0'), source) AS r FROM f),
    u AS (SELECT *, sum(CASE WHEN r > 2 THEN n ELSE 0 END) OVER (ORDER BY r) - n AS before, sum(CASE WHEN r > 2 THEN n ELSE 0 END) OVER () AS total FROM r),
    s AS (SELECT source, CASE WHEN r <= 2 THEN 'test' WHEN before < total * 0.8 THEN 'train' WHEN before < total * 0.9 THEN 'val' ELSE 'test' END AS split FROM u)
    SELECT doc_id, split FROM documents d JOIN s ON d.source = s.source""",
)
def _(d):
    return ex.assign_split_family(d.table("documents"), "source", 2, 0.8, 0.1).select("doc_id", "split")


@query(
    "time_ordered_split",
    """SELECT o_orderkey, CASE WHEN t <= (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8::DOUBLE) FROM orders) THEN 'train'
    WHEN t <= (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.9::DOUBLE) FROM orders) THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS t FROM orders)""",
)
def _(d):
    return ex.time_ordered_split(d.table("orders"), "o_orderdate", 0.8, 0.1).select("o_orderkey", "split")


@query(
    "hash_split",
    """SELECT o_orderkey, CASE WHEN p < 0.9 THEN 'train' WHEN p < 1 THEN 'val' ELSE 'test' END AS split FROM
    (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '0'), 1, 8) AS BIGINT) / 4294967296e0 AS p FROM orders)""",
)
def _(d):
    return ex.hash_split(d.table("orders"), "o_orderkey").select("o_orderkey", "split")


SYSTEM = "Extract the search fields as JSON."


@query(
    "package_messages",
    f"""SELECT conv_id, turn, '{SYSTEM}' AS system_text, text AS user_text, '{{"role":"' || role || '","turn":"' || turn || '"}}' AS assistant_text FROM conversations""",
)
def _(d):
    raw = F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), "role"))
    rows = d.table("conversations").withColumn("answer", ex.sorted_json(raw))
    out = ex.package_messages(rows, SYSTEM, "text", "answer")
    return out.select(
        "conv_id", "turn",
        *[F.get("messages", F.lit(i))["content"].alias(n) for i, n in enumerate(("system_text", "user_text", "assistant_text"))],
    )


@query(
    "package_check",
    """SELECT count(*) AS n, TRUE AS one_system_prompt, FALSE AS answers_parse, count_if(contains(text, '```')) = 0 AS no_fences,
    (SELECT count(*) FROM (SELECT conv_id % 7 AS f FROM conversations GROUP BY 1 HAVING min(turn % 2) <> max(turn % 2))) AS crossing_families FROM conversations""",
)
def _(d):
    rows = d.table("conversations").selectExpr("*", "conv_id % 7 AS family", "CAST(turn % 2 AS STRING) AS split")
    return ex.package_check(ex.package_messages(rows, SYSTEM, "role", "text"))


# ---- gates -----------------------------------------------------------------------


@query(
    "axis_counts",
    """WITH+ a AS (SELECT lang AS axis FROM documents UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 0)
    SELECT axis, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM documents), 6) AS share FROM a GROUP BY 1""",
)
def _(d):
    axes = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("lang"))
    out = ev.axis_counts(d.table("documents").withColumn("axes", axes), "axes")
    return out.withColumn("share", F.round("share", 6))


QUOTAS = {"en": 1500, "fr": 400, "de": 100, "es": 61}
QSQL = "q(lang, quota) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items()) + ")"


@query(
    "quota_allocation",
    f"""WITH+ {QSQL}, s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, CAST(greatest(1, quota // n) + CASE WHEN r <= quota % n THEN 1 ELSE 0 END AS BIGINT) AS n_generate FROM s JOIN q ON s.lang = q.lang""",
)
def _(d):
    return ev.quota_allocation(d.table("documents"), "lang", "doc_id", QUOTAS).select("doc_id", "n_generate")


@query(
    "distribution_audit",
    """SELECT lang, CAST(count(*) AS BIGINT) AS n, count(DISTINCT place) AS distinct_places, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1e0 ELSE 0e0 END), 6) AS change_ratio, round(avg(length(text)), 6) AS mean_chars,
    round((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS place FROM documents) x WHERE x.lang = y.lang AND place IS NOT NULL GROUP BY place)) * 1e0 / count(*), 6) AS largest_place_share
    FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS place FROM documents) y GROUP BY lang""",
)
def _(d):
    rows = d.table("documents").withColumns(
        {"place": F.when(F.col("doc_id") % 5 != 0, F.col("source")), "change_flag": F.col("doc_id") % 3 == 0}
    )
    out = ev.distribution_audit(rows, "lang", "place", "text", "change_flag")
    return out.withColumns({c: F.round(c, 6) for c in ("change_ratio", "mean_chars", "largest_place_share")})


@query("value_histogram", LABELS + "SELECT sensor AS value, count(*) AS n FROM lab GROUP BY 1", QT)
def _(d):
    return ev.value_histogram(labelled(d), "sensor")


@query("split_overlap", "SELECT count(*) AS families, count_if(s > 1) AS overlapping FROM (SELECT source, count(DISTINCT doc_id % 40 // 21) AS s FROM documents GROUP BY 1)")
def _(d):
    rows = d.table("documents").withColumn("split", F.floor(F.col("doc_id") % 40 / 21))
    return ev.split_overlap(rows, "source", "split")


GATE_Q = {"en": 260, "fr": 60, "de": 54, "es": 50}


@query(
    "generation_gate",
    "WITH+ q(stratum, quota) AS (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in GATE_Q.items())
    + f"""), v AS (SELECT stratum, {VALID} AS r FROM generated)
    SELECT q.stratum, quota, count(v.stratum) AS raw, count_if(v.stratum IS NOT NULL AND r IS NULL) AS accepted, round(count_if(r = 'schema') * 1e0 / count(v.stratum), 6) AS schema_rate,
      round(count_if(r = 'label_drift') * 1e0 / count(v.stratum), 6) AS drift_rate, abs(count_if(v.stratum IS NOT NULL AND r IS NULL) - quota) <= quota * 0.1 AS passed
    FROM q LEFT JOIN v ON q.stratum = v.stratum GROUP BY 1, 2""",
    ("generated",),
)
def _(d):
    quotas = d.spark.createDataFrame(list(GATE_Q.items()), "stratum string, quota int")
    out = ev.generation_gate(ex.validate_pairs(d.view("generated")), "stratum", quotas)
    return out.withColumns({c: F.round(c, 6) for c in ("schema_rate", "drift_rate")})


@query(
    "rejection_rates",
    f"""WITH+ v AS (SELECT {VALID} AS reject_reason FROM generated) SELECT reject_reason, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM v), 6) AS rate FROM v WHERE reject_reason IS NOT NULL GROUP BY 1""",
    ("generated",),
)
def _(d):
    return ev.rejection_rates(ex.validate_pairs(d.view("generated"))).withColumn("rate", F.round("rate", 6))


@query(
    "review_gate",
    """WITH+ r AS (SELECT d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    g AS (SELECT 'stratum' AS scope, lang, count(*) AS reviewed, CAST(sum(quality) AS BIGINT) AS correct, 0.6 AS lim FROM r GROUP BY lang UNION ALL SELECT 'overall', NULL, count(*), CAST(sum(quality) AS BIGINT), 0.7 FROM r)
    SELECT scope, lang, reviewed, correct, round(correct * 1e0 / reviewed, 6) AS rate, correct * 1e0 / reviewed >= lim AS passed FROM g""",
)
def _(d):
    reviewed = d.table("documents").select("doc_id", "lang").join(d.table("labels"), "doc_id")
    return ev.review_gate(reviewed, "lang", "quality", 0.6, 0.7).withColumn("rate", F.round("rate", 6))


@query(
    "loss_reconciliation",
    DOCS
    + """, k AS (SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY norm) AS dup FROM n)
    SELECT count(*) AS raw, count_if(NOT dup) AS accepted, count_if(dup AND doc_id % 7 <> 0) AS rejected, count_if(dup AND doc_id % 7 = 0) AS unexplained,
      round(count_if(dup AND doc_id % 7 = 0) * 1e0 / count(*), 6) AS unexplained_share, count_if(dup AND doc_id % 7 = 0) * 1e0 / count(*) <= 0.005 AS passed FROM k""",
)
def _(d):
    docs = d.table("documents")
    checked = ts.dedup_exact(docs, "doc_id", "text")
    lost = checked.filter("reject_reason IS NOT NULL AND doc_id % 7 <> 0")
    out = ev.loss_reconciliation(docs, checked.filter("reject_reason IS NULL"), lost, "doc_id")
    return out.withColumn("unexplained_share", F.round("unexplained_share", 6))


# ---- answers ---------------------------------------------------------------------


def tok(c):
    return f"list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '([.!?,])', ' \\1 ', 'g')), '\\s+'), lambda x: x <> '')"


GRAMS = f"""WITH+ t AS (SELECT doc_id, task, success, {tok('reference')} AS r, {tok('prediction')} AS p FROM answers),
  u AS (SELECT doc_id, 0 AS side, r AS toks FROM t UNION ALL SELECT doc_id, 1, p FROM t),
  g AS (SELECT doc_id, side, n, array_to_string(toks[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(toks) - n + 2)) AS i FROM u, range(1, 5) x(n) WHERE len(toks) >= n)),
  c AS (SELECT doc_id, n, gram, count_if(side = 0) AS r, count_if(side = 1) AS p FROM g GROUP BY 1, 2, 3),
  s AS (SELECT doc_id, n, sum(least(r, p)) AS m, sum(p) AS tp, sum(r) AS tr FROM c GROUP BY 1, 2),
  o AS (SELECT doc_id, count_if(m > 0) AS k, sum(ln(CASE WHEN m > 0 THEN m * 1e0 / tp END)) AS l, max(CASE WHEN n = 1 THEN m END) AS m1, max(CASE WHEN n = 1 THEN tp END) AS p1, max(CASE WHEN n = 1 THEN tr END) AS r1 FROM s GROUP BY 1),
  sc AS (SELECT t.doc_id, task, success, CASE WHEN k = 4 THEN exp(l / 4) ELSE 0e0 END AS bleu4, CASE WHEN m1 > 0 THEN 2e0 * m1 / (p1 + r1) ELSE 0e0 END AS f1, CASE WHEN t.r = t.p THEN 1e0 ELSE 0e0 END AS exact_match
    FROM t LEFT JOIN o ON t.doc_id = o.doc_id) """


@query("answer_scores", GRAMS + "SELECT doc_id, round(bleu4, 6) AS bleu4, round(f1, 6) AS f1, exact_match FROM sc", ("answers",))
def _(d):
    out = ev.answer_scores(d.view("answers"), "doc_id")
    return out.select("doc_id", r6("bleu4", "bleu4"), r6("f1", "f1"), "exact_match")


@query(
    "bleu_set",
    """WITH+ t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(reference), '\\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(prediction), '\\s+'), lambda x: x <> '') AS p FROM answers),
    u AS (SELECT doc_id, 0 AS side, r AS toks FROM t UNION ALL SELECT doc_id, 1, p FROM t),
    g AS (SELECT DISTINCT doc_id, side, n, array_to_string(toks[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(toks) - n + 2)) AS i FROM u, range(1, 5) x(n) WHERE len(toks) >= n)),
    c AS (SELECT doc_id, n, gram, count_if(side = 0) AS r, count_if(side = 1) AS p FROM g GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, n, sum(r * p) AS m, sum(p) AS tp FROM c GROUP BY 1, 2)
    SELECT t.doc_id, round(coalesce(CASE WHEN count_if(m > 0) = 4 THEN exp(sum(ln(CASE WHEN m > 0 THEN m * 1e0 / tp END)) / 4) END, 0e0), 6) AS bleu FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id""",
    ("answers",),
)
def _(d):
    return d.view("answers").select("doc_id", r6(ev.bleu_set(F.col("reference"), F.col("prediction")), "bleu"))


BOX = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 * 0.7e0 / (0.6e0 * 0.7e0 + 0.6e0 * 0.75e0 - 0.5e0 * 0.7e0) WHEN 2 THEN 0.2e0 * 0.4e0 / (0.6e0 * 0.7e0 + 0.4e0 * 0.4e0 - 0.2e0 * 0.4e0)
  WHEN 3 THEN 0.5e0 * 0.7e0 / (0.6e0 * 0.7e0) ELSE 0e0 END AS iou, doc_id FROM documents"""


@query("box_scores", f"SELECT doc_id, round(iou, 6) AS iou, CASE WHEN iou >= 0.5 THEN 1e0 ELSE 0e0 END AS iou_at_50 FROM ({BOX.replace(', doc_id FROM', ' FROM')})")
def _(d):
    return ev.box_scores(d.view("answers"), "doc_id", "box", "reply").withColumn("iou", F.round("iou", 6))


@query(
    "answer_eval",
    GRAMS
    + """SELECT task, count(*) AS n, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS success_rate, round(avg(CASE WHEN success THEN bleu4 END), 6) AS avg_bleu4,
    round(avg(CASE WHEN success THEN f1 END), 6) AS avg_f1, round(avg(CASE WHEN success THEN exact_match END), 6) AS avg_exact_match FROM sc GROUP BY task""",
    ("answers",),
)
def _(d):
    rows = d.view("answers")
    scored = rows.select("doc_id", "task", "success").join(ev.answer_scores(rows, "doc_id"), "doc_id")
    out = ev.answer_eval(scored, "task", ["bleu4", "f1", "exact_match"])
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_bleu4", "avg_f1", "avg_exact_match")})
