"""Field extraction over a query-log table, session rules, search requests.

Every field is a column expression, so a whole log is labelled in one
projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..functions import geo, text as tx
from ..functions.geo import Box
from .joins import geocode_join
from .ordered import ROWS_PER_CHUNK, balanced_chunks, first_rows, with_last_known, with_neighbours, with_running_sum


# ---- labels ----------------------------------------------------------------


def label_task(text: Column) -> Column:
    """First task, in priority order, with a keyword in the text; ``search`` when none has."""
    lower = F.lower(text)
    out = None
    for task, keywords in fv.TASK_KEYWORDS.items():
        hit = tx.contains_any(lower, keywords)
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise("search")


def label_upload_task(text: Column, has_question: Column, has_second: Column) -> Column:
    """Task of an uploaded image or image pair."""
    fused = tx.contains_any(F.lower(text), ["combine", "optical and sar", "fusion"])
    pair = F.when(fused, "fusion").otherwise("change")
    return F.when(has_second, pair).when(has_question, "vqa").otherwise("caption")


def label_sensor(text: Column) -> Column:
    lower = F.lower(text)
    radar = tx.contains_any(lower, fv.SENSOR_KEYWORDS["Sentinel-1"])
    optical = tx.contains_any(lower, fv.SENSOR_KEYWORDS["Sentinel-2"])
    return F.when(radar & optical, "both").when(radar, "Sentinel-1").when(optical, "Sentinel-2")


def label_object(text: Column) -> Column:
    lower = F.lower(text)
    out = None
    for word in fv.OBJECT_KEYWORDS:
        out = F.when(lower.contains(word), word) if out is None else out.when(lower.contains(word), word)
    return out


def _day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def _month_start(name: Column, year: Column) -> Column:
    prefixes = F.array(*[F.lit(m) for m in fv.MONTH_PREFIXES])
    number = F.array_position(prefixes, F.lower(F.substring(name, 1, 3)))
    return _day(F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-01")))


def label_dates(text: Column, as_of: Column) -> Column:
    """``struct<start, end>`` (dates) from the first rule that finds any: ISO days, month and year, year,
    ``last year``, ``last month``."""
    iso = F.regexp_extract_all(text, F.lit(fv.ISO_DAY_PATTERN), 1)
    pattern = F.lit(fv.MONTH_YEAR_PATTERN)
    months, years = F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2)
    year = F.regexp_extract(text, fv.YEAR_PATTERN, 1)
    lower = F.lower(text)
    at0, at1 = F.lit(0), F.lit(1)

    def span(start, end):
        return F.struct(start.alias("start"), end.alias("end"))

    def month(i):
        return _month_start(F.get(months, i), F.get(years, i))

    last_year = (F.year(as_of) - 1).cast("string")
    this_month = F.trunc(as_of, "month")
    return (
        F.when(F.size(iso) >= 2, span(_day(F.get(iso, at0)), _day(F.get(iso, at1))))
        .when(F.size(iso) == 1, span(_day(F.get(iso, at0)), _day(F.get(iso, at0))))
        .when(F.size(months) >= 2, span(month(at0), F.last_day(month(at1))))
        .when(F.size(months) == 1, span(month(at0), F.last_day(month(at0))))
        .when(year != "", span(_day(F.concat(year, F.lit("-01-01"))), _day(F.concat(year, F.lit("-12-31")))))
        .when(
            F.contains(lower, F.lit("last year")),
            span(_day(F.concat(last_year, F.lit("-01-01"))), _day(F.concat(last_year, F.lit("-12-31")))),
        )
        .when(
            F.contains(lower, F.lit("last month")),
            span(F.add_months(this_month, -1), F.date_sub(this_month, 1)),
        )
    )


def label_location(text: Column) -> Column:
    """Capitalised words after a place preposition, else the last capitalised run without a stop word."""
    stop = F.array(*[F.lit(w) for w in fv.NON_LOCATION_WORDS])

    def head(run):
        return F.get(F.split(F.lower(run), r"\s+"), F.lit(0))

    placed = F.regexp_extract(text, fv.PLACE_AFTER_PREPOSITION_PATTERN, 1)
    runs = F.regexp_extract_all(text, F.lit(fv.CAPITALISED_RUN_PATTERN), 1)
    clean = F.filter(runs, lambda r: ~F.arrays_overlap(F.split(F.lower(r), r"\s+"), stop))
    last = F.get(clean, F.size(clean) - 1)
    return F.when((placed != "") & ~F.array_contains(stop, head(placed)), placed).otherwise(last)


def label_question(text: Column) -> Column:
    return F.when(text.contains("?"), F.trim(text))


def label_referring(text: Column) -> Column:
    """Text after the first trigger phrase (in list order), blanks and full stops trimmed."""
    lower = F.lower(text)
    out = None
    for trigger in fv.REFERRING_TRIGGERS:
        at = F.instr(lower, trigger)
        rest = F.btrim(F.substring(text, at + len(trigger), F.length(text)), F.lit(" ."))
        out = F.when(at > 0, rest) if out is None else out.when(at > 0, rest)
    return out


def label_queries(log: DataFrame, as_of: Column, text: str = "query_text") -> DataFrame:
    """Add every extracted field to a query log in one projection."""
    t = F.coalesce(F.col(text), F.lit(""))
    return log.withColumns(
        {"task_type": label_task(t), "__d": label_dates(t, as_of)}
    ).withColumns(
        {
            "stable_id": tx.stable_query_id(t),
            "location": label_location(t),
            "start_date": F.col("__d.start").cast("timestamp"),
            "end_date": F.col("__d.end").cast("timestamp"),
            "sensor": label_sensor(t),
            "object": label_object(t),
            "change_flag": F.col("task_type") == "change",
            "question": F.when(F.col("task_type") == "vqa", label_question(t)),
            "referring_expression": F.when(F.col("task_type").isin("caption", "grounding"), label_referring(t)),
            "confidence": F.lit(0.5),
            "used_fallback": F.lit(True),
        }
    ).drop("__d")


def label_agreement(extracted: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, n, matches, accuracy``: null-safe exact match of extracted and gold labels."""
    wanted = gold.select(key, *[F.col(f).alias(f"g_{f}") for f in fields])
    joined = extracted.select(key, *fields).join(wanted, key)
    counts = joined.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f).eqNullSafe(F.col(f"g_{f}"))).alias(f) for f in fields]
    )
    long = counts.unpivot(["n"], fields, "field", "matches")
    return long.select("field", "n", "matches", F.try_divide("matches", "n").alias("accuracy"))


def query_to_search(labelled: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Labelled log to search requests: box from the AOI ring or the gazetteer, sensor list, cloud limit."""
    found = geocode_join(labelled, "location", gazetteer)
    ring = geo.polygon_box(F.col("aoi")) if "aoi" in labelled.columns else None
    if ring is not None:
        found = found.withColumn("__r", ring)
        boxes = {n: F.when(F.col("__r").isNotNull(), F.col(f"__r.{n}")).otherwise(F.col("p_" + n)) for n in Box._fields}
    else:
        boxes = {n: F.col("p_" + n) for n in Box._fields}
    out = found.withColumns({"q_" + n: c for n, c in boxes.items()})
    sensors = F.when(F.col("sensor") == "both", F.array(F.lit("Sentinel-1"), F.lit("Sentinel-2"))).when(
        F.col("sensor").isNotNull(), F.array("sensor")
    )
    unplaced = F.col("location").isNotNull() & F.col("q_min_lon").isNull()
    text_query = F.when(unplaced, F.trim(F.concat_ws(" ", "location", "query_text"))).otherwise(F.col("query_text"))
    return out.select(
        "query_id",
        text_query.alias("text_query"),
        *["q_" + n for n in Box._fields],
        "start_date",
        "end_date",
        sensors.alias("sensors"),
        F.col("object").alias("query_object"),
        F.lit(fv.DEFAULT_CLOUD_MAX).alias("cloud_cover_max"),
        "change_flag",
        "task_type",
    )


# ---- sessions --------------------------------------------------------------


def session_carry_forward(
    log: DataFrame,
    fields: dict[str, str],
    session: str = "session_id",
    time: str = "ts",
    row_id: str = "query_id",
    followup: str = "is_followup",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """A follow-up row whose reuse flag is set takes the field from the session's last row that set it.

    ``fields`` maps field to its boolean reuse column. Only rows that are not
    follow-ups set the context.
    """
    sources = log.withColumns({f"__src_{f}": F.when(~F.col(followup), F.col(f)) for f in fields})
    chunked = balanced_chunks(sources, [session], [time, row_id], rows_per_chunk)
    known = with_last_known(chunked, [session], time, row_id, {f"__src_{f}": f"__ctx_{f}" for f in fields}).drop("__chunk")
    resolved = {
        f: F.when(F.col(followup) & F.coalesce(F.col(reuse), F.lit(False)), F.coalesce(f"__ctx_{f}", f)).otherwise(F.col(f))
        for f, reuse in fields.items()
    }
    return known.withColumns(resolved).drop(*[f"__src_{f}" for f in fields], *[f"__ctx_{f}" for f in fields])


def session_history(
    log: DataFrame, text: str, n: int = fv.SESSION_HISTORY, session: str = "session_id", time: str = "ts", row_id: str = "query_id"
) -> DataFrame:
    """The last ``n`` query texts of each session, oldest first."""
    kept = first_rows(log.select(session, time, row_id, text), [session], [F.desc(time), F.desc(row_id)], n, "__r")
    item = F.struct(F.col(time), F.col(row_id), F.col(text).alias("text"))
    return kept.groupBy(session).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]).alias("history")
    )


def session_ttl(
    log: DataFrame,
    session: str = "session_id",
    time: str = "ts",
    row_id: str = "query_id",
    hours: int = fv.SESSION_IDLE_HOURS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Number the sessions of a key: a gap of more than ``hours`` starts a new one."""
    chunked = balanced_chunks(log, [session], [time, row_id], rows_per_chunk)
    linked = with_neighbours(chunked, [session], time, row_id, "__prev", None)
    idle = F.unix_micros(time) - F.unix_micros("__prev.time")
    fresh = F.when(F.col("__prev").isNull() | (idle > hours * 3_600_000_000), 1).otherwise(0)
    flagged = linked.withColumn("__new", fresh).drop("__prev")
    return with_running_sum(flagged, [session], F.col("__chunk"), [time, row_id], F.col("__new"), "session_no").drop("__new")


def session_spans(
    log: DataFrame, session: str = "session_id", time: str = "ts", hours: int = fv.SESSION_IDLE_HOURS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``session, n, first_ts, last_ts`` of every session: rows without a gap of more than ``hours``. Null times are in none.

    Each chunk of a key makes its own partial sessions; only these, a few per chunk, meet by key, where those that
    are not far enough apart become one. A key with a third of all rows is as many tasks as it has chunks.
    """
    idle = hours * 3_600_000_000
    chunked = balanced_chunks(log.filter(F.col(time).isNotNull()).select(session, time), [session], [time], rows_per_chunk)

    def runs(rows: DataFrame, keys: list[str], first: str, last: str, n: Column) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(first, last)
        reached = F.max(last).over(order.rowsBetween(W.unboundedPreceding, -1))
        far = F.unix_micros(F.col(first).cast("timestamp")) - F.unix_micros(reached.cast("timestamp")) > idle
        no = F.sum(F.when(far, 1).otherwise(0)).over(order)
        return rows.withColumn("__no", no).groupBy(*keys, "__no").agg(n.alias("n"), F.min(first).alias("first_ts"), F.max(last).alias("last_ts"))

    partial = runs(chunked, [session, "__chunk"], time, time, F.count("*"))
    return runs(partial.drop("__no"), [session], "first_ts", "last_ts", F.sum("n")).drop("__no")
