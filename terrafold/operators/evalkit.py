"""Evaluation: retrieval metrics, answer metrics, rollups, gates and baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..functions import geo, text as tx
from ..functions.binding import let
from ..functions.geo import Box
from ..functions.grams import overlap
from ..session import materialize
from .ordered import first_rows
from .selection import exact_percentiles


# ---- retrieval -------------------------------------------------------------


def eval_groups(scenes: DataFrame, splits: DataFrame) -> DataFrame:
    """``scene_id, group``: the relevance group (AOI and sensor) of every test scene.

    Relevant to a query are the test scenes of its own group; keeping the group
    key instead of the list of pairs keeps this linear in the scenes.
    """
    test = splits.filter(F.col("split") == "test").select("scene_id", "aoi")
    return scenes.join(test, "scene_id").select("scene_id", F.concat_ws("|", "aoi", "sensor").alias("group"))


def eval_queries(scenes: DataFrame, splits: DataFrame) -> DataFrame:
    """One search request per test scene, worded from its labels."""
    test = scenes.join(splits.filter(F.col("split") == "test").select("scene_id"), "scene_id", "left_semi")
    words = F.when(F.coalesce("object", F.lit("")) != "", F.concat(F.lit("Show me "), "object")).otherwise("Show me images")
    none = F.lit(None).cast("string")
    known = F.when(F.col("sensor").isin("Sentinel-1", "Sentinel-2"), F.col("sensor")).otherwise(none)
    sensor = F.when(F.col("sensor") == "Sentinel-2", "Sentinel-2").otherwise("Sentinel-1")
    return test.select(
        F.col("scene_id").alias("query_id"),
        F.concat_ws(" ", words, known).alias("text_query"),
        *[F.lit(None).cast("double").alias("q_" + n) for n in Box._fields],
        F.col("acquisition_time").alias("start_date"),
        F.lit(None).cast("timestamp").alias("end_date"),
        F.array(sensor).alias("sensors"),
        F.col("object").alias("query_object"),
        F.lit(None).cast("double").alias("cloud_cover_max"),
        F.lit(False).alias("change_flag"),
    )


def eval_retrieval(scenes: DataFrame, splits: DataFrame, k: int, retrieve: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """Report of a retrieval over the test scenes: each asks for the test scenes of its own area and sensor.

    ``retrieve(scenes, queries, k)`` returns ``query_id, scene_id, rank, score``.
    """
    queries = eval_queries(scenes, splits)
    # the few results are read twice, for the hits and for the scores
    results = materialize(retrieve(scenes, queries, k).select("query_id", "scene_id", "rank", "score"))
    items = eval_groups(scenes, splits)
    own = items.withColumnRenamed("scene_id", "query_id")  # a query is named after its test scene
    marked = mark_group_hits(results, own, items)
    return eval_report(retrieval_metrics(marked, group_sizes(own, items), queries), results)


def mark_hits(results: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "scene_id") -> DataFrame:
    """Add ``hit`` from explicit lists of relevant ids (one row per query and id)."""
    wanted = relevant.select(query, item).distinct().withColumn("__hit", F.lit(1))
    return results.join(wanted, [query, item], "left").withColumn("hit", F.coalesce("__hit", F.lit(0))).drop("__hit")


def relevant_sizes(relevant: DataFrame, query: str = "query_id", item: str = "scene_id") -> DataFrame:
    """``query, relevant`` from explicit lists."""
    return relevant.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("relevant"))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: all groups of the row's ``key`` as a list (null: none), for ``mark_group_hits`` of results that are too many to join."""
    lists = groups.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("group")).alias(name))
    return rows.join(lists, key, "left")


def mark_group_hits(
    results: DataFrame, query_groups: DataFrame, item_groups: DataFrame, query: str = "query_id", item: str = "scene_id"
) -> DataFrame:
    """Add ``hit``: the returned item belongs to the query's group.

    Results that carry the lists of both sides as ``query_groups`` and ``item_groups`` (``attach_groups``, before they were paired) are not joined.
    """
    if {"query_groups", "item_groups"} <= set(results.columns):
        joined = results.withColumn("__qg", F.explode_outer("query_groups")).withColumn("__ig", F.explode_outer("item_groups"))
        same = F.coalesce(F.col("__qg.group") == F.col("__ig.group"), F.lit(False))
        return joined.withColumn("hit", same.cast("int")).drop("__qg", "__ig", "query_groups", "item_groups")
    q = query_groups.select(query, F.col("group").alias("__qg"))
    i = item_groups.select(item, F.col("group").alias("__ig"))
    joined = results.join(q, query, "left").join(i, item, "left")
    same = F.coalesce(F.col("__qg") == F.col("__ig"), F.lit(False))
    return joined.withColumn("hit", same.cast("int")).drop("__qg", "__ig")


def group_sizes(
    query_groups: DataFrame, item_groups: DataFrame, query: str = "query_id", exclude_self: bool = False
) -> DataFrame:
    """``query, relevant``: size of each query's group, less the query itself when it is one of the items."""
    sizes = item_groups.groupBy("group").agg(F.count("*").alias("__n"))
    n = F.coalesce("__n", F.lit(0)) - int(exclude_self)
    return query_groups.join(sizes, "group", "left").select(query, n.alias("relevant"))


def intersect_hits(marked: DataFrame, query: str = "query_id", item: str = "scene_id") -> DataFrame:
    """Retrieved ∩ relevant, as (query, item) rows."""
    return marked.filter(F.col("hit") == 1).select(query, item).distinct()


def average_precision(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """``query, returned, hits, precision_sum`` over the first ``k`` ranks (a bounded window per query)."""
    top = hits.filter(F.col("rank") <= k)
    so_far = F.sum("hit").over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    gain = F.when(F.col("hit") == 1, so_far / F.col("rank")).otherwise(F.lit(0.0))
    return (
        top.withColumn("__gain", gain)
        .groupBy(query)
        .agg(
            F.count("*").alias("returned"),
            F.sum("hit").alias("hits"),
            F.sum("__gain").alias("precision_sum"),
        )
    )


def retrieval_metrics(
    marked: DataFrame,
    sizes: DataFrame,
    queries: DataFrame,
    k: int = 5,
    empty_relevant: float = 0.0,
    query: str = "query_id",
) -> DataFrame:
    """Recall, precision and AP at ``k`` of every query, also of those that returned nothing.

    ``marked`` are ranked results with ``hit``, ``sizes`` the number of
    relevant items per query. Precision divides by the number returned and AP
    by the number relevant. A query without relevant items scores
    ``empty_relevant`` recall.
    """
    per_query = average_precision(marked, k, query)
    joined = queries.select(query).distinct().join(per_query, query, "left").join(sizes, query, "left")
    n, found, returned = (F.coalesce(c, F.lit(0)) for c in ("relevant", "hits", "returned"))
    zero = F.lit(0.0)
    return joined.select(
        query,
        n.alias("relevant"),
        returned.alias("returned"),
        F.when(n == 0, F.lit(float(empty_relevant))).otherwise(F.try_divide(found, n)).alias("recall"),
        F.when((returned == 0) | (n == 0), zero).otherwise(F.try_divide(found, returned)).alias("precision"),
        F.when(n == 0, zero).otherwise(F.try_divide(F.coalesce("precision_sum", zero), n)).alias("ap"),
    )


def macro_mean(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("num_queries"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("ap").alias("map"),
    )


def similarity_stats(results: DataFrame, score: str = "score") -> DataFrame:
    return results.agg(
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )


def latency_stats(log: DataFrame, latency: str, keys: list[str] | None = None) -> DataFrame:
    """p50, p95 (linear interpolation) and mean, overall or per key."""
    keys = keys or []
    cuts = exact_percentiles(log, keys, latency, [0.5, 0.95])

    def at(p):
        return F.max(F.when(F.col("prob") == p, F.col("percentile")))

    wide = cuts.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    means = log.filter(F.col(latency).isNotNull()).groupBy(*keys).agg(F.avg(latency).alias("mean"))
    if keys:
        return wide.join(means, keys)
    return wide.withColumn("mean", means.scalar())


def eval_report(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """One report row: macro means and statistics of the returned scores."""
    stats = similarity_stats(results).agg(
        F.first(F.struct("mean", "std", "min", "max")).alias("s")
    ).scalar()
    return macro_mean(metrics).withColumn("similarity", stats)


# ---- traces and run history ------------------------------------------------


def trace_rollup(traces: DataFrame, tools: str = "tools_called") -> DataFrame:
    """Calls, success rate and total latency per tool."""
    calls = traces.select(F.explode(tools).alias("t")).select("t.*")
    return calls.groupBy("tool_name").agg(
        F.count("*").alias("calls"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )


def run_metrics(history: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Run history to one row per (run, metric): ``tag, date, metric, value``."""
    names = groups or ["metrics", "cosine_similarity", "latency_ms"]
    flat, columns = history, []
    for group in names:
        for field in history.schema[group].dataType.fields:
            column = f"{group}.{field.name}"
            flat = flat.withColumn(column, F.col(group)[field.name].cast("double"))
            columns.append(column)
    quoted = [f"`{c}`" for c in columns]
    return flat.select("tag", "date", *quoted).unpivot(["tag", "date"], quoted, "metric", "value")


def latest_baseline(runs: DataFrame) -> DataFrame:
    """Per metric, the newest run whose tag starts with ``baseline_``."""
    marked = runs.filter(F.col("tag").startswith("baseline_"))
    newest = marked.groupBy("metric").agg(F.max_by(F.struct("tag", "date", "value"), F.struct("date", "tag")).alias("b"))
    return newest.select("metric", F.col("b.tag").alias("tag"), F.col("b.date").alias("date"), F.col("b.value").alias("value"))


def baseline_compare(runs: DataFrame) -> DataFrame:
    """Every run's metric against the newest earlier baseline run (history is one row per run and metric)."""
    order = W.partitionBy("metric").orderBy("date", "tag").rowsBetween(W.unboundedPreceding, -1)
    marked = F.when(F.col("tag").startswith("baseline_"), F.col("value"))
    base = runs.withColumn("baseline", F.last(marked, ignorenulls=True).over(order))
    delta = F.when(F.col("baseline") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("value") - F.col("baseline"), F.col("baseline")) * 100
    )
    return base.filter(F.col("baseline").isNotNull()).withColumn("delta_pct", delta)


# ---- answers ---------------------------------------------------------------


def bleu_set(reference: Column, prediction: Column) -> Column:
    """Set-based 1–4-gram precision, geometric mean, no brevity penalty. Null texts are empty."""
    counted = overlap(reference, prediction, punctuation=False, distinct=True)

    def score(c: Column) -> Column:
        logs = F.lit(0.0)
        for n in range(1, 5):
            logs = logs + F.log(F.when(c[f"m{n}"] > 0, c[f"m{n}"] / c[f"t{n}"]))
        return F.coalesce(F.exp(logs / 4), F.lit(0.0))

    return let(counted, score)


def answer_scores(rows: DataFrame, key: str, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """``key, bleu4, f1, exact_match`` with clipped n-gram counts, all within the row (``functions.grams``)."""
    counted = rows.select(key, overlap(F.col(reference), F.col(prediction), punctuation=True).alias("__n"))
    counted = counted.select(key, "__n.*")
    logs = F.lit(0.0)
    for n in range(1, 5):
        logs = logs + F.log(F.when(F.col(f"m{n}") > 0, F.try_divide(f"m{n}", f"t{n}")))
    precision, recall = F.try_divide("m1", "t1"), F.try_divide("m1", "r1")
    f1 = F.when(F.col("m1") > 0, F.try_divide(2 * precision * recall, precision + recall)).otherwise(F.lit(0.0))
    bleu = F.coalesce(F.exp(logs / 4), F.lit(0.0))
    return counted.select(key, bleu.alias("bleu4"), f1.alias("f1"), F.col("same").cast("double").alias("exact_match"))


def box_scores(rows: DataFrame, key: str, reference: str, reply: str) -> DataFrame:
    """IoU of a reply text's box with the reference box, and whether it reaches 0.5."""
    parsed = rows.withColumn("__b", tx.parse_bbox_text(F.col(reply)))
    a = Box(*[F.get("__b", F.lit(i)) for i in range(4)])
    b = Box(*[F.get(reference, F.lit(i)) for i in range(4)])
    value = F.when(F.col("__b").isNull() | F.col(reference).isNull(), F.lit(0.0)).otherwise(geo.iou(a, b))
    return parsed.select(key, value.alias("iou"), (value >= 0.5).cast("double").alias("iou_at_50"))


def answer_eval(scored: DataFrame, task: str, metrics: list[str], success: str = "success") -> DataFrame:
    """Per task: rows, success rate and the mean of each metric over the successful rows."""
    ok = F.col(success)
    return scored.groupBy(task).agg(
        F.count("*").alias("n"),
        F.avg(ok.cast("double")).alias("success_rate"),
        *[F.avg(F.when(ok, F.col(m))).alias(f"avg_{m}") for m in metrics],
    )


# ---- dataset gates ---------------------------------------------------------


def axis_counts(rows: DataFrame, axes: str, share_of: str | None = None) -> DataFrame:
    """Rows per variant axis (an array column) and their share of all rows."""
    total = rows.agg(F.count("*")).scalar()
    counts = rows.select(F.explode(axes).alias("axis")).groupBy("axis").agg(F.count("*").alias("n"))
    out = counts.withColumn("share", F.try_divide(F.col("n"), total))
    return out if share_of is None else out.filter(F.col("axis") == share_of)


def quota_allocation(seeds: DataFrame, axis: str, seed_id: str, quotas: dict[str, int] | None = None) -> DataFrame:
    """Rows to generate per seed: quota ÷ seeds of its axis (at least 1), the remainder to the first seeds.

    Only the first ``max(quota)`` seeds of an axis can be touched by a
    remainder, so no axis is ranked whole.
    """
    quotas = quotas or fv.STRATUM_QUOTAS
    table = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    sizes = seeds.groupBy(axis).agg(F.count("*").alias("__n")).withColumn(
        "__q", F.try_element_at(table, F.col(axis))
    ).filter(F.col("__q").isNotNull())
    plan = sizes.select(
        axis,
        F.greatest(F.lit(1), F.floor(F.col("__q") / F.col("__n"))).alias("__each"),
        F.pmod(F.col("__q"), F.col("__n")).alias("__rest"),
    )
    early = first_rows(seeds.select(axis, seed_id), [axis], [F.asc(seed_id)], max(quotas.values()), "__r")
    out = seeds.join(early, [axis, seed_id], "left").join(plan, axis)
    extra = F.when(F.col("__r") <= F.col("__rest"), 1).otherwise(0)
    return out.withColumn("n_generate", F.col("__each") + extra).drop("__r", "__each", "__rest")


def distribution_audit(rows: DataFrame, stratum: str, location: str, text: str, change_flag: str) -> DataFrame:
    """Per stratum: rows, distinct places, share of change queries, mean length, largest share of one place."""
    by_place = rows.groupBy(stratum, location).agg(
        F.count("*").alias("__n"),
        F.sum(F.col(change_flag).cast("int")).alias("__c"),
        F.sum(F.length(text)).alias("__len"),
    )
    return by_place.groupBy(stratum).agg(
        F.sum("__n").alias("n"),
        F.count(location).alias("distinct_places"),
        F.try_divide(F.sum("__c"), F.sum("__n")).alias("change_ratio"),
        F.try_divide(F.sum("__len"), F.sum("__n")).alias("mean_chars"),
        F.try_divide(F.max(F.when(F.col(location).isNotNull(), F.col("__n"))), F.sum("__n")).alias("largest_place_share"),
    )


def value_histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column (nulls included), the audit's sensor histogram."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def split_overlap(rows: DataFrame, family: str, split: str) -> DataFrame:
    """Families and those found in more than one split."""
    per_family = rows.groupBy(family).agg(F.count_distinct(split).alias("__s"))
    return per_family.agg(F.count("*").alias("families"), F.count_if(F.col("__s") > 1).alias("overlapping"))


def generation_gate(
    checked: DataFrame, stratum: str, quotas: DataFrame, reason: str = "reject_reason", tolerance: float = 0.10
) -> DataFrame:
    """Per stratum: accepted against quota, rejections by reason, verdict within ± tolerance."""
    r = F.col(reason)
    counts = checked.groupBy(stratum).agg(
        F.count("*").alias("raw"),
        F.count_if(r.isNull()).alias("accepted"),
        F.count_if(r == "schema").alias("__schema"),
        F.count_if(r == "label_drift").alias("__drift"),
    )
    out = quotas.select(stratum, "quota").join(counts, stratum, "left")
    raw, accepted = F.coalesce("raw", F.lit(0)), F.coalesce("accepted", F.lit(0))
    return out.select(
        stratum,
        "quota",
        raw.alias("raw"),
        accepted.alias("accepted"),
        F.coalesce(F.try_divide("__schema", "raw"), F.lit(0.0)).alias("schema_rate"),
        F.coalesce(F.try_divide("__drift", "raw"), F.lit(0.0)).alias("drift_rate"),
        (F.abs(accepted - F.col("quota")) <= F.col("quota") * tolerance).alias("passed"),
    )


def rejection_rates(checked: DataFrame, reason: str = "reject_reason") -> DataFrame:
    total = checked.agg(F.count("*")).scalar()
    counts = checked.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.try_divide(F.col("n"), total))


def review_gate(
    reviewed: DataFrame, stratum: str, correct: str, stratum_min: float = 0.95, overall_min: float = 0.98
) -> DataFrame:
    """Correct share per stratum and overall (``stratum`` null), with the verdict at its own limit."""
    rolled = reviewed.filter(F.col(correct).isNotNull()).rollup(stratum).agg(
        F.count("*").alias("reviewed"),
        F.sum(F.col(correct).cast("int")).alias("correct"),
        F.grouping_id().alias("__g"),
    )
    rate = F.try_divide("correct", "reviewed")
    limit = F.when(F.col("__g") == 1, F.lit(overall_min)).otherwise(F.lit(stratum_min))
    scope = F.when(F.col("__g") == 1, "overall").otherwise("stratum")
    return rolled.select(
        scope.alias("scope"), stratum, "reviewed", "correct", rate.alias("rate"), (rate >= limit).alias("passed")
    )


def loss_reconciliation(raw: DataFrame, accepted: DataFrame, rejected: DataFrame, row_id: str) -> DataFrame:
    """raw = accepted + rejected: counts and the unexplained share (at most 0.5 % passes)."""
    seen = (
        raw.select(row_id, F.lit(1).alias("s"))
        .unionByName(accepted.select(row_id, F.lit(2).alias("s")))
        .unionByName(rejected.select(row_id, F.lit(4).alias("s")))
    )
    # one shuffle: which of the three sets hold the id
    per_id = seen.groupBy(row_id).agg(F.bit_or("s").alias("m"))
    m = F.col("m")
    counts = per_id.agg(
        F.count_if(m.bitwiseAND(1) == 1).alias("raw"),
        F.count_if(m.bitwiseAND(2) == 2).alias("accepted"),
        F.count_if(m.bitwiseAND(4) == 4).alias("rejected"),
        F.count_if(m == 1).alias("unexplained"),
    )
    share = F.try_divide("unexplained", "raw")
    return counts.withColumns({"unexplained_share": share, "passed": F.coalesce(share, F.lit(0.0)) <= 0.005})
