"""Quality rules with host verdicts.

Each text gets its base counts within its own row (array functions only, no
explode). Failures of the base rules are summed per host, the hosts' rates are
shrunk towards the overall rate with a beta prior fitted to all hosts by the
method of moments, and hosts above ``max_rate`` lose all their documents.

Only counts are shuffled. They are cut once, since both the sums and the join
back read them. A host with a third of the rows is summed on the map side and
its side of the join can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, WORD, cut, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 10000.0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes of 64-bit word hashes, within one text.
    Only texts with a repeated window sort their windows.
    """
    zero = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        after = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
        steps = F.zip_with(starts, after, lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(steps, zero, lambda total, n: total + n)

    def of_sorted(pairs: Column) -> Column:
        after = F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0)))
        same = F.zip_with(pairs, after, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

        def starts(flags: Column) -> Column:
            found = F.transform(
                pairs,
                lambda x, i: F.when(F.get(flags, i) | ((i > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False))), x["i"]),
            )
            return F.array_sort(F.filter(found, lambda p: p.isNotNull()))

        return let(let(same, starts), covered)

    def of_windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(pairs, of_sorted))

    def of_hashes(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (window - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, window))), of_windows)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(hashed, of_hashes)).otherwise(zero)


def base_counts(text: Column) -> Column:
    """Struct ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text (null: all zero)."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0)
    duplicates = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            duplicates.cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def host_rates(docs: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, failures, host_rate``: failure rates shrunk towards the overall rate.

    With hosts of ``n`` documents and rate ``r``, overall rate ``m`` and the
    document-weighted variance ``v`` of ``r`` around ``m``, the prior weighs
    ``m (1 - m) / v - 1`` documents, kept within ``PRIOR_WEIGHT``.
    """
    sums = docs.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    moments = sums.agg(
        F.sum("n").alias("n"),
        F.sum("failures").alias("f"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("rr"),
    )
    m = F.col("f") / F.col("n")
    moments = moments.select(m.alias("m"), (F.col("rr") / F.col("n") - m * m).alias("v"))
    low, high = PRIOR_WEIGHT
    weight = F.when(F.col("v") > 1e-12, F.least(F.lit(high), F.greatest(F.lit(low), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    prior = moments.agg(
        F.first(F.struct(F.col("m").alias("m"), F.coalesce(weight, F.lit(high)).alias("w"))).alias("prior")
    ).scalar()
    shrunk = (F.col("failures") + F.col("prior.m") * F.col("prior.w")) / (F.col("n") + F.col("prior.w"))
    return sums.withColumn("prior", prior).select(host, "n", "failures", shrunk.alias("host_rate"))


def host_verdicts(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """One row per row of ``df``: id, counts, ``base_failed``, ``host_rate``, ``kept``.

    Null texts have no words and so fail. Rows without a host share one. Repeated
    rows are counted and returned as often as they come; other columns are not read.
    An empty table gives an empty result.
    """
    features = df.select(
        F.col(row_id).alias("doc_id"), F.col(host).alias("host"), base_counts(F.col(text)).alias("c")
    ).select("doc_id", "host", "c.*")
    features = cut(features.withColumn("base_failed", base_failed()))
    rates = host_rates(features, "host", "base_failed").select(F.col("host").alias("__host"), "host_rate")
    joined = features.join(rates, features["host"].eqNullSafe(rates["__host"]), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
