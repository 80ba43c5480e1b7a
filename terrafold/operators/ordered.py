"""Ordered computations that stay balanced when one key holds much of the data.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task. The helpers here cut each key into chunks that follow the order, run the
window inside the chunk, and carry the small per-chunk summary across chunks. Chunks
are balanced by rows (``balanced_chunks``) or follow a column that spreads evenly
(a hash prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize


#: Rows of a key that one task may order.
ROWS_PER_CHUNK = 1_000_000


def _same_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(other[f"__h_{k}"])
    return on


def balanced_chunks(df: DataFrame, keys: list[str], order: list[str], rows: int = ROWS_PER_CHUNK, always: bool = True) -> DataFrame:
    """Add ``__chunk``: numbers that grow along the order of each key, none for more than ``rows`` rows of a key.
    Without ``always`` there is no such column where all keys are one chunk.

    Keys of up to ``rows`` rows, usually all, are one chunk and cost a count that combines on the map side.
    The rows of larger keys are range-partitioned by key and order, so that the edges follow where the rows really are:
    a million rows of one hour, or of one instant, are as many chunks as a million rows of a year. The pieces are counted
    and made smaller while one is too large; only rows that agree in key and order cannot be told apart.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > rows)
    hot = materialize(sizes.withColumnsRenamed({k: f"__h_{k}" for k in keys}))
    total = hot.agg(F.sum("__n")).first()[0]
    if not total:
        return df.withColumn("__chunk", F.lit(0)) if always else df
    busy = df.join(hot, _same_keys(df, hot, keys), "left_semi")
    rest = df.join(hot, _same_keys(df, hot, keys), "left_anti").withColumn("__chunk", F.lit(0))
    pieces = 2 * -(-total // rows)
    for _ in range(4):
        ranged = busy.repartitionByRange(pieces, *keys, *order).withColumn("__chunk", F.spark_partition_id())
        ranged = materialize(ranged)
        largest = ranged.groupBy(*keys, "__chunk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if largest <= rows:
            break
        pieces *= 4
    return rest.unionByName(ranged)


def _join_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Left join a (keys, chunk) summary, matching null keys."""
    names = [*keys, "__chunk"]
    renamed = summary.withColumnsRenamed({n: f"__s_{n}" for n in names})
    on = [df[n].eqNullSafe(renamed[f"__s_{n}"]) for n in names]
    return df.join(renamed, on, "left").drop(*[f"__s_{n}" for n in names])


def with_running_sum(
    df: DataFrame, keys: list[str], chunk: Column, order: list, value: Column, name: str
) -> DataFrame:
    """Running total of ``value`` per key up to and including the row."""
    base = df.withColumns({"__chunk": chunk, "__value": value})
    totals = base.groupBy(*keys, "__chunk").agg(F.sum("__value").alias("__total"))
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__chunk", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = _join_summary(base, offsets, keys)
    return out.withColumn(name, F.col("__offset") + F.sum("__value").over(inside)).drop(
        "__chunk", "__value", "__offset"
    )


def with_rank(df: DataFrame, keys: list[str], chunk: Column, order: list, name: str) -> DataFrame:
    """1-based rank per key."""
    return with_running_sum(df, keys, chunk, order, F.lit(1), name)


def with_range_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based rank per key in any order, for keys of any size.

    Rows are range-partitioned by keys and order, so a large key spreads over many
    partitions, which then are the chunks. They are cut, as partition numbers must not change.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    return with_rank(materialize(ranged), keys, F.col("__range"), order, name).drop("__range")


def with_neighbours(df: DataFrame, keys: list[str], time: str, row_id: str, before: str | None, after: str | None) -> DataFrame:
    """Add the ``struct<time, id>`` of the previous and/or next row of the key. ``__chunk`` of ``df`` stays; without it a key is one chunk."""
    item = F.struct(F.col(time).alias("time"), F.col(row_id).alias("id"))
    if "__chunk" not in df.columns:
        # plain windows, which Spark leaves out where nobody reads the columns
        whole = W.partitionBy(*keys).orderBy(time, row_id)
        found = {before: F.lag(item).over(whole), after: F.lead(item).over(whole)}
        return df.withColumns({name: value for name, value in found.items() if name})
    edges = df.groupBy(*keys, "__chunk").agg(F.min(item).alias("__first"), F.max(item).alias("__last"))
    across = W.partitionBy(*keys).orderBy("__chunk")
    edges = edges.select(
        *keys,
        "__chunk",
        F.lag("__last").over(across).alias("__before"),
        F.lead("__first").over(across).alias("__after"),
    )
    inside = W.partitionBy(*keys, "__chunk").orderBy(time, row_id)
    out = _join_summary(df, edges, keys)
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(item).over(inside), F.col("__before")))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead(item).over(inside), F.col("__after")))
    return out.drop("__before", "__after")


def with_last_known(df: DataFrame, keys: list[str], time: str, row_id: str, columns: dict[str, str]) -> DataFrame:
    """For each ``source -> target`` add the last non-null ``source`` of the key's earlier rows. ``df`` has ``__chunk``, which stays."""
    order = F.struct(F.col(time), F.col(row_id))
    latest = df.groupBy(*keys, "__chunk").agg(
        *[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), order)).alias(f"__l_{s}") for s in columns]
    )
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = latest.select(
        *keys, "__chunk", *[F.last(f"__l_{s}", ignorenulls=True).over(earlier).alias(f"__c_{s}") for s in columns]
    )
    inside = W.partitionBy(*keys, "__chunk").orderBy(time, row_id).rowsBetween(W.unboundedPreceding, -1)
    out = _join_summary(df, carried, keys)
    return out.withColumns(
        {t: F.coalesce(F.last(s, ignorenulls=True).over(inside), F.col(f"__c_{s}")) for s, t in columns.items()}
    ).drop(*[f"__c_{s}" for s in columns])


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts every input partition to ``n`` per key before the shuffle
    (WindowGroupLimit), so a large key does not reach one task whole."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def _match_keys(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Many-to-one join on non-null keys."""
    return rows.join(other, keys)


def with_group_stats(df: DataFrame, keys: list[str], stats: list[Column]) -> DataFrame:
    """Attach per-group aggregates to every row: a map-side combined aggregate joined back on the keys."""
    return _match_keys(df, df.groupBy(*keys).agg(*stats), keys)


def hash_order(key: Column, seed: str) -> Column:
    """Stable pseudo-random order of rows: md5 of key and seed, the same at any partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def with_hash_rank(df: DataFrame, keys: list[str], row_id: str, seed: str, name: str, digits: int = 3) -> DataFrame:
    """1-based rank of each row in the hash order of its group."""
    hashed = df.withColumn("__h", hash_order(F.col(row_id), seed))
    return with_rank(hashed, keys, F.substring("__h", 1, digits), ["__h", row_id], name).drop("__h")
