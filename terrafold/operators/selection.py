"""Exact order statistics of large groups without sorting them.

``percentile()`` holds one map of all values of a group, and a sorted window sends a group to
one task. Here a large group is narrowed down to the neighbourhood of each wanted rank. A round
makes, in one aggregation that combines on the map side, a quantile sketch of the values inside
each rank's bracket; the sketch proposes a bracket about a hundredth as large, and the next
round counts exactly how many values lie below and inside it before it is believed. Values
outside all brackets are dropped in between. When no bracket holds more than a fixed number of
rows, what is left is sorted. No task sees more than that of a group, however large the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

#: Rows of a group (or inside a bracket) that one task may sort.
ROWS = 100_000
#: Quantiles of the sketch and its accuracy; the margin of a proposed bracket, in quantiles.
GRID, ACCURACY, MARGIN = 128, 2048, 1
#: A round shrinks a bracket to about a fortieth; so many rounds suffice for any number of rows.
MOST_ROUNDS = 12


def _sketch(value: Column) -> Column:
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.percentile_approx(value, grid, F.lit(ACCURACY))


def _proposed(rank: Column, inside: Column, low: Column, high: Column, grid: Column) -> tuple[Column, Column]:
    """The bracket around a rank (counted from the bracket's own first value) by the sketch."""
    at = rank / F.greatest(inside - 1, F.lit(1)) * GRID
    first, last = (F.floor(at) - MARGIN).cast("int"), (F.ceil(at) + MARGIN).cast("int")
    new_low = F.when(first <= 0, low).otherwise(F.get(grid, F.greatest(first, F.lit(0))))
    new_high = F.when(last >= GRID, high).otherwise(F.get(grid, F.least(last, F.lit(GRID))))
    return F.coalesce(new_low, low), F.coalesce(new_high, high)


def _targets(n: Column, probs: list[float]) -> list[Column]:
    """Ranks (from 0) of the values around each wanted position."""
    return [f(F.lit(float(p)) * (n - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)]


def rank_brackets(
    rows: DataFrame, large: DataFrame, keys: list[str], value: str, probs: list[float], most: int
) -> tuple[DataFrame, DataFrame]:
    """Brackets of every wanted rank of the groups ``large`` (``keys, __n, __min, __max``), and the rows inside them.

    The state has, per rank ``i``, ``low{i}, high{i}`` (both inside), ``below{i}`` and ``inside{i}``.
    """
    v = F.col(value)
    size = 2 * len(probs)
    ranks = _targets(F.col("__n"), probs)
    members = materialize(rows.join(large.select(*keys), keys, "left_semi"))
    grids = members.groupBy(*keys).agg(_sketch(v).alias("__grid"))
    state = large.join(grids, keys)
    columns = {}
    for i in range(size):
        nl, nh = _proposed(ranks[i], F.col("__n"), F.col("__min"), F.col("__max"), F.col("__grid"))
        columns |= {f"low{i}": F.col("__min"), f"high{i}": F.col("__max"), f"below{i}": F.lit(0).cast("long"), f"inside{i}": F.col("__n"), f"nl{i}": nl, f"nh{i}": nh}
    names = [f"{c}{i}" for i in range(size) for c in ("low", "high", "below", "inside", "nl", "nh")]
    state = materialize(state.withColumns(columns).select(*keys, "__n", *names))
    for _ in range(MOST_ROUNDS):
        met = members.join(state, keys)
        sums = []
        for i in range(size):
            within = (v >= F.col(f"nl{i}")) & (v <= F.col(f"nh{i}"))
            sums += [
                F.count_if((v >= F.col(f"low{i}")) & (v < F.col(f"nl{i}"))).alias(f"before{i}"),
                F.count_if(within).alias(f"held{i}"),
                _sketch(F.when(within, v)).alias(f"grid{i}"),
            ]
        found = state.join(met.groupBy(*keys).agg(*sums), keys)
        columns = {}
        for i in range(size):
            below = F.col(f"below{i}") + F.col(f"before{i}")
            # a sketch may err; a bracket that misses its rank is not taken, and the sort at the end is larger
            hit = (ranks[i] >= below) & (ranks[i] < below + F.col(f"held{i}"))
            taken = {
                "low": F.when(hit, F.col(f"nl{i}")).otherwise(F.col(f"low{i}")),
                "high": F.when(hit, F.col(f"nh{i}")).otherwise(F.col(f"high{i}")),
                "below": F.when(hit, below).otherwise(F.col(f"below{i}")),
                "inside": F.when(hit, F.col(f"held{i}")).otherwise(F.col(f"inside{i}")),
            }
            nl, nh = _proposed(ranks[i] - taken["below"], taken["inside"], taken["low"], taken["high"], F.col(f"grid{i}"))
            columns |= {f"{c}{i}": x for c, x in taken.items()}
            columns |= {f"nl{i}": F.when(hit, nl).otherwise(F.col(f"low{i}")), f"nh{i}": F.when(hit, nh).otherwise(F.col(f"high{i}"))}
        state = materialize(found.select(*keys, "__n", *[columns[n].alias(n) for n in names]))
        members = members.join(state, keys)
        inside = reduce(lambda a, b: a | b, [(v >= F.col(f"low{i}")) & (v <= F.col(f"high{i}")) for i in range(size)])
        members = materialize(members.filter(inside).select(*keys, value))
        # a bracket of one value holds no rows that must be sorted
        widest = F.greatest(*[F.when(F.col(f"low{i}") < F.col(f"high{i}"), F.col(f"inside{i}")).otherwise(0) for i in range(size)], F.lit(0))
        if (state.agg(F.max(widest)).first()[0] or 0) <= most:
            break
    return state, members


def _picked(counted: DataFrame, groups: list[str], rank: dict[str, Column], value: str, keep: list[str]) -> DataFrame:
    """The values at ranks (from 0) of groups of ``value, __c``."""
    order = W.partitionBy(*groups).orderBy(value)
    upto = counted.withColumn("__upto", F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, 0)))
    at = {n: F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__c") <= r), F.col(value))) for n, r in rank.items()}
    return upto.groupBy(*groups, *keep).agg(*[c.alias(n) for n, c in at.items()])


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], rows_per_task: int = ROWS
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per (key, prob): ``keys, prob, n, percentile``.

    Null and NaN values do not count; rows with a null key are left out, groups without values too. Groups of up
    to ``rows_per_task`` rows are sorted, larger ones narrowed down first.
    """
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    v = F.col(value).cast("double")
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("__k0")]
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keyed, v.alias("__v"))
    groups = rows.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    groups = materialize(groups.dropna(subset=names))
    large = groups.filter(F.col("__n") > rows_per_task)
    ranks = _targets(F.col("__n"), probs)
    wanted = {f"at{i}": r for i, r in enumerate(ranks)}
    small = rows.join(groups.filter(F.col("__n") <= rows_per_task).select(*names, "__n"), names)
    counted = small.groupBy(*names, "__n", "__v").agg(F.count("*").alias("__c"))
    found = _picked(counted, names, wanted, "__v", ["__n"])
    if large.head(1):
        state, members = rank_brackets(rows, large, names, "__v", probs, rows_per_task)
        met = members.join(state, names)
        spans = F.array(*[
            F.struct(
                F.lit(i).alias("i"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), (ranks[i] - F.col(f"below{i}")).alias("rank")
            )
            for i in range(len(ranks))
        ])
        holds = lambda s: (s["low"] < s["high"]) & (F.col("__v") >= s["low"]) & (F.col("__v") <= s["high"])
        met = met.select(*names, "__v", F.explode(F.filter(spans, holds)).alias("__s"))
        counted = met.groupBy(*names, F.col("__s.i").alias("__i"), F.col("__s.rank").alias("__rank"), "__v").agg(F.count("*").alias("__c"))
        one = _picked(counted, [*names, "__i"], {"__at": F.col("__rank")}, "__v", ["__rank"])
        wide = one.groupBy(*names).agg(*[F.max(F.when(F.col("__i") == i, F.col("__at"))).alias(f"__w{i}") for i in range(len(ranks))])
        exact = [F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise(F.col(f"__w{i}")).alias(f"at{i}") for i in range(len(ranks))]
        found = found.unionByName(state.join(wide, names, "left").select(*names, "__n", *exact))
    pairs = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col(f"at{2 * i}").alias("lo"), F.col(f"at{2 * i + 1}").alias("hi"))
        for i, p in enumerate(probs)
    ])
    told = found.select(*names, F.col("__n").alias("n"), F.explode(pairs).alias("__p"))
    share = F.col("__p.prob") * (F.col("n") - 1)
    share = share - F.floor(share)
    span = F.col("__p.hi") - F.col("__p.lo")
    # from the nearer end, so that a share of almost 1 gives the upper value itself
    between = F.when(share < 0.5, F.col("__p.lo") + span * share).otherwise(F.col("__p.hi") - span * (1 - share))
    between = F.when(F.col("__p.lo") == F.col("__p.hi"), F.col("__p.lo")).otherwise(between)
    return told.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("__p.prob").alias("prob"), "n", between.alias("percentile"))
