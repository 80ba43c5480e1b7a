"""Order statistics of large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import selection
from terrafold.operators.selection import exact_percentiles, rank_brackets

PROBS = [0.0, 0.005, 0.37, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("bound", [40, 500, 10**6])
@pytest.mark.parametrize("shape", ["spread", "ties", "far", "one"])
def test_percentiles_of_large_groups(spark, bound, shape):
    rng = np.random.default_rng(5)
    n = 6000
    values = {
        "spread": rng.lognormal(size=n),
        "ties": rng.integers(0, 7, n).astype(float),
        "far": np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-300, 300, n),
        "one": np.full(n, 3.25),
    }[shape]
    rows = [("a", float(x)) for x in values] + [("b", float(x)) for x in values[:30]] + [("c", None), ("a", None), ("a", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k, r.prob): (r.n, r.percentile) for r in exact_percentiles(df, ["k"], "v", PROBS, bound).collect()}
    assert {k for k, _ in got} == {"a", "b"}
    for key, held in (("a", values), ("b", values[:30])):
        for p in PROBS:
            assert got[key, p][0] == len(held)
            assert got[key, p][1] == pytest.approx(np.percentile(held, p * 100), rel=1e-12)
    alone = {r.prob: r.percentile for r in exact_percentiles(df.filter("k = 'a'"), [], "v", PROBS, bound).collect()}
    assert alone == {p: got["a", p][1] for p in PROBS}


def test_no_task_sorts_more_than_the_bound(spark):
    """Three million distinct values in one group; what is left to sort is a few thousand rows a rank."""
    bound = 5000
    df = spark.range(3_000_000).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(2**40)) + F.col("id") / 2**23).alias("v"))
    groups = df.groupBy("k").agg(F.count("*").alias("__n"), F.min("v").alias("__min"), F.max("v").alias("__max"))
    state, members = rank_brackets(df, groups, ["k"], "v", [0.5, 0.95], bound)
    row = state.first()
    assert all(0 < row[f"inside{i}"] <= bound for i in range(4)) and members.count() <= 4 * bound
    got = {r.prob: r.percentile for r in exact_percentiles(df, ["k"], "v", [0.5, 0.95], bound).collect()}
    want = df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert [got[0.5], got[0.95]] == pytest.approx(want, rel=1e-12)


def test_a_wrong_sketch_costs_time_only(spark, monkeypatch):
    monkeypatch.setattr(selection, "_sketch", lambda value: F.array(*[F.max(value) for _ in range(selection.GRID + 1)]))
    monkeypatch.setattr(selection, "MOST_ROUNDS", 2)
    rng = random.Random(1)
    values = [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.percentile for r in exact_percentiles(df, [], "v", [0.25], 50).collect()]
    assert got == pytest.approx([np.percentile(values, 25)], rel=1e-12)
    assert exact_percentiles(df.limit(0), [], "v", [0.5]).count() == 0
