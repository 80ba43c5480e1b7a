"""N-gram counts of a batch against plain counting."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.functions import grams
from terrafold.operators import evalkit as ev


def tokens(text, punctuation):
    text = text or ""
    if punctuation:
        text = re.sub(r"([.!?,])", r" \1 ", text)
    return [t for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t]


def plain(reference, prediction, punctuation, distinct):
    out = {}
    r, p = tokens(reference, punctuation), tokens(prediction, punctuation)
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, p))
        if distinct:
            a, b = Counter(set(a)), Counter(set(b))
        out |= {f"m{n}": sum((a & b).values()), f"t{n}": sum(b.values()), f"r{n}": sum(a.values())}
    return out | {"same": r == p}


def rows_of_texts(n=1500):
    rng = random.Random(7)
    words = ["a", "b", "ab", "é", "漢字", "x.y", "...", "a,b", "end!", "ü?"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", ""]) for _ in range(rng.randint(0, 25)))
    rows = []
    for _ in range(n):
        r = text()
        rows.append((r, rng.choice([r, r + " ", text(), "", r.replace("a", "b"), r[::-1]])))
    return rows


@pytest.mark.parametrize("punctuation, distinct", [(True, False), (False, True), (True, True)])
@pytest.mark.parametrize("size", [4_000_000, 300])
def test_counts(monkeypatch, punctuation, distinct, size):
    monkeypatch.setattr(grams, "BYTES", size)
    rows = rows_of_texts()
    reference, prediction = (pa.array([r[k] for r in rows]) for k in (0, 1))
    got = grams.batch_counts(reference.slice(3), prediction.slice(3), punctuation, distinct).to_pylist()
    assert got == [plain(r, p, punctuation, distinct) for r, p in rows[3:]]
    assert len(grams.batch_counts(reference.slice(0, 0), prediction.slice(0, 0), punctuation, distinct)) == 0


def test_long_texts_and_nulls(spark):
    rng = random.Random(1)
    long = " ".join(f"w{min(int(rng.paretovariate(0.6)), 5000)}" for _ in range(200_000))
    rows = [(1, long, long[1000:]), (2, None, "x"), (3, "x", None), (4, None, None), (5, "A b. C", "a B . c"), (6, "", " ")]
    df = spark.createDataFrame(rows, "id int, reference string, prediction string")
    counted = df.select("id", grams.overlap(F.col("reference"), F.col("prediction"), True).alias("n")).collect()
    assert {r["id"]: r["n"].asDict() for r in counted} == {i: plain((a or "").lower(), (b or "").lower(), True, False) for i, a, b in rows}
    scores = {r["id"]: (r["bleu4"], r["f1"], r["exact_match"]) for r in ev.answer_scores(df, "id").collect()}
    assert scores[2] == scores[3] == (0.0, 0.0, 0.0) and scores[5][1:] == (1.0, 1.0) and scores[6] == scores[4] == (0.0, 0.0, 1.0)
    assert df.select(ev.bleu_set(F.col("reference"), F.col("prediction")).alias("b")).filter("b > 0.9").count() == 1


def test_scores_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, reference string, prediction string")
    plan = ev.answer_scores(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
