"""Divergence audit, lexical search and toxicity against brute force, held-out labels and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from edge import SCHEMA, document, edge_rows
from pyspark.sql import functions as F

from terrafold.llm import divergence, lexical_search, toxicity
from terrafold.llm.common import id_remainder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SF = "/root/testdata/sf0.001"

# ---- divergence ---------------------------------------------------------------


def brute_audit(rows, top=200):
    docs = [(l or "", s or "", LETTERS.findall((t or "").translate(LOWER))) for t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        held = Counter(w for l, _, ws in docs if l == lang for w in set(ws))
        kept = {w for w, n in held.items() if n >= 3}
        counts = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, ws in docs:
            if l == lang:
                counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(shares[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and shares[s][w] > q[w]]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(sorted(terms)[:top], 1)]
    return Counter(out)


def audited(df, **options):
    found = divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank")
    return Counter(map(tuple, found.collect()))


def random_rows():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [f"w{chr(97 + min(int(rng.paretovariate(1.0)), 25))}{rng.choice(['', 'x', 'é', 'Ü'])}" for _ in range(rng.randint(0, 30))]
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(7)}"
        rows.append((rng.choice([" ", "\n", "1", "-"]).join(words), rng.choice(["en", "en", "de", None]), source))
    return rows + [(None, "en", "silent"), ("never told", "xx", "a"), (None, "xx", "b"), ("", None, None)]


@pytest.mark.parametrize("options", [{}, {"cells_of_block": 20, "slice_size": 2}, {"slice_size": 1}, {"top": 3}])
def test_audit_is_brute_force(spark, options):
    rows = random_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    want = brute_audit(rows, options.get("top", 200))
    assert audited(df, **options) == want and sum(want.values()) > 100


def test_audit_of_edges(spark, edge, empty):
    rows = [(r[1], r[2], r[3]) for r in edge_rows()]
    assert audited(edge) == brute_audit(rows)
    assert divergence.audit(empty).count() == 0


def test_shares_without_overflow():
    counts = np.array([0, 1, 7, 10**10, 3 * 10**12])
    for total in (1, 13, 10**12 + 7, 9 * 10**15):
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts] or total < 10**12


def test_identical_subtrees_are_one_node():
    counts = np.tile([0, 3, 0, 0, 0, 3, 0, 0], (3, 4))
    forest = divergence.Forest(counts)
    assert len(set(forest.roots.tolist())) == 1 and sum(len(a) for a, _ in forest.levels) == 6
    left, right, back = forest.walk(0, 1)
    assert len(left) == 2  # 32 pairs of leaves, two priced
    assert divergence.total(left + 1, back) == 32 + 8 * 3


# ---- lexical search -------------------------------------------------------------


def brute_search(docs, items, k=50):
    read = [(d, TERMS.findall((t or "").translate(LOWER))) for d, t in docs]
    n, total = sum(1 for _, ws in read if ws), sum(len(ws) for _, ws in read)
    held = Counter(w for _, ws in read for w in set(ws))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERMS.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, ws in read:
            tf, m = Counter(ws), 50 + (50 * len(ws) * n) // max(total, 1)
            weight = lambda w: math.floor(1000 * math.log((2.0 * n + 2) / (2 * held[w] + 1)))
            score = sum(weight(w) * ((10**9 * tf[w]) // (1000 * tf[w] + 20 * m)) for w in terms if tf[w])
            if score > 0:
                scores.append((-score, -(2**63) if d is None else d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter((-(2**63) if i is None else i, r, d, s) for i, r, d, s in out)


def searched(docs, items, k=50):
    return Counter(map(tuple, lexical_search.search(docs, items, k).select("item", "rank", "doc", "score").collect()))


@pytest.mark.parametrize("documents, leaf", [(4096, 48), (40, 4)])
def test_search_is_brute_force(spark, monkeypatch, documents, leaf):
    monkeypatch.setattr(lexical_search, "DOCUMENTS", documents)
    monkeypatch.setattr(lexical_search, "ITEMS", 9)
    rng = random.Random(9)
    word = lambda: f"t{min(int(rng.paretovariate(0.7)), 400)}"
    docs = [(i // 2 * 2 if i < 20 else i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(None, docs[9][1]), (5, None), (6, "T1 t1-t2.T3")]
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(3, "t5 t6"), (None, "t7 t8 t9"), (77, None), (78, "absent")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 10)
    assert searched(d, i, 10) == want and sum(want.values()) > 150


def test_search_of_edges(spark, edge, empty):
    items = [(1, "this is a line that many documents share"), (2, "quick brown"), (None, "word"), (4, ""), (5, None)]
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("doc", F.lit(2))
    assert searched(edge, i) == brute_search([(r[0], r[1]) for r in edge_rows()], items)
    assert lexical_search.search(empty, i).count() == 0
    assert lexical_search.search(edge, i.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):  # two groups of texts with few terms in common
        columns = np.sort(rng.choice(50, 12, replace=False)) + (50 if k % 2 else 0)
        rows.append((columns, rng.integers(1, 10**6, 12)))
    first = np.arange(0, 12 * 300 + 1, 12)
    table = lexical_search.Rows(first, np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]))
    tree = lexical_search.BallTree(table, 100, leaf=8)
    columns, weights = np.arange(50, 60), rng.integers(1, 20000, 10)
    dense = np.zeros(100, dtype=np.int64)
    dense[columns] = weights
    scores = table.times(dense)
    bounds = tree.bounds(columns, weights)
    for node, (a, b) in enumerate(tree.spans):
        assert bounds[node] >= scores[tree.order[a:b]].max()
    at, found, opened = tree.best(columns, weights, 5, 1)
    assert sorted(found)[-5:] == sorted(scores)[-5:] and (scores[at] == found).all()
    assert opened < sum(c is None for c in tree.children) // 2 + 1


# ---- toxicity -------------------------------------------------------------------


def test_windows_hold_all_words():
    text = "Über " + "word " * 50 + "x" * 3000 + " End!"
    found = toxicity.windows(text)
    assert b"".join(found).replace(b" ", b"") == ("über" + "word" * 50 + "x" * 3000 + "end").encode() or len(found) > 5
    assert max(map(len, found)) <= toxicity.LONGEST + 1
    assert toxicity.windows(None) == toxicity.windows(" 12 ?!") == []


def toxic_rows(spark, n=1200):
    rng = random.Random(2)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "er")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["zwark", "quexnot", "vlimpish", "jyxxer"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        if i % 5 == 0:
            for _ in range(2 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_texts_are_told_from_others(spark):
    df = toxic_rows(spark)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), id_remainder("doc_id", 5) != 0)
    got = toxicity.with_toxicity(df, model).filter(id_remainder("doc_id", 5) == 0).toPandas()
    told = got["score"] >= toxicity.THRESHOLD
    assert told[got["toxic"] == 1].mean() >= 0.9 and (~told[got["toxic"] == 0]).mean() >= 0.95
    again = toxicity.train(df.repartition(7), df.select("doc_id", "toxic").repartition(3), id_remainder("doc_id", 5) != 0)
    assert again.token == model.token


def test_toxicity_of_edges(spark, edge, empty):
    df = toxic_rows(spark, 200)
    model = toxicity.train(df, df, F.lit(True))
    rows = toxicity.with_toxicity(edge, model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    quiet = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(quiet) == 1
    assert toxicity.with_toxicity(empty, model).count() == 0
    for labels, share in (([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 7), (None, 1), (4, None)], 0.5)):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        flat = toxicity.train(edge, known, F.lit(True))
        scores = {round(r["score"], 9) for r in toxicity.with_toxicity(edge, flat).collect()}
        assert len(scores) == 1 and (share == 0.5) == (scores == {0.5})
    few = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.with_toxicity(edge, toxicity.train(edge, few, F.lit(True))).count() == len(edge_rows())


def test_names_of_extra_columns(spark):
    df = spark.createDataFrame([document(1, "some text")], SCHEMA)
    assert toxicity.with_toxicity(df, toxicity.fit([], np.array([], dtype=int)), name="n").columns == df.columns
