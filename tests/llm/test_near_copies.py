"""Near copies on five-word shingles at 80 in 100, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from test_text_operators import LOWER, WORD

import corpus_pipeline
from terrafold.llm import ngram_join


def brute_least(rows, n, percent):
    sets = []
    for _, t in rows:
        words = WORD.findall(t.translate(LOWER))
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited_rows():
    """Texts of many lengths with copies edited at up to 4 words in 100, chains and a passage that all share."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for length in (1, 3, 4, 5, 6, 9, 12, 25, 60, 100, 100, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)] + (shared if length == 60 else [])
        rows.append(base)
        for _ in range(20):
            words = list(base if rng.random() < 0.6 else rng.choice(rows[-8:]))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"n{rng.randrange(30)}"]
            rows.append(words)
    rows += [[f"u{k}x{i}" for i in range(10)] + shared for k in range(40)]
    rng.shuffle(rows)
    return [(i * 3, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("rare", [True, False])
def test_classes_of_five_words(spark, rare):
    rows = edited_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_classes(df, n=5, percent=80, rare=rare).select("doc", "n", "component").collect()
    want = brute_least(rows, 5, 80)
    assert Counter(map(tuple, got)) == want
    assert 40 < len({c for _, _, c in want}) < len(rows) - 40


def test_rare_keys_at_other_thresholds(spark):
    rows = edited_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (2, 55)):
        got = ngram_join.jaccard_classes(df, n=n, percent=percent, rare=True).select("doc", "n", "component").collect()
        assert Counter(map(tuple, got)) == brute_least(rows, n, percent)


def test_stage_drops_edited_copies(spark):
    """Two edits far apart, or four in a run, in 100 words: over 80 on five words, under 90 on three."""
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base))]
    for k, places in enumerate([(20, 70), (10, 50), (40, 41, 42, 43)], 2):
        rows.append((k, " ".join(f"e{k}" if i in places else w for i, w in enumerate(base))))
    rows.append((9, " ".join(f"e{i}" if i in (10, 40, 70) else w for i, w in enumerate(base))))
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c in brute_least(rows, 5, 80)}) == [1, 9]


@pytest.mark.parametrize("hits, bits", [(2, 64), (3, 2), (10**9, 1)])
def test_common_elements_and_shared_digest_halves(spark, monkeypatch, hits, bits):
    """Elements of very many sets as keys of their own, and classes that agree in 64 bits of their digest."""
    whole = ngram_join.digest
    monkeypatch.setattr(ngram_join, "SAMPLE_HITS", hits)
    monkeypatch.setattr(ngram_join, "digest", lambda s: (whole(s)[0] >> (64 - bits), whole(s)[1]))
    rows = edited_rows()
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(30)]
    rows += [(2000 + k, " ".join(shared[rng.randrange(3) :] + [f"z{k}"] * rng.randint(0, 1))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_classes(df, n=5, percent=80, rare=True).select("doc", "n", "component").collect()
    assert Counter(map(tuple, got)) == brute_least(rows, 5, 80)


def test_stage_runs_the_method_of_op6(spark, monkeypatch):
    """Near copies of the pipeline meet by segments of their sets, not by rare elements."""
    ran, segments = [], ngram_join.segment_keys
    monkeypatch.setattr(ngram_join, "rare_keys", None)
    monkeypatch.setattr(ngram_join, "segment_keys", lambda *a: ran.append(a[3:5]) or segments(*a))
    rows = edited_rows()[:60]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert ran == [(5, 80)] and {r["doc_id"] for r in got} == {c for _, _, c in brute_least(rows, 5, 80)}


@pytest.mark.parametrize("n, percent", [(5, 80), (3, 70)])
def test_spare_segments(spark, n, percent):
    """Schemes with spare segments give the classes of brute force, for null, shared and repeated ids too."""
    rows = edited_rows()
    rows += [(None, rows[0][1]), (None, rows[1][1] + " more"), (rows[2][0], rows[3][1]), rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old, new = (ngram_join.jaccard_classes(df, n=n, percent=percent, spare=s).select("doc", "tag", "n", "component").collect() for s in (False, True))
    assert Counter(map(tuple, new)) == Counter(map(tuple, old))
    df = spark.createDataFrame(edited_rows(), "doc_id long, text string")
    got = ngram_join.jaccard_classes(df, n=n, percent=percent, spare=True).select("doc", "n", "component").collect()
    assert Counter(map(tuple, got)) == brute_least(edited_rows(), n, percent)


def test_spare_segments_are_few_keys():
    """A set gives at most H + 1 keys to each of two schemes; linked sets share one at least."""
    rng = np.random.default_rng(3)
    bands = ngram_join.Bands(2000, 80)
    plan = bands.allocate([5000] * len(bands.low), True)
    fewer = sum(ngram_join.keys_of(np.arange(1, n, dtype=np.uint64), bands, plan).size for n in range(100, 400))
    more = sum(ngram_join.keys_of(np.arange(1, n, dtype=np.uint64), bands, bands.allocate([5000] * len(bands.low))).size for n in range(100, 400))
    assert fewer < more / 3
    for n in list(range(4, 60)) + [150, 400, 1500]:
        s = rng.integers(1, 2**63, n).astype(np.uint64)
        t = np.concatenate([s[: n - n // 10], rng.integers(1, 2**63, n // 9).astype(np.uint64)])
        while 100 * len(np.intersect1d(s, t)) < 80 * len(np.union1d(s, t)):
            t = np.append(t, s[len(np.intersect1d(s, t))])
        keys = [ngram_join.keys_of(np.unique(x), bands, plan) for x in (s, t)]
        if len(np.setxor1d(s, t)):
            assert len(np.intersect1d(*(k >> np.uint64(1) for k in keys)))
        assert len(keys[0]) <= sum(bands.h[b] + 1 for b in (bands.of(n), max(bands.of(n) - 1, 0))) or n < 60


def test_sets_do_not_travel(spark, monkeypatch):
    """The sets of all near copies were written to disk and shuffled to both sides of a pair, 8 bytes a shingle; now texts are."""
    made, plain = [], ngram_join.set_arrays
    monkeypatch.setattr(ngram_join, "set_arrays", lambda df, row_id, text, make, name, *more: made.append(name) or plain(df, row_id, text, make, name, *more))
    rows = edited_rows()[:150]
    df = spark.createDataFrame(rows + [(None, rows[0][1] + " more"), (rows[3][0], rows[4][1]), (rows[5][0], rows[5][1])], "doc_id long, text string")
    for spare in (True, False):
        got = ngram_join.jaccard_classes(df, n=5, percent=80, spare=spare).filter("doc >= 0").select("doc", "tag").count()
        assert got == len(rows) + 2
    assert made == ["keys", "keys"]
