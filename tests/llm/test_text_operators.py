"""Line, passage and host operators and the n-gram join against brute force in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import edge_rows
from pyspark.sql import functions as F

from terrafold.llm import graph, host_rules, kernels, line_dedup, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NULL = -(2**63)


def least(i):
    return NULL if i is None else i


def test_line_dedup(edge, empty):
    rows = edge_rows()
    keys = lambda t: [x.strip(" \t\n\x0b\f\r").translate(LOWER) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for r in rows:
        for k in keys(r[1]):
            if len(k) >= 40:
                holders[k].add(least(r[0]))
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [not (len(holders.get(k, ())) >= 5 and max(holders[k]) != least(r[0])) for k in keys(r[1])]
        text = "\n".join(x for x, s in zip(lines, stay) if s)
        want[r[0], text, len(lines), len(lines) - sum(stay), r[2], 6] += 1
    got = line_dedup.dedup_lines(edge).select(
        "doc_id", F.coalesce("text", F.lit("")), "__n_lines", "__n_dropped", "lang", "block"
    ).collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r[3] for r in got) > 10
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_bitmaps_are_compressed(spark):
    lines = [f"line number {i} that only this document has, or not" for i in range(1000)]
    shared = "a line that is in all of the documents, at several places"
    lines[3] = lines[700] = shared
    rows = [(i, "\n".join(lines if i == 0 else [shared])) for i in range(6)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = {r["doc"]: r for r in maps.collect()}
    assert set(found) == {0, 1, 2, 3, 4}
    assert [(w["word"], w["bits"]) for w in found[0]["dropped"]] == [(0, 1 << 3), (700 // 64, 1 << (700 % 64))]


def repeated(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    inside = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
    return len(inside)


def test_host_counts(edge, empty):
    want = Counter()
    for r in edge_rows():
        words = WORD.findall(r[1] or "")
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        n = repeated(words)
        failed = len(words) < 20 or 100 * n > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in r[1] or "")
        want[r[0], len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), n, failed] += 1
    got = host_rules.host_verdicts(edge).drop("host", "host_rate", "kept").collect()
    assert Counter(map(tuple, got)) == want
    assert host_rules.host_verdicts(empty).count() == 0


def test_host_verdicts_shrink(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    texts = [("large", good)] * 60 + [("large", bad)] * 4 + [("farm", bad)] * 50 + [("farm", good)] * 2 + [("small", bad), ("small", good)]
    rows = [(i, t, s) for i, (s, t) in enumerate(texts)]
    got = host_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    rates = {r["host"]: r["host_rate"] for r in got}
    assert rates["large"] < 0.1 and rates["farm"] > 0.85 and abs(rates["small"] - 0.5) < 0.1
    assert {r["host"] for r in got if r["kept"]} <= {"large", "small"}
    n, f = 118, 55
    m = f / n
    v = sum(x * x / k for x, k in ((4, 64), (50, 52), (1, 2))) / n - m * m
    w = min(max(m * (1 - m) / v - 1, 1), 10000)
    assert rates["farm"] == pytest.approx((50 + m * w) / (52 + w))


def test_repeated_units(spark, edge, empty):
    passage = "Every passage of this kind has more than eight words in it. And so has the next sentence of the passage, which ends here."
    rows = [
        (1, "Before it.\n" + passage + "\nAfter the passage comes a line that only this one document has."),
        (2, "Some other words stand in front of the passage in this line. " + passage.upper() + " Then more words follow it."),
        (3, "Short.\nShort.\nOnly one document has this line with its many different words."),
        (4, passage.replace(" ", "  ")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = substring_dedup.repeated_units(df)
    spans = defaultdict(list)
    for r in gone.collect():
        spans[r["doc"]].append((r["start"], r["end"]))
        assert r["first_doc"] == 1
    assert set(spans) == {2, 4}
    for d, found in spans.items():
        text = dict(rows)[d]
        assert all(" ".join(text[a:b].split()).lower() in passage.lower() for a, b in found)
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_units(df, gone).collect()}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1] and kept[4] == ""
    assert kept[2] == "Some other words stand in front of the passage in this line. Then more words follow it."
    assert substring_dedup.repeated_units(empty).count() == 0
    out = substring_dedup.remove_units(edge, substring_dedup.repeated_units(edge))
    assert out.count() == len(edge_rows())


def brute_units(rows, min_words, runs=False, run_words=0):
    """Units of every (id, text), their first holder, and the merged runs, by plain loops."""
    texts = sorted({(i, tag, t) for i, tag, t in rows})
    units = []
    for i, tag, t in texts:
        spans = set(substring_dedup.unit_spans(t))
        if runs:
            lowest = [(a, b) for a, b in sorted(spans) if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
            lowest = [(a, b) for a, b in lowest if t[a:b].split()]
            for k, (a, b) in enumerate(lowest):
                if len(t[a:b].split()) >= min_words:
                    continue
                for step in (1, -1):
                    j = k
                    while 0 <= j < len(lowest) and sum(len(t[c:d].split()) for c, d in lowest[min(j, k) : max(j, k) + 1]) < min_words:
                        j += step
                    if 0 <= j < len(lowest):
                        spans.add((lowest[min(j, k)][0], lowest[max(j, k)][1]))
        for a, b in spans:
            if len(t[a:b].split()) >= min_words:
                before = len(re.findall(r"\S+", t[:a]))
                units.append((i, tag, a, b, before, before + len(t[a:b].split()), " ".join(t[a:b].split()).lower()))
    first = {}
    for i, tag, a, b, _, _, key in sorted(units):
        first.setdefault(key, (i, tag, a, b))
    gone = []
    for i, tag, a, b, w0, w1, key in units:
        f = first[key]
        if f[:2] != (i, tag) or (a >= f[3] if runs else a != f[2]):
            gone.append((i, tag, w0, w1, a, b, f[0], f[2]))
    out, held = set(), defaultdict(list)
    for u in sorted(gone):
        mine = held[u[:2]]
        if mine and u[2] <= max(x[3] for x in mine[-1]):
            mine[-1].append(u)
        else:
            mine.append([u])
    for joined in (x for mine in held.values() for x in mine):
        words = max(u[3] for u in joined) - min(u[2] for u in joined)
        out |= {(i, a, b, d, s, min(u[4] for u in joined), words) for i, _, _, _, a, b, d, s in joined if words >= run_words}
    return out


@pytest.mark.parametrize("runs, run_words", [(False, 0), (True, 0), (True, 12), (False, 20)])
def test_repeated_units_brute_force(spark, runs, run_words):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1 if runs else 5, 12))) + rng.choice(".!?,") for _ in range(25)]
    rows = [(i // 2 if i < 20 else i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += rows[:5] + [(None, r[1]) for r in rows[30:36]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tags = {r["text"]: r["tag"] for r in df.select("text", F.xxhash64("text").alias("tag")).collect()}
    tagged = [(-(2**63) if i is None else i, tags[t], t) for i, t in rows]
    got = substring_dedup.repeated_units(df, min_words=6, runs=runs, run_words=run_words).drop("tag").collect()
    want = brute_units(tagged, 6, runs, run_words)
    assert {tuple(r) for r in got} == want and len(want) > 20


def test_texts_that_share_an_id_keep_what_is_theirs(spark):
    passage = "this passage of more than eight words stands in several documents of the table."
    own = "these words stand in no other document and no part of them may ever be removed."
    rows = [(1, passage), (6, passage), (6, own), (None, passage + "\n" + own[:20]), (None, own[20:]), (6, own), (None, None), (6, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, removed int")
    out = substring_dedup.remove_units(df, substring_dedup.repeated_units(df))
    assert out.columns == ["doc_id", "text", "removed"]
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert kept == Counter([(1, ""), (6, ""), (6, own), (6, own), rows[3], rows[4], (None, None), (6, "")])


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < 3:
        return {tuple(words)}
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least_of = {}
    for i, (d, _) in enumerate(rows):
        least_of[find(i)] = min(least_of.get(find(i), least(d)), least(d))
    return Counter((least(d), len(sets[i]), least_of[find(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_join_edges(edge, empty):
    got = ngram_join.jaccard_classes(edge).select("doc", "n", "component").collect()
    assert Counter(map(tuple, got)) == brute_components([r[:2] for r in edge_rows()])
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_ngram_join_clusters(spark):
    """Near copies on both sides of the threshold, of texts of all lengths, chains included."""
    rng = random.Random(9)
    rows = []
    for length in (5, 12, 13, 25, 60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows.append(base)
        for _ in range(25):
            words = list(base if rng.random() < 0.6 else rng.choice(rows[-10:]))
            for _ in range(rng.randint(0, max(1, length // 40))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"n{rng.randrange(30)}"]
            rows.append(words)
    rng.shuffle(rows)
    rows = [(i * 3, " ".join(w)) for i, w in enumerate(rows)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc", "n", "component")
    want = brute_components(rows)
    assert Counter(map(tuple, got.collect())) == want
    groups = Counter(c for _, _, c in want)
    assert 20 < len(groups) < len(rows) - 20


@pytest.mark.parametrize("classes", [1, 10**4, 10**9])
def test_pigeonhole(classes):
    """Linked sets share a key of which one side is whole, whatever the allocation."""
    rng = np.random.default_rng(3)
    bands = ngram_join.Bands(700, 90)
    plan = bands.allocate([classes] * len(bands.low))
    assert all(a + 2 * b >= h + 1 for (a, b), h in zip(plan, bands.h) if h)
    linked = 0
    for _ in range(400):
        size = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop, add = rng.integers(0, len(a) // 18 + 1), rng.integers(0, len(a) // 18 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) == both == len(b) or 100 * both < 90 * (len(a) + len(b) - both):
            continue
        linked += 1
        ka, kb = ngram_join.keys_of(a, bands, plan), ngram_join.keys_of(b, bands, plan)
        one = np.uint64(1)
        common = set((ka[ka & one == 0] >> one).tolist()) & set((kb >> one).tolist())
        common |= set((ka >> one).tolist()) & set((kb[kb & one == 0] >> one).tolist())
        assert common
    assert linked > 100


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_in_pieces(monkeypatch):
    texts = [r[1] or "" for r in edge_rows()]
    whole, first = kernels.word_hashes([t.encode() for t in texts])
    monkeypatch.setattr(kernels.chunks, "__defaults__", (50,))
    parts, first2 = kernels.word_hashes([t.encode() for t in texts])
    assert (whole == parts).all() and (first == first2).all()
    words = [[w.translate(LOWER) for w in WORD.findall(t)] for t in texts]
    assert np.diff(first).tolist() == list(map(len, words))
    names = {}
    for w, h in zip([w for ws in words for w in ws], whole.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
