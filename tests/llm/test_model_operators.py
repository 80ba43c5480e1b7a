"""Classifier, language identification, tokens, search, chat and mixing."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from edge import WORDS, edge_rows
from oracle_check import duck
from pyspark.sql import functions as F

from terrafold.llm import bpe_duckdb, chat_trees, language_id, mixing, quality_fm, queries, topk_search

SF = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


# ---- tokens -----------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = bpe_duckdb.load_ranks(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_random_texts(reference):
    rng = random.Random(5)
    parts = ["'s", "'t", "'re", "'ll", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "ß", "漢", "字", "١", "Ⅷ", "'",
             '"', "-", "a", "bc", "The", " don't", "9", "12", "\U0001f600", "​", "́", "\x00", "<|endoftext|>", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 400, "=" * 20000, "漢字" * 200, "".join(rng.choices("abcdefghijkLMNOP", k=1500))]
    bpe = bpe_duckdb.coder(queries.RANKS, queries.PATTERN)
    coded = [x for some in bpe_duckdb.slices([t.encode() for t in texts], 20_000) for x in bpe.encode(some)]
    for text, ids in zip(texts, coded):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text[:80]
    assert [b.decode() for b in bpe.decode(coded)] == texts


def test_bpe_small_memo(reference, monkeypatch):
    monkeypatch.setattr(bpe_duckdb, "MEMO", 10)
    bpe = bpe_duckdb.ByteBpe(bpe_duckdb.load_ranks(queries.RANKS), queries.PATTERN)
    for text in ("one two three four five six seven eight nine ten eleven twelve", "two three", "one two, three!"):
        ids = bpe.encode([text.encode(), b""])
        assert np.frombuffer(ids[0], "<u4").tolist() == reference.encode_ordinary(text) and ids[1] == b""
        assert bpe.decode(ids) == [text.encode(), b""]


def test_memo_stays_small():
    """A worker holds three memos and a hash table as large beside each; before, one took 60 MB and 1.2 million keys."""
    memo, most = bpe_duckdb.Memo(), 0
    for start in range(0, 1_500_000, 50_000):
        keys = pa.array([b"%012d" % i for i in range(start, start + 50_000)], pa.binary())
        assert memo.get(keys, lambda new: new).equals(keys)
        most = max(most, memo.keys.nbytes + memo.values.nbytes)
        assert len(memo.keys) <= 300_000
    assert most <= 20_000_000


def test_bpe_cuts_without_hashing(monkeypatch):
    """The places of cuts were hashed (``np.unique``), a fifth of all CPU time; now they are marked."""
    bpe = bpe_duckdb.ByteBpe(bpe_duckdb.load_ranks(queries.RANKS), queries.PATTERN)
    monkeypatch.setattr(np, "unique", None)
    texts = [t.encode() for t in ("", "one two one", "", "drei vier\n", " ", "", "fünf sechs", "")]
    assert bpe.decode(bpe.encode(texts)) == texts
    assert bpe_duckdb.edges(7, np.array([0, 3, 3, 7]), np.array([], dtype=int), np.array([5, 3])).tolist() == [0, 3, 5, 7]


def test_bpe_ties_and_any_ranks():
    """Random merges in which a longer token may come before a shorter one, against the plain algorithm."""
    rng = random.Random(8)
    for _ in range(15):
        tokens = {bytes([i]) for i in range(256)}
        while len(tokens) < 256 + 40:
            tokens.add(bytes(rng.choices(b"ab", k=rng.randint(2, 6))))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        bpe = bpe_duckdb.ByteBpe(ranks, r"\p{L}+|\P{L}+")
        words = ["".join(rng.choices("ab", k=n)) for n in (1, 2, 7, 30, 200, 350, 700)]
        for word, ids in zip(words, bpe.encode([w.encode() for w in words])):
            parts = [bytes([b]) for b in word.encode()]
            while True:
                pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
                if not pairs or (len(word) <= 1):
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert np.frombuffer(ids, "<u4").tolist() == [ranks[p] for p in parts]


def test_bpe_column(edge, empty, reference):
    coded = bpe_duckdb.encode(edge, "text", queries.RANKS, queries.PATTERN)
    read = bpe_duckdb.decode(coded, "ids", queries.RANKS, queries.PATTERN)
    rows = read.select("doc_id", "text", "ids", "bytes").collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert bytes(r["bytes"]).decode() == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
    both = bpe_duckdb.encode_decode(edge, "text", queries.RANKS, queries.PATTERN).select("doc_id", "text", "ids", "bytes").collect()
    assert Counter(map(str, both)) == Counter(map(str, rows))
    for add in (bpe_duckdb.encode, bpe_duckdb.encode_decode):
        assert add(empty, "text", queries.RANKS, queries.PATTERN).count() == 0


def test_op9(spark, reference):
    texts = dict(duck(SF).execute("SELECT doc_id, text FROM documents").fetchall())
    got = queries.QUERIES["op9_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(reference.encode_ordinary(texts[r["doc_id"]] or ""), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# ---- classifier -------------------------------------------------------------


def brute_score(m, f, i):
    size = len(m.linear)
    x = np.zeros(size)
    part = slice(f.first[i], f.first[i + 1])
    x[f.bucket[part]] = f.value[part]
    x[quality_fm.BUCKETS :] = m.scaled(f.dense)[i]
    used = np.flatnonzero(x)
    z = m.bias + x @ m.linear.astype(float)
    z += sum(float(m.factors[a] @ m.factors[b]) * x[a] * x[b] for a, b in itertools.combinations(used, 2))
    return 1 / (1 + math.exp(-z))


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    texts = [t.encode() for t in ("", "a b c a", "Some WORDS, with #signs# and 12 numbers.\nAnd a line.", " ".join(WORDS))]
    f = quality_fm.features(texts, np.array([np.nan, 7, 50, 100]))
    n = quality_fm.BUCKETS + len(quality_fm.STATISTICS)
    m = quality_fm.Machine(0.3, rng.normal(0, 0.3, n), rng.normal(0, 0.3, (n, 4)), f.dense.mean(axis=0), f.dense.std(axis=0) + 1)
    assert np.allclose(m.score(f), [brute_score(m, f, i) for i in range(len(texts))], atol=1e-5)


def test_features_do_not_depend_on_company():
    texts = [(r[1] or "").encode() for r in edge_rows()]
    together = quality_fm.features(texts, np.full(len(texts), np.nan))
    for i, text in enumerate(texts):
        alone = quality_fm.features([text], np.array([np.nan]))
        assert np.allclose(alone.dense[0], together.dense[i])
        part = slice(together.first[i], together.first[i + 1])
        assert (alone.bucket == together.bucket[part]).all() and np.allclose(alone.value, together.value[part])


def test_op8_held_out(spark):
    got = queries.QUERIES["op8_quality_fm"](spark, MIDDLE).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet")
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert both.loc[both["quality"] == 1, "predicted"].mean() > 0.97
    assert both.loc[both["quality"] == 0, "predicted"].mean() < 0.2
    again = queries.QUERIES["op8_quality_fm"](spark, MIDDLE).toPandas()
    assert (again.sort_values("doc_id")["score"].to_numpy() == got.sort_values("doc_id")["score"].to_numpy()).all()


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (20, 1), (20, 1), (21, 1), (99, 5)], "doc_id long, quality int")
    machine = quality_fm.train(edge, labels, F.lit(True))
    got = quality_fm.with_score(edge, machine).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    nothing = quality_fm.train(empty, labels, F.lit(True))
    assert {round(r["score"], 6) for r in quality_fm.with_score(edge, nothing).collect()} == {0.5}
    assert quality_fm.with_score(empty, machine).count() == 0


# ---- language ---------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"abcabcabcabc"]
    held = language_id.Pieces(set(pieces))
    place = {p: int(np.searchsorted(held.hashes, np.uint64(language_id.piece_hash(p)))) for p in pieces}
    chances = np.random.default_rng(0).uniform(0.01, 0.3, (len(pieces), 2))
    words = [b"abcab", b"a", b"ccab", b"abcabcabc", b"abcabcabcabcab"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    lattice = language_id.Lattice(held, data, ends - [len(w) for w in words], ends)
    forward, backward = lattice.forward(chances), lattice.backward(chances)

    def total(word, k):
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(chances[place[p], k] * sums[end - len(p)] for p in pieces if word[:end].endswith(p)))
        return sums[-1]

    want = np.array([[total(words[i], k) for k in range(2)] for i in lattice.order])
    assert np.allclose(lattice.totals(forward), want)
    assert np.allclose(backward[:, 0], want)
    for word in (b"abcabcabcabc" * 5, b"cab" * 20, b"abc" * 400):
        logs = language_id.long_logs(held, chances, np.frombuffer(word, dtype=np.uint8))
        exact = []
        for k in range(2):
            sums, shift = [1.0], 0.0
            for end in range(1, len(word) + 1):
                sums.append(sum(chances[place[p], k] * sums[end - len(p)] for p in pieces if end >= len(p) and word[:end].endswith(p)))
                if end % 50 == 0:
                    top = max(sums[-13:])
                    sums, shift = [x / top for x in sums], shift + np.log(top)
            exact.append(np.log(sums[-1]) + shift)
        assert np.allclose(logs, exact)


def test_all_pieces_and_whole_runs():
    pieces = language_id.vocabulary(queries.RANKS)
    assert len(pieces) > 35_000 and pieces.lengths[-1] > 12
    chances = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    model = language_id.Model(["x", "y"], pieces, chances)
    for text in ("donaudampfschifffahrtsgesellschaftskapitänswitwenversicherung", "汉字没有空格的文字也要整段计算" * 60):
        raw = text.encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        known = {int(h): i for i, h in enumerate(pieces.hashes)}
        exact = []
        for k in range(2):
            sums, shift = [1.0], 0.0
            for end in range(1, len(raw) + 1):
                now = 0.0
                for n in pieces.lengths:
                    if n <= end and (i := known.get(language_id.piece_hash(raw[end - n : end]))) is not None:
                        now += chances[i, k] * sums[end - n]
                sums.append(now)
                if end % 40 == 0:
                    top = max(sums[-130:])
                    sums, shift = [x / top for x in sums], shift + np.log(top)
            exact.append(np.log(sums[-1]) + shift)
        assert np.allclose(model.word_logs(data, np.array([0]), np.array([len(raw)]))[0], exact)


def test_rare_language_is_learned(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "mat", "house"], 6)), "en") for i in range(20_000)]
    rows += [(50_000 + i, " ".join(rng.choice(["kissa", "istuu", "matolla", "talo", "on"], 6)), "fi") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True), queries.RANKS)
    assert model.languages == ["en", "fi"]
    asked = spark.createDataFrame([("talo on matolla", 1, "a"), ("the house", 2, "b")], "text string, score int, lang_pred string")
    got = language_id.with_language(asked, model)
    assert got.columns == ["text", "lang_pred", "score"] and sorted(r["lang_pred"] for r in got.collect()) == ["en", "fi"]


def test_language_memo(monkeypatch):
    pieces = language_id.vocabulary(queries.RANKS)
    chances = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = language_id.Model(["x", "y"], pieces, chances)
    texts = [(r[1] or "").lower().encode() for r in edge_rows()]
    whole = model.text_logs(texts, language_id.Memo(2))
    monkeypatch.setattr(language_id, "MEMO", 20)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 300)
    memo = language_id.Memo(2)
    assert np.allclose(model.text_logs(texts, memo), whole)
    assert len(memo.keys) < 200


def test_op5_held_out(spark):
    got = queries.QUERIES["op5_language_id"](spark, MIDDLE).toPandas()
    truth = pd.read_parquet(f"{MIDDLE}/documents.parquet")[["doc_id", "lang", "text"]]
    both = got.merge(truth, on="doc_id")
    assert len(both) == 1000 and both["score"].between(0, 1).all()
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_language_edges(edge, empty):
    model = language_id.train(edge, F.lit(True), queries.RANKS)
    assert model.languages == ["de", "en", "fr"]
    got = language_id.with_language(edge, model).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        lettered = r["text"] is not None and regex.search(r"\p{L}", r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    nothing = language_id.train(empty, F.lit(True), queries.RANKS)
    assert {r["lang_pred"] for r in language_id.with_language(edge, nothing).collect()} == {"und"}
    assert language_id.with_language(empty, model).count() == 0


# ---- search -----------------------------------------------------------------


def brute_top(vectors, asked, k):
    out = []
    for q in asked:
        scores = [(-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 60)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 24).tolist(), 1, 2) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1, 2) for i in range(80)]  # ties
    rows += [(400 + i, [float(i), 1.0], 1, 2) for i in range(4)] + [(500, [3.0], 1, 2), (600, [], 1, 2), (610, [], 1, 2)]
    rows += [(520, [1e18, 2.0, 3.0], 1, 2), (530, [1e15, 1.0, -7.0], 1, 2), (rows[5][0], rows[5][1], 1, 2)]
    bad = [(700, None, 1, 2), (710, [1.0, None], 1, 2), (720, [float("nan"), 1.0], 1, 2), (730, [float("inf"), 1.0], 1, 2), (None, [1.0, 2.0], 1, 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int, rank int").repartition(5)
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()
    vectors = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v] for i, v, *_ in rows}
    wrap = lambda s: (s + 2**63) % 2**64 - 2**63
    want = brute_top({i: v for i, v in vectors.items() if i not in (520, 530)}, [i for i in vectors if i % 10 == 0 and i not in (520, 530)], 5)
    product = wrap(sum(a * b for a, b in zip(vectors[520], vectors[530])))
    want += [(520, 1, 530, product), (530, 1, 520, product)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


# ---- chat -------------------------------------------------------------------


def tree_rows():
    return [
        # tree, node, parent, role, text, score
        ("t", "a", None, "user", "root", 1.0),
        ("t", "b", "a", "assistant", "good", 5.0),
        ("t", "c", "a", "assistant", "bad", 1.0),
        ("t", "d", "b", "user", "on <|im_end|>\n<|im_start|>assistant\n\\ \\| <\\|", None),
        ("t", "e", "c", "user", None, 2.0),
        ("t", "f", "d", None, "", 2.0),
        ("t", "g", "d", "as\nsist\\ant", "tie", 2.0),
        ("u", "h", "gone", "assistant", "parent is not there", 0.0),
        ("v", "i", "j", "user", "cycle", 0.0),
        ("v", "j", "i", "user", "cycle", 0.0),
        (None, "k", None, "assistant", "no tree", 0.0),
    ]


def test_reply_trees(spark):
    rows = tree_rows()
    by_node = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    paths = defaultdict(list)
    for r in rows:
        if r[1] in parents or r[0] == "v":
            continue
        path = [r]
        while path[0][2] in by_node:
            path.insert(0, by_node[path[0][2]])
        paths[r[0]].append((-sum(x[5] or 0 for x in path) / len(path), r[1], path))
    want = {}
    for tree, found in paths.items():
        for rank, (score, leaf, path) in enumerate(sorted(found, key=lambda p: p[:2])[:2], 1):
            want[leaf] = (tree, rank, -score, [(x[3] or "", x[4] or "") for x in path])
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    done = chat_trees.format_trees(df, branches=2)
    read = done.withColumn("turns", chat_trees.parse_turns(F.col("formatted")))
    read = read.withColumn("under", chat_trees.loss_texts(F.col("formatted"), F.col("loss"))).collect()
    assert {r["leaf"] for r in read} == set(want) == {"f", "g", "h", "k"}
    for r in read:
        tree, rank, score, path = want[r["leaf"]]
        assert (r["tree"], r["branch_rank"], r["n_turns"]) == (tree, rank, len(path))
        assert r["branch_score"] == pytest.approx(score)
        assert [tuple(t) for t in r["turns"]] == path
        assert r["under"] == [t for role, t in path if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(path)


def test_long_and_odd_conversations(spark):
    odd = ["", None, "\\", "<", "<|", "<\\|im_end|>", "é\U0001f600漢", "x\n", "\n"]
    rows = [(1, t, "assistant" if t % 2 else "user", f"{odd[t % len(odd)]}{t}", 7) for t in range(700)]
    rows += [(2, None, None, None, 7), (2, 3, "user", odd[5], 7), (2, 3, "assistant", odd[3], 7), (2, 3, "assistant", odd[3], 7)]
    rows += [(None, 1, "assistant", "x" * 200000, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").repartition(4)
    done = chat_trees.format_trees(chat_trees.chain(df, "conv_id", "turn", "role", "text"))
    got = {
        r["tree"]: ([tuple(t) for t in r["turns"]], r["under"])
        for r in done.select(
            "tree", chat_trees.parse_turns(F.col("formatted")).alias("turns"), chat_trees.loss_texts(F.col("formatted"), F.col("loss")).alias("under")
        ).collect()
    }
    assert set(got) == {1, 2, None}
    for conv, (turns, under) in got.items():
        mine = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        assert turns == [m[1:] for m in mine]
        assert under == [m[2] for m in mine if m[1] == "assistant"]
    assert chat_trees.format_trees(chat_trees.chain(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


# ---- mixing -----------------------------------------------------------------


def water_fill(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 50, 1000, 100000]) + rng.randint(0, 40) for i in range(9)} | {None: 77, "Z": 0, "é": 5}
    rows = list(sizes.items())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, mixing.WEIGHTS, 1.5, 2.0).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_permutation(spark):
    df = spark.createDataFrame([(k, n, i) for k in (5, 6) for n in (1, 2, 17, 64, 300) for i in range(n)], "k long, n long, i long")
    got = df.withColumn("p", mixing.permuted(F.col("k"), F.col("n"), F.col("i"))).toPandas()
    for (_, n), rows in got.groupby(["k", "n"]):
        assert sorted(rows["p"]) == list(range(n))
    orders = {k: rows[rows["n"] == 300].sort_values("i")["p"].tolist() for k, rows in got.groupby("k")}
    assert orders[5] != orders[6] and orders[5] != sorted(orders[5])


def test_mix(spark, edge, empty):
    mixture = mixing.mix(edge, block=8, shard_slots=64)
    placed = mixture.placed.toPandas()
    rows = edge_rows()
    assert Counter(placed["size"]) == Counter(len(regex.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    slots = mixture.slots.toPandas()
    targets = {r["source"]: r for r in mixture.targets.collect()}
    for source, r in targets.items():
        mine = slots[slots["source"].isna() if source is None else slots["source"] == source]
        assert abs(len(mine) * 8 - r["target"]) <= 8
        assert sorted(mine["slot"]) == list(range(len(mine)))
        blocks = -(-r["source_size"] // 8)
        assert mine.groupby("block").size().max() <= 2 if len(mine) else True
        for epoch, part in mine.groupby("epoch"):
            assert part["block"].is_unique and (epoch + 1) * blocks >= len(part)
    assert slots.groupby("shard").size().max() <= 64
    taken = mixture.taken.groupBy("doc", "tag", "source", "start").agg(F.sum("n").alias("taken")).toPandas()
    both = placed.merge(taken, on=["doc", "tag", "source", "start"], how="left").fillna({"taken": 0})
    assert (both["taken"] <= 2 * both["size"]).all()
    again = mixing.mix(edge.repartition(7), block=8, shard_slots=64)
    key = ["shard", "source", "slot", "block"]
    assert again.slots.toPandas()[key].sort_values(key).values.tolist() == slots[key].sort_values(key).values.tolist()
    mixed = mixing.mixed_documents(edge, mixture).collect()
    assert sum(len(regex.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed) == both["taken"].sum()
    texts = {r[1] for r in rows}
    assert any(r["text"] in texts for r in mixed)
    assert mixing.mix(empty).taken.count() == 0 and mixing.mixed_documents(empty, mixing.mix(empty)).count() == 0


def test_op10(spark):
    got = queries.QUERIES["op10_mixing"](spark, MIDDLE).toPandas()
    docs = pd.read_parquet(f"{MIDDLE}/documents.parquet")
    docs["size"] = docs["text"].map(lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t or "")))
    sizes = docs.groupby("source")["size"].sum().to_dict()
    both = got.merge(docs[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_want"))
    assert len(both) == 1000 and (both["size"] == both["size_want"]).all()
    assert (both["source_size"] == both["source"].map(sizes)).all()
    assert np.allclose(both["target"], both["source"].map(water_fill(sizes)))
    assert (both["taken"] <= 2 * both["size"]).all()
    for _, part in both.groupby("source"):
        assert abs(part["taken"].sum() / part["target"].iloc[0] - 1) < 0.01
