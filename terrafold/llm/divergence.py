"""Audit of how far the sources of a language diverge, by hash-consed segment trees over term ids.

The terms of a language that enough of its documents hold are numbered, in blocks. In a block the
counts of each group (language and source) form a segment tree: leaves are counts, in the
order of the terms, and a node is the pair of its halves. Nodes are hash-consed: equal pairs
get one number, so count subtrees that are identical, within a group or between groups,
are one node. Two groups are compared by walking their trees at once from the roots; a pair of
nodes that was met before is not walked again, so each distinct pair is priced once, and
the prices of pairs are summed on the way back. Blocks hold terms of similar frequency,
whose counts repeat most.

A smoothed share is ``p = 1 + SCALE * (count + 1) div (N + V)`` and the price of a term with shares
p and q is ``(p - q) ** 2 div q``, all in integers.

Work is dealt by (language, block, pair of source slices): a block has at most ``CELLS`` counts
or one term's, a slice at most ``SLICE`` sources. A language or source that holds a third of all rows is
many blocks. Counts are added up within batches and on the map side before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, short_batches
from .terms import LETTERS, numbered, term_slices

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Most counts, and terms, of a block on average; sources of a slice; occurrences that a task holds before it adds them up.
CELLS = 50_000
TERMS = 15_000
SLICE = 64
#: Copies of a language's few rows where its many rows meet them.
SALTS = 64
HELD = 4_000_000


# ---- counts -----------------------------------------------------------------


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def added_up(langs: list[str], sources: list[str], lang: np.ndarray, source: np.ndarray, text_of: np.ndarray, term: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """One row per language and term with its sources, and each one's occurrences and documents, from one entry per occurrence."""
    width = max(len(terms), 1)
    lang_of_text, source_of_text = (np.zeros(int(text_of.max(initial=0)) + 1, dtype=np.int64) for _ in range(2))
    lang_of_text[text_of], source_of_text[text_of] = lang, source
    key = lambda text, t: (lang_of_text[text] * width + t) * len(sources) + source_of_text[text]
    cells, c = run_lengths(key(text_of, term))
    held, _ = run_lengths(text_of * width + term)
    _, d = run_lengths(key(held // width, held % width))
    owner = cells // max(len(sources), 1)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    edges = pa.array(np.append(first, len(owner)).astype(np.int32))
    lists = [pa.array(sources, pa.string()).take(pa.array(cells % max(len(sources), 1))), pa.array(c.astype(np.int64)), pa.array(d.astype(np.int64))]
    rows = owner[first]
    columns = [pa.array(langs, pa.string()).take(pa.array(rows // width)), terms.take(pa.array(rows % width)).cast(pa.large_string()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(edges, x) for x in lists)], names=["lang", "term", "source", "c", "d"])


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, term, source, c, d``: occurrences and documents. Nulls read as ''.

    Tasks add up what they read, a bounded number of occurrences at a time, so that a term of a language is one row of a task, with a
    list of its sources; these rows are dealt by language and term and added up again.
    """
    short_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        sources: dict[str, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        texts = held = 0

        def told() -> pa.RecordBatch:
            lang_no, source_no, text_of, lengths, data = (np.concatenate(x) for x in zip(*parts))
            term, terms = numbered(lengths, data)
            return added_up(list(langs), list(sources), lang_no, source_no, text_of, term, terms)

        for batch in batches:
            bodies = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            lang_no = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            source_no = np.array([sources.setdefault(x, len(sources)) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for owner, lengths, data in term_slices(bodies, LETTERS):
                parts.append((lang_no[owner], source_no[owner], owner + texts, lengths, data))
                held += len(lengths)
            texts += len(bodies)
            if held >= HELD:
                yield told()
                langs, sources, parts, texts, held = {}, {}, [], 0, 0
        if parts:
            yield told()

    read = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("body"))
    found = read.mapInArrow(count, "lang string, term string, source array<string>, c array<long>, d array<long>")
    found = found.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("source", "c", "d")).alias("x"))
    return found.groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("c"), F.sum("x.d").alias("d"))


# ---- trees ------------------------------------------------------------------


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + SCALE * (count + 1) div total`` without overflow: long division in base 1000."""
    rest = counts.astype(np.int64) + 1
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Forest:
    """Hash-consed segment trees of several groups over the same terms.

    ``levels[0]`` are the distinct leaf values (-1 for places beyond the last term), ``levels[k]`` the distinct pairs
    of nodes one level down, and ``roots`` the node of each group at the top.
    """

    def __init__(self, counts: np.ndarray):
        groups, terms = counts.shape
        width = 1 << max(0, int(terms - 1).bit_length())
        padded = np.full((groups, width), -1, dtype=np.int64)
        padded[:, :terms] = counts
        values, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(groups, width)
        self.leaves, self.levels = values, []
        while nodes.shape[1] > 1:
            size = int(nodes.max(initial=0)) + 1
            pairs, up = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // size, pairs % size))
            nodes = up.reshape(groups, -1)
        self.roots = nodes[:, 0]

    def walk(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Leaf values of the distinct leaf pairs met when the trees of two groups are walked at once, and the way back:
        for each level from the bottom the two places, one level down, of every distinct pair of nodes."""
        left, right = np.array([self.roots[a]]), np.array([self.roots[b]])
        back = []
        for lows, highs in reversed(self.levels):
            width = int(max(lows.max(), highs.max())) + 1
            met = np.concatenate([lows[left] * width + lows[right], highs[left] * width + highs[right]])
            distinct, place = np.unique(met, return_inverse=True)
            back.append(place.reshape(2, -1))
            left, right = distinct // width, distinct % width
        return self.leaves[left], self.leaves[right], back[::-1]


def total(values: np.ndarray, back: list[np.ndarray]) -> int:
    """The sum over all terms from the prices of distinct leaf pairs."""
    for place in back:
        values = values[place[0]] + values[place[1]]
    return int(values[0])


def per_term(values: np.ndarray, back: list[np.ndarray], terms: int) -> np.ndarray:
    """The price of every term: the pairs unfolded from the root down to the leaves."""
    at = np.zeros(1, dtype=np.int64)
    for place in reversed(back):
        at = place[:, at].T.ravel()
    return values[at][:terms]


def compare_block(table: pa.Table, top: int) -> tuple[list, list]:
    """Pair prices and best terms of one block for one pair of source slices.

    Rows without a term carry the sources with their totals, the number of terms, and the language's
    total; rows with a term a count, and the count of the whole language in ``all``.
    """
    is_group = table["term"].is_null().to_numpy()
    groups = table.filter(pa.array(is_group))
    # a block may come from both slices; a source is there once
    names, first = np.unique(np.array(groups["source"].to_pylist(), dtype=object), return_index=True)
    totals = groups["total"].to_numpy()[first]
    slices = groups["slice"].to_numpy()[first]
    if not len(names):
        return [], []
    terms_of_block, lang_total = int(groups["terms"][0].as_py()), int(groups["lang_total"][0].as_py())
    i, j = int(groups["i"][0].as_py()), int(groups["j"][0].as_py())
    cells = table.filter(pa.array(~is_group))
    encoded = cells["term"].combine_chunks().dictionary_encode()
    at_term = encoded.indices.to_numpy().astype(np.int64)
    spelled = encoded.dictionary.to_pylist()
    at_group = np.searchsorted(names, np.array(cells["source"].to_pylist(), dtype=object)) if cells.num_rows else at_term
    whole = np.zeros(terms_of_block, dtype=np.int64)
    whole[at_term] = cells["all"].to_numpy()
    # frequent terms first: equal counts become neighbours
    order = np.argsort(-whole[: len(spelled)], kind="stable")
    place = np.empty(len(spelled), dtype=np.int64)
    place[order] = np.arange(len(spelled))
    counts = np.zeros((len(names) + 1, terms_of_block), dtype=np.int64)
    counts[at_group, place[at_term]] = cells["c"].to_numpy()
    counts[-1, : len(spelled)] = whole[order]
    pairs, best = [], []
    if not terms_of_block:
        for a in range(len(names)):
            pairs += [(names[a], names[b], 0) for b in range(len(names)) if a != b and {slices[a], slices[b]} == {i, j}]
        return pairs, best
    forest = Forest(counts)
    beyond = lambda x: x < 0  # noqa: E731  places beyond the last term cost nothing
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            if {slices[a], slices[b]} != {i, j}:
                continue
            x, y, back = forest.walk(a, b)
            p, q = shares(np.maximum(x, 0), int(totals[a])), shares(np.maximum(y, 0), int(totals[b]))
            free = beyond(x)
            pairs.append((names[a], names[b], total(np.where(free, 0, prices(p, q)), back)))
            pairs.append((names[b], names[a], total(np.where(free, 0, prices(q, p)), back)))
        if i == j:
            x, y, back = forest.walk(a, len(names))
            p, q = shares(np.maximum(x, 0), int(totals[a])), shares(np.maximum(y, 0), lang_total)
            told = per_term(np.where((x > 0) & (p > q), prices(p, q), -1), back, len(spelled))
            some = np.flatnonzero(told >= 0)
            if len(some) > top:
                bar = np.partition(told[some], len(some) - top)[len(some) - top]
                some = some[told[some] >= bar]
            ranked = sorted(((-int(told[t]), spelled[order[t]].encode("utf-8", "replace"), t) for t in some))[:top]
            best += [(names[a], spelled[order[t]], -v) for v, _, t in ranked]
    return pairs, best


# ---- the audit --------------------------------------------------------------


def salted(rows: DataFrame, few: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with the rows of ``few`` for their keys. A key of very many rows is ``SALTS`` keys, dealt by the columns ``spread``."""
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return rows.join(few, [*keys, "__salt"]).drop("__salt")


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, cells_of_block: int = CELLS, slice_size: int = SLICE,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language with the sum of the prices over all kept terms (0 if
    there are none). Part ``term``: the ``top`` terms of the group that stand out most against the whole
    language. Null text, language and source read as ''. A row is a document, also where ids or rows repeat; ids are
    not read. Ties go by the UTF-8 order of the item. An empty table gives no rows.
    """
    rows = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    of_term = W.partitionBy("lang", "term")
    cells = term_counts(df, text, lang, source).withColumns({
        "all": F.sum("c").over(of_term), "df": F.sum("d").over(of_term), "is_first": (F.min("source").over(of_term) == F.col("source")).cast("int"),
    })
    # terms of similar frequency are dealt by hash into blocks of about so many counts
    cells = cells.filter(F.col("df") >= least).withColumn("class", F.floor(F.log2("df")).cast("int"))
    cells = cut(cells.select("lang", "term", "source", "c", "all", "class", "is_first"))
    classes = cells.groupBy("lang", "class").agg(F.sum("is_first").alias("n"), F.count("*").alias("cells"))
    blocks = F.greatest(F.ceil(F.col("cells") / cells_of_block), F.ceil(F.col("n") / TERMS), F.lit(1)).cast("int")
    classes = cut(classes.select("lang", F.col("class"), "n", blocks.alias("blocks")))
    cells = salted(cells, classes.drop("n"), ["lang", "class"], ["term"])
    cells = cells.withColumn("part", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")

    sums = cells.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = rows.distinct().join(sums, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = classes.groupBy("lang").agg(F.sum("n").alias("v")).join(sums.groupBy("lang").agg(F.sum("n").alias("lang_n")), "lang")
    slices = groups.groupBy("lang").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("slices"))
    groups = groups.join(sizes, "lang", "left").join(slices, "lang")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select(
        "lang", "source", "slices", F.pmod(F.xxhash64("source"), F.col("slices")).cast("int").alias("slice"),
        (F.col("n") + v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + v).alias("lang_total"),
    )
    groups = cut(groups)
    made = cells.groupBy("lang", "class", "part").agg(F.sum("is_first").cast("int").alias("terms"))
    # every source of a language takes part in each of its blocks, in one empty block where there is no term
    silent = groups.join(made.select("lang").distinct(), "lang", "left_anti").withColumns({"class": F.lit(-1), "part": F.lit(0), "terms": F.lit(0)})
    heads = salted(made, groups, ["lang"], ["class", "part"]).select(silent.columns).unionByName(silent)

    def dealt(some: DataFrame) -> DataFrame:
        """A row under every pair of slices that its source is in."""
        other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
        some = some.withColumn("__o", other)
        return some.withColumns({"i": F.least("slice", "__o"), "j": F.greatest("slice", "__o")}).drop("__o", "slices")

    key = ["lang", "class", "part", "i", "j"]
    columns = [*key, "source", "slice", "term", "c", "all", "total", "terms", "lang_total"]
    none = lambda kind: F.lit(None).cast(kind)
    heads = dealt(heads).withColumns({"term": none("string"), "c": none("long"), "all": none("long")})
    mine = groups.select("lang", "source", "slices", "slice")
    cells = dealt(salted(cells, mine, ["lang", "source"], ["term"])).withColumns({n: none(t) for n, t in (("total", "long"), ("terms", "int"), ("lang_total", "long"))})
    met = heads.select(columns).unionByName(cells.select(columns))

    def compare(table: pa.Table) -> pa.Table:
        pairs, best = compare_block(table, top)
        name = table["lang"][0].as_py()
        out = [(name, a, "pair", b, x) for a, b, x in pairs] + [(name, a, "term", t, x) for a, t, x in best]
        kinds = [pa.string()] * 4 + [pa.int64()]
        told = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(list(x), k) for x, k in zip(told, kinds)], names=["lang", "source", "part", "item", "value"])

    found = cut(met.groupBy(*key).applyInArrow(compare, "lang string, source string, part string, item string, value long"))
    # the prices of a pair are added up over blocks; a term is in one block
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, terms = (x.withColumn("rank", F.row_number().over(order).cast("int")) for x in (pairs, found.filter("part = 'term'")))
    return pairs.unionByName(terms.filter(F.col("rank") <= top))
