"""N-gram Jaccard join by universe partition, with one-deletion neighbourhoods.

Sets of equal content collapse to one class first. Sizes fall into bands; the
scheme of a band finds every partner of its sets that is not smaller. In a scheme
two linked sets differ in at most ``H`` elements. A hash cuts the universe into
segments: ``k0`` of them are compared whole, ``k1`` also with one element deleted,
where ``k0 + 2 k1 = H + 1``. By the pigeonhole principle, linked sets agree on a
``k0`` segment or differ by at most one element on a ``k1`` segment.

Fewer segments are larger and thus more selective, but deletions are more rows.
``allocate`` picks the cheapest ``k1`` of each band from the number of its classes.

Lower thresholds leave many segments empty by chance, and those all meet, or take many
deletions. With ``spare``, schemes may cut the universe into more than ``H + 1`` segments, all compared whole,
and a set gives only its ``H + 1`` first in one order of all contents, the larger first: at most ``H`` segments of a
set are not those of a linked one, so the first segment that both have is among these. ``rare`` takes
other keys: in one order of all elements, rare ones first, linked sets share one of the
first ``n - ceil(n percent / 100) + 1`` of both. An element of one class alone is no key.

A key is (scheme, segment, content), or an element. Members of a key are not paired with one
another: each meets the key's pivot and is verified exactly on the full sets, which
leaves its difference to the pivot. Where the documents of a pivot are then still in
several components, those not linked to it meet the others in blocks and are compared
by their differences, inside tasks; only links come out. No link is lost.

Shuffled: keys with ids, and the texts of documents that share a key. Hot keys are
summed on the map side, and their sides in joins can be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels
from .common import any_id, cut, short_batches
from .graph import components

NGRAM = 3
PERCENT = 90
#: Cost of one candidate pair, in rows of keys.
PAIR_COST = 20.0
#: Segments of a scheme with spare ones, in what it needs.
SPARE = (1.25, 1.4, 1.6)
#: Bound of the rows that a broadcast of id buckets can have.
ID_BUCKETS = 1 << 20
#: Sets looked at for elements of very many sets, and how many of them must hold one.
SAMPLE_SETS = 1 << 12
SAMPLE_HITS = 8
#: More common elements than a set can have.
_MOST = 1 << 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: list[bytes], n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of each text (A-Z in lower case).

    A text of fewer words is one shingle of all its words; without words it has none.
    """
    hashes, first = kernels.word_hashes(texts)
    rolled = hashes.copy()
    for k in range(1, n):
        rolled[:-k or None] = kernels.mix(rolled[: len(hashes) - k] * _A + hashes[k:] + _B)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])  # ``np.unique`` hashes first, which costs more
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = _C
            for w in hashes[a:b]:
                h = kernels.mix(np.array([h], dtype=np.uint64) * _A + w)[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int(np.sum(kernels.mix(s + k), dtype=np.uint64).astype(np.int64)) for k in (_A, _B))


class Bands:
    """Size bands ``low .. high``; a partner of a set is in its own band or the next one up or down."""

    def __init__(self, largest: int, percent: int):
        self.percent = percent
        self.low, self.high, self.h = [], [], []
        size = 1
        while size <= max(largest, 1):
            high = size * 100 // percent
            self.low.append(size)
            self.high.append(high)
            # |A ^ B| <= (|A| + |B|) (100 - p) / (100 + p), the larger at most 100 / p of the smaller
            self.h.append((high + high * 100 // percent) * (100 - percent) // (100 + percent))
            size = high + 1

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def allocate(self, classes: list[int], spare: bool = False) -> list[tuple[int, int]]:
        """``(k0, k1)`` of each band's scheme for so many classes in the band.

        Cost: rows of keys, and pairs of sets whose segment is empty by chance, which all meet.
        A scheme that allows no difference needs no keys: its links are classes. With ``spare``, ``k0`` may be over ``H + 1``.
        """
        out = []
        for low, h, n in zip(self.low, self.h, classes):
            best = (math.inf, 0, 0)
            for k1 in range(0, (h + 2) // 2 + 1) if h else ():
                k0 = max(0, h + 1 - 2 * k1)
                size = low / (k0 + k1)
                empty = math.exp(-size)
                met = k0 * empty**2 + k1 * (empty * (1 + size)) ** 2
                best = min(best, (n * (k0 + k1 * (1 + size)) + PAIR_COST * met * n * n / 2, k0, k1))
            for share in SPARE if h and spare else ():
                k0 = math.ceil((h + 1) * share)
                empty = math.exp(-low / k0)
                # a set gives an empty segment only where fewer than h + 1 are not empty
                apart = (k0 * (1 - empty) - h - 0.5) / math.sqrt(k0 * empty * (1 - empty))
                met = k0 * (empty * math.erfc(apart / math.sqrt(2)) / 2) ** 2
                best = min(best, (n * (h + 1) + PAIR_COST * met * n * n / 2, k0, 0))
            out.append(best[1:])
        return out


def keys_of(s: np.ndarray, bands: Bands, plan: list[tuple[int, int]]) -> np.ndarray:
    """Keys of a set in the schemes of its band and the one below. The last bit is set for deletions."""
    out = [np.empty(0, np.uint64)]
    if not len(s):
        return out[0]
    band = bands.of(len(s))
    for scheme in (band, band - 1):
        if scheme < 0 or len(s) * bands.percent > bands.high[scheme] * 100:
            continue
        k0, k1 = plan[scheme]
        if not k0 + k1:
            continue
        tag = kernels.mix(np.array([scheme + 1], dtype=np.uint64))[0]
        segment = (kernels.mix(s + tag) % np.uint64(k0 + k1)).astype(np.int64)
        content = kernels.mix(s * _A + _C)
        order = np.argsort(segment, kind="stable")
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(content[order])])
        edges = np.searchsorted(segment[order], np.arange(k0 + k1 + 1))
        whole = sums[edges[1:]] - sums[edges[:-1]]
        place = kernels.mix(np.arange(k0 + k1, dtype=np.uint64) + kernels.mix(np.array([tag], dtype=np.uint64)))
        keys = kernels.mix(whole + place) & ~np.uint64(1)
        if k0 > bands.h[scheme] + 1:  # spare segments: the first in one order of all contents, the larger first
            keys = keys[np.lexsort((keys, np.diff(edges)))[-bands.h[scheme] - 1 :]]
        out.append(keys)
        deleted = segment >= k0
        if deleted.any():
            out.append(kernels.mix(whole[segment[deleted]] - content[deleted] + place[segment[deleted]]) | np.uint64(1))
    return np.concatenate(out)


def set_digests(df: DataFrame, row_id: str, text: str, ngram: int = NGRAM) -> DataFrame:
    """``doc, tag, n, d1, d2``: hash of the text, size and digest of the set of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], ngram)
            d = np.array([digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            n = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), batch.column(2), n, pa.array(d[:, 0]), pa.array(d[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "tag", "n", "d1", "d2"])

    rows = df.select(any_id(row_id).alias("doc"), F.col(text).alias("body"), F.xxhash64(text).alias("tag"))
    return rows.mapInArrow(read, "doc long, tag long, n long, d1 long, d2 long")


def set_arrays(df: DataFrame, row_id: str, text: str, make, name: str, ngram: int = NGRAM, once: bool = False) -> DataFrame:
    """``doc, d1, d2`` and ``make(set)`` as an array of longs, of every row with a set.

    With ``once``, later rows of a partition with an equal set have an empty array.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], ngram)
            d = np.array([digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            if once:
                for i, key in enumerate(map(tuple, d.tolist())):
                    sets[i] = sets[i][:0] if key in seen else sets[i]
                    seen.add(key)
            made = [make(s).astype(np.int64) for s in sets]
            starts = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.empty(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc", "d1", "d2", name])

    rows = df.select(any_id(row_id).alias("doc"), F.col(text).alias("body"))
    return rows.mapInArrow(read, f"doc long, d1 long, d2 long, {name} array<long>")


def differences(pairs: DataFrame, df: DataFrame, row_id: str, text: str, classes: DataFrame, percent: int, ngram: int) -> DataFrame:
    """Pairs ``doc, pivot`` with ``n``, ``is_linked`` and what sets the document apart from the pivot:
    ``removed`` (places in the pivot's sorted set) and ``added`` (elements).

    The texts of the representatives travel and their sets are made inside the task: a set has 8 bytes a shingle that do not compress.
    Only texts of pivots travel to the side of the pivots.
    """
    tags = classes.select(F.col("rep").alias("doc"), F.col("rep_tag").alias("tag"))

    def side(name: str, body: str) -> DataFrame:
        texts = texts_of(df, row_id, text, pairs.select(F.col(name).alias("doc")).distinct().join(tags, "doc"))
        return texts.select(F.col("__doc").alias(name), F.col("__text").alias(body))

    both = pairs.join(side("doc", "t"), "doc").join(side("pivot", "p"), "pivot").select("doc", "pivot", "t", "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = [batch.column(i).dictionary_encode() for i in (2, 3)]  # a text that recurs is read once
            sets = [shingle_sets([x.encode() for x in t.dictionary.to_pylist()], ngram) for t in texts]
            ids = (batch.column(i).to_pylist() for i in (0, 1))
            for doc, pivot, i, j in zip(*ids, *(t.indices.to_pylist() for t in texts)):
                s, p = sets[0][i], sets[1][j]
                added = np.setdiff1d(s, p, assume_unique=True)
                removed = np.flatnonzero(~np.isin(p, s, assume_unique=True))
                near = (100 - percent) * (len(s) + len(p)) >= (100 + percent) * (len(added) + len(removed))
                out.append((doc, pivot, len(s), bool(near), removed.astype(np.int32), added.view(np.int64)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "pivot", "n", "is_linked", "removed", "added"])

    return both.mapInArrow(compare, "doc long, pivot long, n long, is_linked boolean, removed array<int>, added array<long>")


def _overlaps(left: pa.Table, right: pa.Table, name: str) -> np.ndarray:
    """Common elements of every left and right list, by a product of membership matrices over the elements both sides have."""
    flat = [t[name].combine_chunks() for t in (left, right)]
    values = [x.flatten().to_numpy() for x in flat]
    owners = [np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in flat]
    shared = np.intersect1d(*values)
    out = np.zeros((len(flat[0]), len(flat[1])), dtype=np.float32)
    for i in range(0, len(shared), 1000):
        part = shared[i : i + 1000]
        sides = []
        for x, owner, value in zip(flat, owners, values):
            at = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[at] == value
            m = np.zeros((len(x), len(part)), dtype=np.float32)
            m[owner[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def links_of_block(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between documents that lie near one pivot, from their differences to it alone.

    ``|x ^ y| = |dx| + |dy| - 2 |dx & dy|``, where ``dx`` is the difference of ``x`` to the pivot.
    """
    found = (np.empty(0, np.int64),) * 2
    if left.num_rows and right.num_rows:
        common = _overlaps(left, right, "removed") + _overlaps(left, right, "added")
        size = lambda t, c: np.diff(t[c].combine_chunks().offsets.to_numpy()).astype(np.float64)
        d = [size(t, "removed") + size(t, "added") for t in (left, right)]
        n = [t["n"].to_numpy().astype(np.float64) for t in (left, right)]
        apart = d[0][:, None] + d[1][None, :] - 2.0 * common
        i, j = np.nonzero((100 - percent) * (n[0][:, None] + n[1][None, :]) >= (100 + percent) * apart)
        found = left["doc"].to_numpy()[i], right["doc"].to_numpy()[j]
    return pa.table([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


#: Documents near one pivot that one task compares at a time.
BLOCK = 1500


def links_across(near: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between documents of one pivot that are not in one component yet.

    If two documents near a pivot are linked and not both linked to it, one of them is
    not; if both are, they are in its component. So only documents that are not linked to
    their pivot meet the others of that pivot, in blocks.
    """
    lab = labels.select(F.col("node").alias("__n"), "component")
    labelled = near.join(lab, F.col("doc") == F.col("__n"), "left").withColumn("component", F.coalesce("component", "doc")).drop("__n")
    open_ = labelled.groupBy("pivot").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"),
        F.count(F.when(~F.col("is_linked"), 1)).alias("loose"),
    ).filter("lo <> hi AND loose > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    open_ = cut(open_.select("pivot", blocks("loose").alias("nl"), blocks("rows").alias("nr")))
    rows = near.join(open_, "pivot")
    deal = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["pivot", "l", "r", "doc", "n", "removed", "added"]
    left = rows.filter("NOT is_linked").withColumn("l", deal("nl")).withColumn("r", every("nr")).select(columns)
    right = rows.withColumn("r", deal("nr")).withColumn("l", every("nl")).select(columns)
    right = right.toDF(*columns)  # columns of its own, as both sides come from the same rows
    met = left.groupBy("pivot", "l", "r").cogroup(right.groupBy("pivot", "l", "r"))
    return met.applyInArrow(lambda a, b: links_of_block(a, b, percent), "a long, b long").filter("a <> b")


def segment_keys(df: DataFrame, row_id: str, text: str, ngram: int, percent: int, classes: DataFrame, spare: bool = False) -> DataFrame:
    """``doc, key, whole`` of the representatives by the segments of their sets.

    With ``spare`` no key is written here, keys have 48 bits, ``doc`` is 40 bits of the digest of the class, and rows may repeat.
    """
    largest = classes.agg(F.max("n")).first()[0] or 1
    bands = Bands(int(largest), percent)
    # one row per band: sizes grow by a ninth from band to band
    edges = F.array(*[F.lit(x) for x in bands.low])
    band = F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1
    held = {r["band"]: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}
    plan = bands.allocate([held.get(i, 0) for i in range(len(bands.low))], spare)

    keyed = set_arrays(df, row_id, text, lambda s: keys_of(s, bands, plan), "keys", ngram, spare).filter(F.size("keys") > 0)
    if spare:
        keyed = keyed.select(class_bits("d1").alias("doc"), "keys")
    else:
        reps = classes.select("d1", "d2", F.col("rep").alias("doc"))
        keyed = cut(keyed.join(reps, ["doc", "d1", "d2"], "left_semi").dropDuplicates(["doc", "d1", "d2"]).select("doc", "keys"))
    flat = keyed.select("doc", F.explode("keys").alias("k"))
    return flat.select("doc", F.shiftrightunsigned("k", 16 if spare else 1).alias("key"), (F.col("k") % 2 == 0).alias("whole"))


def class_bits(d1: str) -> Column:
    """40 bits of a digest."""
    return F.shiftrightunsigned(d1, 24)


def class_pairs(flat: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc, pivot`` of the representatives that share a key, from keys of classes (``segment_keys`` with ``spare``).

    Keys travel once. A class gives a key once per partition, so a key has as many rows as classes that share it, which only
    near copies do in great number, and at most one for each partition more. Keys and classes travel in few bits: those
    that are equal by chance give more pairs, never fewer, as classes of equal bits meet whatever their keys are.
    """
    order = Window.partitionBy("key").orderBy(F.desc("whole"), "doc")
    pivot = F.first(F.when(F.col("whole"), F.col("doc"))).over(order)
    pairs = flat.withColumn("pivot", pivot).filter("doc <> pivot").select("doc", "pivot").distinct()
    named = lambda c: classes.select(class_bits("d1").alias(c), F.col("rep").alias(f"{c}_rep"))
    alike = named("doc").join(named("pivot"), F.col("doc") == F.col("pivot")).filter("doc_rep > pivot_rep")
    pairs = pairs.join(named("doc"), "doc").join(named("pivot"), "pivot").filter("doc_rep <> pivot_rep")
    reps = ("doc_rep", "pivot_rep")
    return pairs.select(*reps).union(alike.select(*reps)).toDF("doc", "pivot").distinct()


def texts_of(df: DataFrame, row_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``__doc, __text`` of the rows ``doc, tag``, each once.

    Most texts are not wanted and need not be shuffled: at most ``ID_BUCKETS`` numbers are broadcast.
    """
    texts = df.select(any_id(row_id).alias("__doc"), F.xxhash64(text).alias("__tag"), F.col(text).alias("__text"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("int").alias("bucket")
    texts = texts.withColumn("bucket", bucket("__doc")).join(F.broadcast(wanted.select(bucket("doc")).distinct()), "bucket", "left_semi")
    same = (F.col("__doc") == F.col("doc")) & (F.col("__tag") == F.col("tag"))
    return texts.drop("bucket").join(wanted, same, "left_semi").dropDuplicates(["__doc", "__tag"])


def common_elements(df: DataFrame, row_id: str, text: str, ngram: int, classes: DataFrame) -> np.ndarray:
    """Elements of very many sets, the rarer first: those of ``SAMPLE_HITS`` or more sets of a sample of about ``SAMPLE_SETS``.

    At most the elements of the sample divided by ``SAMPLE_HITS`` come to the driver.
    """
    total = max(classes.count(), 1)
    limit = int(min(1.0, SAMPLE_SETS / total) * 2**32)
    some = classes.filter(F.pmod(F.xxhash64("d1", "d2"), F.lit(2**32)) < limit)
    texts = texts_of(df, row_id, text, some.select(F.col("rep").alias("doc"), F.col("rep_tag").alias("tag")))
    held = set_arrays(texts, "__doc", "__text", lambda s: s, "s", ngram).select(F.explode("s").alias("key"))
    held = held.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= SAMPLE_HITS).toPandas()
    key = held["key"].to_numpy(dtype=np.int64)
    return key[np.lexsort((key, held["c"].to_numpy()))]


def rare_keys(df: DataFrame, row_id: str, text: str, ngram: int, percent: int, classes: DataFrame) -> DataFrame:
    """``doc, key, whole`` of the representatives by the rarest elements of their sets.

    In one order of all elements, sets of the wanted similarity share one of their first
    ``n - ceil(n percent / 100) + 1``. The order: elements of one class; others by the number of rows that hold them; last the
    elements that a sample finds in very many sets. Those of one class are only counted, those of very many are not
    shuffled: they are keys of their own where a set has hardly anything else. The rest is shuffled once, with its class, so no
    element that a fixed share of all sets holds is dealt to one task.

    Classes travel as 64 bits of their digest. Where two classes have these in common, all their elements are keys.
    """
    common = common_elements(df, row_id, text, ngram, classes)
    by_value = np.argsort(common)
    sorted_common = common[by_value].view(np.uint64)
    order = np.argsort(sorted_common)
    sorted_common, place = sorted_common[order], by_value[order]

    def split(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of a set that are not common, and the places of the others in their order."""
        at = np.searchsorted(sorted_common, s)
        hit = np.zeros(len(s), dtype=bool)
        inside = at < len(sorted_common)
        hit[inside] = sorted_common[at[inside]] == s[inside]
        return s[~hit], np.sort(place[at[hit]])

    def first_common(s: np.ndarray) -> np.ndarray:
        """The common elements among the first of the order."""
        rest, held = split(s)
        length = len(s) + (-len(s) * percent) // 100 + 1
        return common[held[: max(0, length - len(rest))]].view(np.uint64)

    def counted(s: np.ndarray) -> np.ndarray:
        """The elements that are not common, as numbers from 0 on, and a negative number that tells how many are common."""
        rest, held = split(s)
        rest = np.unique(rest >> np.uint64(1)).view(np.int64)
        if not len(held):
            return rest
        own = int(np.sum(kernels.mix(s), dtype=np.uint64) >> np.uint64(25))  # spreads these numbers over all tasks
        return np.append(rest, np.int64(-(own * _MOST + len(held))))

    shared = cut(classes.groupBy("d1").agg(F.count("*").alias("k")).filter("k > 1").select("d1"))
    flat = set_arrays(df, row_id, text, counted, "s", ngram).select("d1", F.explode("s").alias("key"))
    flat = flat.repartition("key").groupBy("key", "d1").agg(F.count("*").alias("c"))
    of_key = Window.partitionBy("key")
    flat = flat.withColumns({"c": F.sum("c").over(of_key), "k": F.count("*").over(of_key)}).filter("k > 1 OR key < 0")
    flat = flat.withColumn("held", F.when(F.col("key") < 0, (-F.col("key") % _MOST).cast("int")).otherwise(0))
    element = F.when(F.col("held") == 0, F.struct("c", "key"))
    known = flat.groupBy("d1").agg(F.array_sort(F.collect_list(element)).alias("known"), F.max("held").alias("held"))
    known = known.join(classes.select("d1", "n", F.col("rep").alias("doc"), "rep_tag"), "d1").join(shared, "d1", "left_anti")
    # of n - held elements that are not common, those of one class are n - held - size(known)
    reach = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    length = F.size("known") + F.col("held") + reach - F.col("n")
    first = F.slice("known", 1, F.greatest(length.cast("int"), F.lit(0)))
    crowded = (F.col("held") > 0) & (reach > F.col("n") - F.col("held"))
    known = known.select("doc", F.col("rep_tag").alias("tag"), first["key"].alias("keys"), crowded.alias("crowded"))
    known = cut(known.filter("crowded OR size(keys) > 0"))
    out = known.select("doc", F.explode("keys").alias("key"))
    # sets of hardly anything but common elements, and classes that share half of their digest
    crowded = known.filter("crowded").select("doc", "tag")
    alike = classes.join(shared, "d1", "left_semi").select(F.col("rep").alias("doc"), F.col("rep_tag").alias("tag"))
    for some, make in ((crowded, lambda s: first_common(s) >> np.uint64(1)), (alike, lambda s: s >> np.uint64(1))):
        more = set_arrays(texts_of(df, row_id, text, some), "__doc", "__text", make, "s", ngram)
        out = out.unionByName(more.select("doc", F.explode("s").alias("key")))
    return cut(out).withColumn("whole", F.lit(True))


def jaccard_classes(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = NGRAM, rare: bool = False,
    spare: bool = False,
) -> DataFrame:
    """One row per row of ``df``: ``doc, tag, n, component``; ``tag`` is the hash of the text.

    ``n`` is the number of distinct shingles of ``n`` words, ``component`` the least document that
    links reach. Null, empty and white texts have no set and reach nothing but themselves.
    Null ids are one document below all others. Rows that share an id but not a text are
    linked as their texts are. Other columns are not read. ``rare`` and ``spare`` only change the cost, for thresholds
    under about 90: keys are rare elements and not segments, or segments of schemes with spare ones.
    """
    short_batches(df.sparkSession)
    rows = cut(set_digests(df, row_id, text, n))
    with_set = rows.filter("n > 0")
    classes = with_set.groupBy("d1", "d2").agg(F.min(F.struct("doc", "tag")).alias("r"), F.first("n").alias("n"))
    classes = classes.select("d1", "d2", "n", F.col("r.doc").alias("rep"), F.col("r.tag").alias("rep_tag"))
    classes = cut(classes)
    if spare and not rare:
        pairs = cut(class_pairs(segment_keys(df, row_id, text, n, percent, classes, True), classes))
    else:
        flat = (rare_keys if rare else segment_keys)(df, row_id, text, n, percent, classes)
        shared = flat.groupBy("key").agg(F.count("*").alias("c"), F.min(F.when(F.col("whole"), F.col("doc"))).alias("pivot"))
        shared = cut(shared.filter("c > 1 AND pivot IS NOT NULL").select("key", "pivot"))
        pairs = cut(flat.join(shared, "key").filter("doc <> pivot").select("doc", "pivot").distinct())
    near = cut(differences(pairs, df, row_id, text, classes, percent, n))

    first = near.filter("is_linked").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    found = cut(components(first))
    across = cut(links_across(near, found, percent))
    joined = components(first.unionByName(across))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & (F.col("n") > 0), "left")
    return out.select("doc", "tag", "n", F.coalesce("component", "doc").alias("component"))
