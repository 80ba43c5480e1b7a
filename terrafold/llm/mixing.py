"""Mixing sources to target weights, in fixed-length blocks of tokens.

1. Every source is a stream: its documents in hash order, end to end. Tokens are
   packed into blocks of ``block`` tokens; a document covers a run of blocks.
2. Every output shard draws how many of its slots each source fills, from a
   multinomial with the target shares (in two steps: groups of sources, then
   sources within the group, so that no task holds more than the square root of
   all sources). Draws beyond a source's quota go to sources that fell short.
3. The slots of a source are numbered through its shards. Slot ``t`` takes block
   ``permutation(source, t div n_blocks)(t mod n_blocks)``: every pass over a
   source visits each block once, in a new pseudorandom order.
4. Slots and blocks meet by (source, block).

All choices come from hashes of source, shard and seed, so reruns agree. Streams
are numbered by hash slices, so a source with a third of all rows spreads out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import with_running_sum
from .common import WORD, any_id, cut, let

BLOCK = 32
SHARD_SLOTS = 4096
SEED = 17
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Rows of one slice of a stream, on average.
SLICE_ROWS = 5000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target``: ``share`` of all tokens by weight, no source above ``cap`` times its size.

    Weights repeat over the sources in code point order, null last. What a capped
    source leaves is shared by weight among the others until none is above: in the
    end all others get the same number of tokens per weight, ``level``. Sources sorted
    by how soon they reach their cap give it with running sums; the input has one row
    per source and is summed before it gets here.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    # the first source whose cap is not reached fixes the level of all that follow
    reached = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.first(reached, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select(
        "source", "source_size", F.coalesce(F.least(level * F.col("weight"), F.col("limit")), F.col("limit")).alias("target")
    )


def streams(df: DataFrame, row_id: str, source: str, size: Column) -> DataFrame:
    """``doc, tag, source, size, start``: where each row begins in its source's stream.

    ``tag`` is the hash that orders the stream; rows with equal id and tag are
    interchangeable, and each gets a place of its own.
    """
    rows = df.select(
        any_id(row_id).alias("doc"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(row_id, "text").alias("tag")
    )
    rows = cut(rows)
    slices = max(1, rows.count() // SLICE_ROWS)
    chunk = F.floor((F.col("tag") / 2.0**64 + 0.5) * slices)
    order = [F.col("tag"), F.col("doc"), F.col("size")]
    placed = with_running_sum(rows, ["source"], chunk, order, F.col("size"), "end")
    return cut(placed.withColumn("start", F.col("end") - F.col("size")).drop("end"))


def _seeded(*parts: int) -> np.random.Generator:
    return np.random.default_rng([int(p) & (2**63 - 1) for p in parts])


def shard_draws(quotas: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, source, n``: the multinomial draw of each shard. ``quotas`` has one row per source."""
    count, total = quotas.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    width = max(1, math.isqrt(count))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    numbered = quotas.filter("quota > 0").withColumn("rank", F.row_number().over(order) - 1)
    numbered = numbered.withColumn("group", F.floor(F.col("rank") / width).cast("long"))
    groups = numbered.groupBy("group").agg(
        F.sum("quota").alias("quota"), F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("members")
    )
    all_groups = groups.agg(F.sort_array(F.collect_list(F.struct("group", "quota")))).alias("groups").scalar()
    shards = quotas.sparkSession.range(-(-total // shard_slots)).withColumnRenamed("id", "shard")
    shards = shards.withColumn("slots", F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots))

    def split(salt: int, part: str, weights: str):
        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    names = np.array([m[part] for m in row[weights]], dtype=np.int64)
                    shares = np.array([m["quota"] for m in row[weights]], dtype=np.float64)
                    got = _seeded(seed, salt, row["shard"], row.get("group", 0)).multinomial(row["slots"], shares / shares.sum())
                    out.append(pd.DataFrame({"shard": row["shard"], part: names[got > 0], "slots": got[got > 0]}))
                yield pd.concat(out) if out else pd.DataFrame({"shard": [], part: [], "slots": []})

        return draw

    first = shards.withColumn("groups", all_groups).mapInPandas(split(1, "group", "groups"), "shard long, group long, slots long")
    second = first.join(groups.select("group", "members"), "group")
    drawn = second.mapInPandas(split(2, "rank", "members"), "shard long, rank long, slots long")
    return drawn.join(numbered.select("rank", "source"), "rank").select("shard", "source", F.col("slots").alias("n"))


def permuted(key: Column, n: Column, index: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 that ``key`` picks, at ``index`` (a Feistel network with cycle walking)."""

    @F.pandas_udf("long")
    def walk(keys: pd.Series, sizes: pd.Series, places: pd.Series) -> pd.Series:
        k, size, x = (s.to_numpy(dtype=np.int64).astype(np.uint64) for s in (keys, sizes, places))
        half = np.ones(len(x), dtype=np.uint64)
        while (small := (np.uint64(1) << (half + half)) < size).any():
            half[small] += np.uint64(1)
        mask = (np.uint64(1) << half) - np.uint64(1)
        todo = np.arange(len(x))
        while len(todo):
            l, r, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
            for turn in range(4):
                f = (r + k[todo] + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                l, r = r, l ^ ((f >> np.uint64(32)) & m)
            x[todo] = (l << half[todo]) | r
            todo = todo[x[todo] >= size[todo]]
        return pd.Series(x.astype(np.int64))

    return walk(key, n, index)


def slot_plan(quotas: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, slot, source, epoch, block``: which block each output slot takes.

    ``quotas`` has ``source, quota, n_blocks``. Each source fills exactly its quota.
    """
    draws = cut(shard_draws(quotas, shard_slots, seed))
    # number the slots of each source through the shards
    ends = with_running_sum(draws, ["source"], F.floor(F.col("shard") / 4096), [F.col("shard")], F.col("n"), "end")
    slots = ends.select("shard", "source", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("t"))
    drawn = draws.groupBy("source").agg(F.sum("n").alias("drawn"))
    held = quotas.join(drawn.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    held = cut(held.withColumn("drawn", F.coalesce("drawn", F.lit(0))))
    known = held.select(F.col("source").alias("__s"), "quota")
    placed = slots.join(known, slots["source"].eqNullSafe(known["__s"])).drop("__s")
    # draws beyond a quota, and the places they fill instead, are numbered the same way
    order = W.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    over = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))
    under = F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    numbered = held.withColumns({"over0": F.coalesce(F.sum(over).over(order), F.lit(0)), "under0": F.coalesce(F.sum(under).over(order), F.lit(0))})
    offsets = numbered.select(F.col("source").alias("__s"), "over0")
    spare = placed.filter("t >= quota").join(offsets, F.col("source").eqNullSafe(F.col("__s")))
    spare = spare.select("shard", (F.col("over0") + F.col("t") - F.col("quota")).alias("place"))
    short = numbered.filter(under > 0).select(
        "source", "drawn", "under0", F.explode(F.sequence(F.lit(0).cast("long"), under - 1)).alias("j")
    )
    short = short.select("source", (F.col("drawn") + F.col("j")).alias("t"), (F.col("under0") + F.col("j")).alias("place"))
    moved = spare.join(short, "place").select("shard", "source", "t")
    filled = placed.filter("t < quota").select("shard", "source", "t").unionByName(moved)
    sizes = held.select(F.col("source").alias("__s"), "n_blocks")
    filled = filled.join(sizes, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    epoch = F.floor(F.col("t") / F.col("n_blocks"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", epoch), 1)
    return filled.select(
        "shard", "source", F.col("t").alias("slot"), epoch.alias("epoch"), permuted(key, F.col("n_blocks"), F.col("t") % F.col("n_blocks")).alias("block")
    )


def block_pieces(placed: DataFrame, block: int) -> DataFrame:
    """``doc, tag, source, start, block, skip, n``: the tokens ``skip .. skip + n`` of a document in each of its blocks."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.filter("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("doc", "tag", "source", "start", "block", (low - F.col("start")).alias("skip"), (high - low).alias("n"))


class Mixture:
    """The parts of one mix; all DataFrames.

    ``placed``: ``doc, tag, source, size, start`` of every row. ``targets``: ``source,
    source_size, target``. ``slots``: ``shard, source, slot, epoch, block``. ``taken``:
    ``doc, tag, source, start, epoch, skip, n``, the tokens each pass takes from a row.
    """

    def __init__(self, placed: DataFrame, targets: DataFrame, slots: DataFrame, block: int):
        self.placed, self.targets, self.slots = placed, targets, slots
        pieces = block_pieces(placed, block).withColumnsRenamed({"source": "__s", "block": "__b"})
        same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))
        self.taken = slots.join(pieces, same).select("doc", "tag", "source", "start", "epoch", "skip", "n")


def mix(
    df: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mixture:
    """Mix the rows of ``df`` (see the module).

    Sizes are words; null and empty texts have none and are never taken. Rows
    without a source form the last one. A source's quota is its target in blocks,
    rounded, so with ``cap`` 2 no block is visited more than twice. Repeated rows have
    places of their own. An empty table gives empty parts. Other columns are not read.
    """
    read = df.select(F.col(row_id), F.col(text).alias("text"), F.col(source))
    placed = streams(read, row_id, source, n_words(F.col("text")))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, cap))
    quotas = targets.select(
        "source",
        F.round(F.col("target") / block).cast("long").alias("quota"),
        F.ceil(F.col("source_size") / block).alias("n_blocks"),
    ).filter("n_blocks > 0")
    quotas = quotas.withColumn("quota", F.least("quota", F.col("n_blocks") * int(cap)))
    return Mixture(placed, targets, slot_plan(quotas, shard_slots, seed), block)


#: A word with the white space after it.
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def mixed_documents(df: DataFrame, mixture: Mixture, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix as rows of ``df``: one per document and pass, ``text`` cut to the words that the pass takes.

    A document taken whole keeps its text as it is; documents that no pass takes go. Rows
    with equal id and text are the same document and come as often as they are taken;
    the other columns of one of them stand for all.
    """
    ranges = mixture.taken.groupBy("doc", "tag", "source", "start", "epoch").agg(
        F.sum("n").alias("__taken"), F.sort_array(F.collect_list(F.struct("skip", "n"))).alias("__ranges")
    )
    ranges = ranges.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), "__taken", "__ranges")
    texts = df.withColumns({"__id": any_id(row_id), "__key": F.xxhash64(row_id, text)}).dropDuplicates(["__id", "__key"])
    joined = texts.join(ranges, (F.col("__id") == F.col("__doc")) & (F.col("__key") == F.col("__tag")))
    part = lambda ws: F.transform(
        "__ranges", lambda r: F.array_join(F.slice(ws, (r["skip"] + 1).cast("int"), r["n"].cast("int")), "")
    )
    cut_text = let(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda ws: F.array_join(part(ws), ""))
    shown = F.when(F.col("__taken") == n_words(F.col(text)), F.col(text)).otherwise(cut_text)
    return joined.select(*[shown.alias(c) if c == text else F.col(c) for c in df.columns])
