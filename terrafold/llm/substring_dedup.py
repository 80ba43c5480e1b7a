"""Removal of repeated passages by hashing lines and sentences.

Units are the lines of a text and, where a line has more than one, its
sentences (up to ``.``, ``!`` or ``?`` before white space). A unit of at least
``min_words`` words is normalised (lower case, white space collapsed) and becomes
a 128-bit digest with document, start and end in the original text. The digests
are grouped globally; the occurrence of the least (document, start) stays and all
others go. A removed line covers its sentences.

With ``runs``, shorter units count too: from every unit of fewer words, the shortest run
of units after it and the shortest run before it that together have ``min_words`` words
are units as well. So a repeated run of whole units of that many words goes entirely,
whatever surrounds it.

With ``run_words``, units that repeat one by one in otherwise different texts stay: what goes, joined over units
that overlap or follow one another, must have that many words. A repeated passage seldom begins and ends with units;
with ``ends``, words that it may have in the units before and after are counted too, so whatever whole units lie in
a repeated passage of ``run_words`` words go.

A document is an id with a text: texts that share an id (null ids too) are different documents, and
repeats of a row are the same one. Only digests are shuffled. Groups are counted on the map side first; the side of
a hot digest in the join back can be split.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import any_id, cut, short_batches

MIN_WORDS = 8
#: Least words of what goes in one piece, in the registered query.
RUN_WORDS = 40
LINE = re.compile(r"[^\n]+")
SENTENCE_END = re.compile(r"[.!?]+\s+")


def unit_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every line, and of every sentence of lines that have more than one."""
    for line in LINE.finditer(text):
        start, end = line.span()
        yield start, end
        at = start
        for stop in SENTENCE_END.finditer(text, start, end):
            if stop.end() == end and at == start:
                break
            yield at, stop.end()
            at = stop.end()
        if start < at < end:
            yield at, end


def text_units(text: str, min_words: int, runs: bool) -> list[tuple[int, int, int, int, int, int, str]]:
    """Start, end, place of the first word and of the one after the last, words of the lowest units before and after, and
    normalised words of every unit long enough.

    With ``runs`` also those of the shortest runs of ``min_words`` words that begin or end with a shorter unit. Words are cut and
    normalised once, in the lowest units (a line of several sentences is followed by the first of them); others join theirs.
    """
    spans = list(unit_spans(text))
    lowest, norms, counts, lines = [], [], [], []
    for (a, b), (c, _) in zip(spans, [*spans[1:], (len(text) + 1, 0)]):
        if b <= c:
            words = text[a:b].split()
            lowest.append((a, b))
            counts.append(len(words))
            norms.append(" ".join(words).lower())
        else:
            lines.append((a, b, len(lowest)))
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    starts = [a for a, _ in lowest]
    ranges = {(a, b): (i, bisect_left(starts, b)) for a, b, i in lines}
    ranges |= {span: (k, k + 1) for k, span in enumerate(lowest)}
    if runs:
        held = np.flatnonzero(counts)
        after = np.searchsorted(total, total[:-1] + min_words)
        before = np.searchsorted(total, total[1:] - min_words, side="right") - 1
        for k in held[np.array(counts, dtype=np.int64)[held] < min_words].tolist():
            if after[k] < len(total):
                ranges.setdefault((lowest[k][0], lowest[after[k] - 1][1]), (k, int(after[k])))
            if before[k] >= 0:
                ranges.setdefault((lowest[before[k]][0], lowest[k][1]), (int(before[k]), k + 1))
    places = total.tolist()
    before, after = [0], [0]  # words of the nearest unit that has any
    for n in counts:
        before.append(n or before[-1])
    for n in reversed(counts):
        after.append(n or after[-1])
    after.reverse()
    return [
        (a, b, places[i], places[j], before[i], after[j], norms[i] if j == i + 1 else " ".join(x for x in norms[i:j] if x))
        for (a, b), (i, j) in ranges.items()
        if places[j] - places[i] >= min_words
    ]


def unit_digests(df: DataFrame, row_id: str, text: str, min_words: int, runs: bool = False) -> DataFrame:
    """``doc, tag, start, end, w0, w1, before, after, h1, h2`` of every unit long enough.

    ``tag`` is the hash of the text, ``start`` and ``end`` are code points of it, ``w0`` and ``w1`` the places of the unit's
    first word and of the one after its last among all words of the text, ``before`` and ``after`` the words of the lowest units beside it.
    """
    short_batches(df.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, spans, keys = [], [], [], []
            for doc, body, tag in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for *span, norm in text_units(body or "", min_words, runs):
                    docs.append(doc)
                    tags.append(tag)
                    spans.append(span)
                    keys.append(xxhash.xxh3_128_digest(norm.encode()))
            place = np.array(spans, dtype=np.int32).reshape(-1, 6)
            key = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), *(pa.array(c) for c in (*place.T, *key.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "start", "end", "w0", "w1", "before", "after", "h1", "h2"])

    read = df.select(any_id(row_id).alias("doc"), F.col(text).alias("body"), F.xxhash64(text).alias("tag"))
    return read.mapInArrow(digests, "doc long, tag long, start int, end int, w0 int, w1 int, before int, after int, h1 long, h2 long")


def repeated_units(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, runs: bool = False, run_words: int = 0,
    ends: bool = False,
) -> DataFrame:
    """One row per unit to remove: ``doc, tag, start, end, first_doc, first_start, run_start, run_words``.

    ``first_doc`` and ``first_start`` are the occurrence that stays, the least by
    (document, text hash, start); null ids come first. Texts that share an id are different documents; exact
    repeats of a row do not count against each other. Null and empty texts have no units. Other columns are not
    read. With ``runs``, runs of shorter units are units; one that overlaps its first occurrence stays.
    ``run_start`` and ``run_words`` tell the run of units without a word between them that the unit is part of; units of
    runs of fewer than ``run_words`` words are not returned. With ``ends``, a run also counts (for this only) all words but one of the
    units before and after it, which the passage may have in common with its first occurrence.
    """
    # digests are made twice: that costs less than to write them
    units = unit_digests(df, row_id, text, min_words, runs)
    groups = units.groupBy("h1", "h2").agg(
        F.count("*").alias("n"),
        F.min(F.struct(*[F.col(c).alias(f"first_{c}") for c in ("doc", "tag", "start", "end")])).alias("f"),
    )
    groups = cut(groups.filter(F.col("n") > 1).select("h1", "h2", "f.*"))
    elsewhere = (F.col("doc") != F.col("first_doc")) | (F.col("tag") != F.col("first_tag"))
    later = elsewhere | (F.col("start") >= F.col("first_end") if runs else F.col("start") != F.col("first_start"))
    gone = units.join(groups, ["h1", "h2"]).filter(later)
    gone = gone.select("doc", "tag", "start", "end", "w0", "w1", "before", "after", "first_doc", "first_start")
    gone = gone.repartition("doc", "tag").distinct()  # repeats of a row; the windows keep this dealing
    # units in order of their words: a run ends where the next unit starts after all words so far
    order = W.partitionBy("doc", "tag").orderBy("w0", "w1", "start", "end")
    reached = F.max("w1").over(order.rowsBetween(W.unboundedPreceding, -1))
    gone = gone.withColumn("__run", F.sum(F.when(F.col("w0") <= reached, 0).otherwise(1)).over(order))
    run = W.partitionBy("doc", "tag", "__run")
    gone = gone.withColumns({"run_start": F.min("start").over(run), "run_words": F.max("w1").over(run) - F.min("w0").over(run)})
    length = F.col("run_words")
    if ends:
        beside = (F.min_by("before", "w0").over(run), F.max_by("after", "w1").over(run))
        gone = gone.withColumn("__ends", sum(F.greatest(n - 1, F.lit(0)) for n in beside))
        length = length + F.col("__ends")
    return gone.filter(length >= run_words).drop("__run", "__ends", "w0", "w1", "before", "after")


def remove_units(df: DataFrame, gone: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the units of ``repeated_units`` cut out of ``text``; all other columns and rows stay.

    A row loses the units of its own id and text. Adds ``removed``, the removed spans of the original text, merged
    and in order (null: none), in place of a column of that name.
    """
    short_batches(df.sparkSession)
    spans = gone.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans")
    )

    @F.pandas_udf("struct<text:string,removed:array<struct<start:long,end:long>>>")
    def without(bodies: pd.Series, lists: pd.Series) -> pd.DataFrame:
        texts, removed = [], []
        for body, found in zip(bodies, lists):
            if body is None or found is None:
                texts.append(body)
                removed.append(None)
                continue
            merged: list[list[int]] = []
            for span in found:
                start, end = int(span["start"]), min(int(span["end"]), len(body))
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                elif start < end:
                    merged.append([start, end])
            edges = [0, *(x for span in merged for x in span), len(body)]
            texts.append("".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append([{"start": a, "end": b} for a, b in merged])
        return pd.DataFrame({"text": texts, "removed": removed})

    keyed = df.withColumns({"__id": any_id(row_id), "__text": F.xxhash64(text)})
    joined = keyed.join(spans, (F.col("__id") == F.col("__doc")) & (F.col("__text") == F.col("__tag")), "left")
    joined = joined.withColumn("__out", without(F.col(text), F.col("__spans")))
    return joined.select(
        *[F.col("__out.text").alias(c) if c == text else F.col(c) for c in df.columns if c != "removed"],
        F.col("__out.removed").alias("removed"),
    )
