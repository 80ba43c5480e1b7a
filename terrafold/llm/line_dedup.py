"""Line deduplication that returns keep bitmaps.

1. Every line long enough becomes a 128-bit digest with its document and
   position. No text leaves the scan.
2. The digests are range-partitioned by (digest, document) and sorted within
   partitions by document and position. A line held by a third of all documents
   spreads over many ranges. Each range streams the first occurrence of a line in a
   document and sends on one row per digest: how many documents, and the largest.
3. The digests of at least ``min_documents`` documents meet the digest rows again.
   The lines outside the keeper become bits, 64 lines to a word; words without a
   dropped line are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import any_id, cut, let, lower_ascii, split_lines, strip_white

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def line_key(line: Column) -> Column:
    return lower_ascii(strip_white(line))


def digests(df: DataFrame, row_id: str, text: str, min_chars: int) -> DataFrame:
    """``doc, tag, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points."""
    lines = df.select(
        any_id(row_id).alias("doc"), F.xxhash64(text).alias("tag"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")
    )
    keyed = lines.select("doc", "tag", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(
    df: DataFrame, row_id: str, text: str, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Rows ``doc, tag, n_dropped, dropped`` for the documents that lose lines.

    ``dropped`` is ``array<struct<word, bits>>`` in order of ``word``: bit ``p % 64`` of
    word ``p / 64`` is set if line ``p`` goes; a missing word means that its 64 lines stay.
    ``doc`` is the id (null ids are one document below all others), ``tag`` tells apart
    texts that share an id. Such texts count as one document. Ties cannot occur: the
    keeper is the largest id that holds the line, and keeps all its copies of it.
    """
    rows = cut(digests(df, row_id, text, min_chars))
    ranged = rows.repartitionByRange("h1", "h2", "doc")
    # equal (digest, document) are in one range: the window sorts there and streams, without another shuffle
    place = F.row_number().over(W.partitionBy("h1", "h2", "doc").orderBy("pos"))
    held = ranged.withColumn("place", place).filter(F.col("place") == 1)
    common = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    common = cut(common.filter(F.col("n") >= min_documents).drop("n"))
    gone = rows.join(common, ["h1", "h2"]).filter(F.col("doc") != F.col("keeper"))
    word = F.shiftright("pos", 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = gone.groupBy("doc", "tag", word).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "tag").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines whose bit is not set."""
    by_word = lambda m: F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("long"))
    )
    dense = let(F.map_from_entries(dropped), by_word)
    stays = lambda bits: F.filter(
        lines, lambda line, p: F.getbit(F.get(bits, F.shiftright(p, 6)), p % 64) == 0
    )
    return let(dense, stays)


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, row_id: str, text: str) -> DataFrame:
    """All columns of ``df`` with ``text`` cut to its kept lines, plus ``__n_lines`` and ``__n_dropped``.

    Texts without a dropped line stay as they are (null stays null). A text
    that loses every line becomes empty.
    """
    marks = bitmaps.select(*[F.col(c).alias(f"__{c}") for c in bitmaps.columns])
    keyed = df.withColumns({"__id": any_id(row_id), "__text_tag": F.xxhash64(text)})
    on = (F.col("__id") == F.col("__doc")) & (F.col("__text_tag") == F.col("__tag"))
    kept = let(split_lines(F.col(text)), lambda lines: F.array_join(kept_lines(lines, F.col("__dropped")), "\n"))
    n_lines = F.length(F.coalesce(F.col(text), F.lit("")))
    n_lines = n_lines - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return keyed.join(marks, on, "left").select(
        *[F.col(c) for c in df.columns if c != text],
        F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept).alias(text),
        n_lines.cast("long").alias("__n_lines"),
        F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("__n_dropped"),
    )


def dedup_lines(
    df: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``df`` without the lines that many documents share; see ``keep_bitmaps`` and ``apply_bitmaps``.

    Null and empty texts are one empty line, which is too short to go. Extra
    columns pass through. An empty table gives an empty table.
    """
    narrow = df.select(F.col(row_id), F.col(text))
    return apply_bitmaps(df, keep_bitmaps(narrow, row_id, text, min_chars, min_documents), row_id, text)
