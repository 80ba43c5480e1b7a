"""A corpus from raw documents: quality, repeated lines, near copies, mixing, tokens.

``STAGES`` lists the stages. Each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, the next one's ``docs``; all but the last return the columns of
``docs``. ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrafold.llm import bpe_duckdb, line_dedup, mixing, ngram_join, quality_fm
from terrafold.llm.common import any_id, cut, documents, id_remainder
from terrafold.llm.queries import PATTERN, RANKS
from terrafold.session import use_settings

#: Words of a shingle and least Jaccard similarity of near copies.
NGRAM, PERCENT = 5, 80


def _measured(df: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorisation machine scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learn = id_remainder("doc_id", 5) != 0
    machine = quality_fm.train(docs, labels, learn)
    scored = quality_fm.with_score(docs, machine, name="__score")
    return scored.filter(F.col("__score") >= quality_fm.THRESHOLD).drop("__score")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that five documents or more share, but in the last of them."""
    kept = line_dedup.dedup_lines(docs).drop("__n_lines", "__n_dropped")
    return _measured(kept.select(docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document of every group of linked ones. Documents without words are linked with nothing.

    Linked texts share 80 in 100 of their five-word shingles, or are linked through others, found by the segments of op6 (universe
    partition, one-deletion neighbourhoods) with spare segments; op6 has its own contract.
    """
    found = ngram_join.jaccard_classes(docs, n=NGRAM, percent=PERCENT, spare=True)
    stay = found.filter(F.col("doc") == F.col("component")).select(F.col("doc").alias("__doc"), F.col("tag").alias("__text_tag")).distinct()
    keyed = docs.withColumns({"__id": any_id("doc_id"), "__tag": F.xxhash64("text")})
    kept = keyed.join(stay, (F.col("__id") == F.col("__doc")) & (F.col("__tag") == F.col("__text_tag")), "left_semi")
    return kept.dropDuplicates(["__id", "__tag"]).drop("__id", "__tag")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their targets: one row per document and pass."""
    return _measured(mixing.mixed_documents(docs, mixing.mix(docs)))


def byte_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, and of what its tokens decode to."""
    read = bpe_duckdb.encode_decode(docs.select("doc_id", "source", "text"), "text", RANKS, PATTERN)
    return read.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", source_mix),
    ("byte-level BPE", byte_tokens),
]

#: SQL cannot express the fitted classifier; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage keeps is cut before the next reads it."""
    use_settings(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
