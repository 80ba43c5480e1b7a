"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import use_settings
from . import (
    bpe_duckdb, chat_trees, divergence, host_rules, language_id, lexical_search, line_dedup, mixing, ngram_join, quality_fm,
    substring_dedup, topk_search, toxicity,
)
from .common import documents, id_remainder
from .oracle import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The rank file of the encoding operator.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(name: str):
    def wrap(build):
        QUERIES[name] = lambda spark, folder: build(use_settings(spark), folder)
        return build

    return wrap


def real_id(name: str):
    """``any_id`` undone."""
    return F.when(F.col(name) != -(2**63), F.col(name))


@query("op1_topk_search")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op2_chat_trees")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = chat_trees.chain(rows.unionByName(added), "conv_id", "turn", "role", "text")
    done = chat_trees.format_trees(messages)
    turns = chat_trees.parse_turns(F.col("formatted"))
    texts = chat_trees.loss_texts(F.col("formatted"), F.col("loss"))
    told = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = done.select(
        F.col("tree").alias("conv_id"), F.length("formatted").alias("formatted_chars"), turns.alias("turns"),
        F.array_join(texts, "").alias("under_loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", told), ""), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query("op3_substring_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    gone = substring_dedup.repeated_units(documents(spark, folder), runs=True, run_words=substring_dedup.RUN_WORDS, ends=True)
    return gone.select(
        real_id("doc").alias("doc_id"), "start", "end", real_id("first_doc").alias("first_doc_id"), "first_start", "run_start", "run_words"
    )


@query("op4_host_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.host_verdicts(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs, ~held_out, RANKS)
    return language_id.with_language(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query("op6_ngram_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.jaccard_classes(documents(spark, folder))
    return found.select(
        real_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real_id("component").alias("component_id")
    )


@query("op7_line_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op8_quality_fm")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    model = quality_fm.train(docs, labels, ~held_out)
    return quality_fm.with_score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted")
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    read = bpe_duckdb.encode_decode(documents(spark, folder).select("doc_id", "text"), "text", RANKS, PATTERN)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    mixture = mixing.mix(documents(spark, folder))
    key = ["doc", "tag", "source", "start"]
    taken = mixture.taken.groupBy(*key).agg(F.sum("n").alias("taken")).withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.col("source").eqNullSafe(F.col("__source"))
    for k in ("doc", "tag", "start"):
        same = same & (F.col(k) == F.col(f"__{k}"))
    rows = mixture.placed.join(taken, same & (F.col("size") > 0), "left")
    targets = mixture.targets.withColumnRenamed("source", "__t")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__t")))
    return rows.select(
        real_id("doc").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


@query("op11_divergence_audit")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder)).select("lang", "source", "part", "item", "value", "rank")


@query("op12_lexical_search")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = lexical_search.search(documents(spark, folder), items)
    return found.select(real_id("item").alias("item_id"), "rank", real_id("doc").alias("doc_id"), "score")


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.with_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )
