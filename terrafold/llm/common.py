"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of one Arrow batch. Rows may hold long texts, so batches are short.
BATCH_ROWS = 512


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame that later steps read more than once to the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. A purely local session
    without one (tests) gets a folder of its own; a cluster without one is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python in short batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def strip_white(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def id_remainder(row_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(row_id).cast("string").cast("binary")) % modulus


def any_id(row_id: str) -> Column:
    """The id with null put below every number, so that it can be a join key."""
    return F.coalesce(F.col(row_id).cast("long"), F.lit(-(2**63)).cast("long"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
