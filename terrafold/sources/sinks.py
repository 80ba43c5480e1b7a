"""Writers: catalog snapshots, training files, manifest, vectors, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import l2_normalize


def write_snapshot(scenes: DataFrame, path: str) -> None:
    """Catalog snapshot: Parquet by origin, time-sorted within each file so that min/max statistics prune."""
    (
        scenes.sortWithinPartitions("dataset_origin", "acquisition_time")
        .write.mode("errorifexists")
        .partitionBy("dataset_origin")
        .parquet(path)
    )


def sink_training_jsonl(captions: DataFrame, vqa: DataFrame, referring: DataFrame, path: str) -> None:
    for name, rows in (("captions", captions), ("vqa", vqa), ("referring", referring)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def sink_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object, stamped with the time of writing."""
    manifest.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def vectors_table(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec``: normalised vectors, each with its id; zero vectors stay as they are."""
    return rows.select(F.col(key).alias("id"), l2_normalize(F.col(vector)).alias("vec"))


def sink_vectors(rows: DataFrame, key: str, vector: str, path: str) -> None:
    vectors_table(rows, key, vector).write.mode("overwrite").parquet(path)


def sink_eval_history(report: DataFrame, path: str, tag: str) -> None:
    report.withColumns({"tag": F.lit(tag), "date": F.current_timestamp()}).write.mode("append").json(path)
