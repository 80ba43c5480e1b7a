"""Structured Streaming forms of the upsert and session jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from .. import fixed_values as fv
from ..operators.catalog import newest_versions
from ..operators.querylog import session_spans

# ---- catalog ----------------------------------------------------------------

#: Buckets of a catalog; fixed when its first snapshot is written.
BUCKETS = 256


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def snapshot_paths(spark: SparkSession, root: str) -> list[str]:
    """Pointer files of the finished snapshots under ``root``, oldest first."""
    fs, folder = _file_system(spark, root), _path(spark, root, "snapshots")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return [f"{root.rstrip('/')}/snapshots/{n}" for n in sorted(names) if n.startswith("v") and n.endswith(".json")]


def read_pointer(spark: SparkSession, path: str) -> dict:
    """``buckets``, their number, and ``folders``, the folder (below the root) of each bucket that has rows."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _write_pointer(spark: SparkSession, root: str, name: str, pointer: dict) -> None:
    """The file is written aside and renamed, so it is there whole or not at all."""
    fs = _file_system(spark, root)
    aside, final = _path(spark, root, "snapshots", f"_{name}"), _path(spark, root, "snapshots", name)
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
    out.close()
    if not fs.rename(aside, final):
        raise OSError(f"cannot rename {aside} to {final}")


def read_snapshot(spark: SparkSession, root: str, pointer: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a snapshot (the newest by default), or of some of its buckets; None where there are none."""
    if pointer is None:
        done = snapshot_paths(spark, root)
        if not done:
            return None
        pointer = read_pointer(spark, done[-1])
    folders = [f for b, f in sorted(pointer["folders"].items()) if only is None or int(b) in only]
    if not folders:
        return None
    return spark.read.option("mergeSchema", True).parquet(*[f"{root.rstrip('/')}/{f}" for f in folders])


def merge_into_snapshot(batch: DataFrame, root: str, batch_id: int, event_time: str, buckets: int = BUCKETS) -> list[int]:
    """Merge rows into the newest snapshot under ``root`` as snapshot ``batch_id`` and tell which buckets were written.

    A scene belongs to the bucket of its id's hash. Only buckets that the batch has rows for are read and written, to
    folders of this batch; the new pointer names these and the old folders of all others. It appears last and at once, so
    readers see the old snapshot or the new one, and a merge that fails leaves the old one. A batch that is already
    merged changes nothing.
    """
    spark, root = batch.sparkSession, root.rstrip("/")
    name = f"v{batch_id:012d}.json"
    done = snapshot_paths(spark, root)
    if done and done[-1].rsplit("/", 1)[1] >= name:
        return []
    pointer = read_pointer(spark, done[-1]) if done else {"buckets": buckets, "folders": {}}
    bucket = F.pmod(F.xxhash64("scene_id"), F.lit(pointer["buckets"])).cast("int")
    batch = batch.persist()
    try:
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most the number of buckets
        rows = batch
        old = read_snapshot(spark, root, pointer, touched)
        if old is not None:
            rows = old.unionByName(batch, allowMissingColumns=True)
        merged = newest_versions(rows, [F.desc_nulls_last(event_time)]).withColumn("__bucket", bucket)
        merged = merged.repartition("__bucket").sortWithinPartitions("__bucket", "dataset_origin", "acquisition_time")
        folder = f"data/v{batch_id:012d}"
        if touched:
            merged.write.mode("overwrite").partitionBy("__bucket").parquet(f"{root}/{folder}")
    finally:
        batch.unpersist()
    folders = {**pointer["folders"], **{str(b): f"{folder}/__bucket={b}" for b in touched}}
    _write_pointer(spark, root, name, {"buckets": pointer["buckets"], "folders": folders})
    return touched


def expire_snapshots(spark: SparkSession, root: str, keep: int = 10) -> None:
    """Delete all but the ``keep`` newest pointers, and the bucket folders that no kept pointer names."""
    fs, done = _file_system(spark, root), snapshot_paths(spark, root)
    kept = {f for p in done[-keep:] for f in read_pointer(spark, p)["folders"].values()}
    gone = {f for p in done[:-keep] for f in read_pointer(spark, p)["folders"].values()} - kept
    for path in done[:-keep]:
        fs.delete(_path(spark, path), False)
    for folder in gone:
        fs.delete(_path(spark, root, folder), True)


def catalog_upsert_stream(
    source: DataFrame, root: str, checkpoint: str, event_time: str = "ingested_at", buckets: int = BUCKETS
) -> StreamingQuery:
    """Merge a stream of scene rows into the catalog under ``root``, one snapshot per micro-batch (``read_snapshot``).

    The snapshots keep the event time, and the row of the latest event time wins (ties
    by content) however the stream is cut into micro-batches; late rows count like
    any others. The snapshot number is the batch number, so a batch run again after a
    failure replaces its own unfinished output and changes nothing if it had finished.
    """
    return (
        source.writeStream.foreachBatch(lambda batch, batch_id: merge_into_snapshot(batch, root, batch_id, event_time, buckets) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ---- sessions ---------------------------------------------------------------


def merged_spans(first: np.ndarray, last: np.ndarray, n: np.ndarray, idle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of time that are not more than ``idle`` apart become one; their counts are added."""
    order = np.lexsort((last, first))
    first, last, n = first[order], last[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], first[1:] - np.maximum.accumulate(last)[:-1] > idle])) if len(first) else np.empty(0, int)
    return (first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts)) if len(starts) else (first, last, n)


def session_windows(
    events: DataFrame, session: str = "session_id", time: str = "ts", watermark: str = "1 hour", hours: int = fv.SESSION_IDLE_HOURS
) -> DataFrame:
    """``session, n, first_ts, last_ts`` of the sessions that ``hours`` idle hours close. Rows without a time are in none.

    On a table all sessions are returned (``session_spans``). On a stream every input partition of a micro-batch
    merges its rows into partial sessions, of which a busy key has few; these meet the open sessions of their key in a
    stateful operator. A session comes out once, when the watermark is past its idle time, by a timer of its key; partial
    sessions that end before the watermark are late and dropped.
    """
    if not events.isStreaming:
        return session_spans(events, session, time, hours)
    idle, kind = hours * 3_600_000_000, events.schema[time].dataType
    key = StructField("session", events.schema[session].dataType)
    spans = [StructField(c, LongType()) for c in ("first", "last", "n")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for session_id, rows in batch.groupby("session", dropna=False, sort=False):
                at = rows["at"].to_numpy(dtype=np.int64)
                first, last, n = merged_spans(at, at, np.ones(len(at), dtype=np.int64), idle)
                same = pd.Series([None if pd.isna(session_id) else session_id] * len(first), dtype=object)
                yield pd.DataFrame({"session": same, "first": first, "last": last, "n": n})

    def keep(session_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        parts = [tuple(np.array(x, dtype=np.int64) for x in held)]
        parts += [tuple(b[c].to_numpy(dtype=np.int64) for c in ("first", "last", "n")) for b in batches]
        first, last, n = merged_spans(*(np.concatenate(x) for x in zip(*parts)), idle)
        # times beyond the idle time of the watermark can no longer be joined by a row that is not late
        closed = last + idle < state.getCurrentWatermarkMs() * 1000
        if closed.all():
            state.remove()
        else:
            state.update(tuple(x[~closed].tolist() for x in (first, last, n)))
            state.setTimeoutTimestamp(max(int((last[~closed].min() + idle) // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if closed.any():
            same = pd.Series([session_key[0]] * int(closed.sum()), dtype=object)
            yield pd.DataFrame({"session": same, "first": first[closed], "last": last[closed], "n": n[closed]})

    rows = events.filter(F.col(time).isNotNull()).select(F.col(session).alias("session"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    told = rows.mapInPandas(partial, StructType([key, *spans]))
    told = told.withColumn("__t", F.timestamp_micros("last")).withWatermark("__t", watermark)
    lists = "firsts array<long>, lasts array<long>, ns array<long>"
    found = told.groupBy("session").applyInPandasWithState(keep, StructType([key, *spans]), lists, "append", GroupStateTimeout.EventTimeTimeout)
    back = lambda c: F.timestamp_micros(c).cast(kind)
    return found.select(F.col("session").alias(session), "n", back("first").alias("first_ts"), back("last").alias("last_ts"))


def session_stream(events: DataFrame, path: str, checkpoint: str, **names) -> StreamingQuery:
    return (
        session_windows(events, **names)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
