"""Streaming jobs give the batch results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrafold.operators.ordered import balanced_chunks
from terrafold.operators.querylog import session_spans, session_ttl
from terrafold.streaming import jobs

SCHEMA = "scene_id string, object string, dataset_origin string, acquisition_time timestamp, ingested_at timestamp"


def rows_of(spark, root):
    return sorted((r.scene_id, r.object) for r in jobs.read_snapshot(spark, root).collect())


def test_upsert_stream(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "cat", "chk"))
    t = datetime(2024, 1, 1)

    def feed(items):
        rows = [(i, o, "t", t, t + timedelta(minutes=m)) for i, o, m in items]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.catalog_upsert_stream(stream, root, check).awaitTermination()

    feed([("a", "old", 1), ("b", "kept", 1), ("a", "newer", 2)])
    run()
    assert rows_of(spark, root) == [("a", "newer"), ("b", "kept")]
    feed([("a", "newest", 10), ("c", "added", 10)])
    run()
    assert rows_of(spark, root) == [("a", "newest"), ("b", "kept"), ("c", "added")]


def test_upsert_stream_equals_batch_under_any_cut(spark, tmp_path):
    t = datetime(2024, 1, 1)
    items = [("a", "late", 10), ("a", "early", 5), ("b", "x", 7), ("b", "y", 7), ("c", "old", -1500), ("b", "w", 3)]
    rows = [(i, o, "t", t, t + timedelta(minutes=m)) for i, o, m in items]
    found = set()
    for no, cuts in enumerate(([6], [1, 5], [2, 2, 2], [1] * 6, [3, 3])):
        for turn in (rows, rows[::-1]):
            base = tmp_path / f"{no}{turn is rows}"
            at = 0
            for size in cuts:
                spark.createDataFrame(turn[at : at + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
                at += size
                stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
                jobs.catalog_upsert_stream(stream, f"{base}/cat", f"{base}/chk").awaitTermination()
            found.add(tuple(rows_of(spark, f"{base}/cat")))
    assert found == {(("a", "late"), ("b", "y"), ("c", "old"))}


def test_a_small_batch_rewrites_one_bucket(spark, tmp_path):
    root, t = str(tmp_path / "cat"), datetime(2024, 1, 1)
    rows = [(f"s{i}", "old", "t", t, t) for i in range(300)]
    merge = lambda r, k: jobs.merge_into_snapshot(spark.createDataFrame(r, SCHEMA), root, k, "ingested_at", 16)
    assert merge(rows, 0) == list(range(16))
    before = jobs.read_pointer(spark, jobs.snapshot_paths(spark, root)[-1])["folders"]
    assert len(merge([("s7", "new", "t", t, t + timedelta(hours=1))], 1)) == 1
    after = jobs.read_pointer(spark, jobs.snapshot_paths(spark, root)[-1])["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert merge([("s8", "again", "t", t, t + timedelta(hours=1))], 1) == []  # a batch that is already merged
    want = sorted((f"s{i}", "new" if i == 7 else "old") for i in range(300))
    assert rows_of(spark, root) == want
    old = jobs.read_snapshot(spark, root, {"folders": before})
    assert old.filter("object = 'old'").count() == 300
    jobs.expire_snapshots(spark, root, keep=1)
    assert len(jobs.snapshot_paths(spark, root)) == 1 and rows_of(spark, root) == want


def test_a_failed_merge_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    root, t = str(tmp_path / "cat"), datetime(2024, 1, 1)
    one = spark.createDataFrame([("a", "old", "t", t, t)], SCHEMA)
    two = spark.createDataFrame([("a", "new", "t", t, t + timedelta(hours=1)), ("b", "new", "t", t, t)], SCHEMA)
    jobs.merge_into_snapshot(one, root, 0, "ingested_at", 4)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_write_pointer", fail)
        with pytest.raises(OSError):
            jobs.merge_into_snapshot(two, root, 1, "ingested_at", 4)
    assert rows_of(spark, root) == [("a", "old")]
    jobs.merge_into_snapshot(two, root, 1, "ingested_at", 4)
    assert rows_of(spark, root) == [("a", "new"), ("b", "new")]


def brute_sessions(rows, hours=24):
    out = []
    for key in {k for k, _ in rows}:
        last = None
        for at in sorted(t for k, t in rows if k == key and t is not None):
            if last is None or at - last > timedelta(hours=hours):
                out.append([key, 0, at, at])
            out[-1][1], out[-1][3], last = out[-1][1] + 1, at, at
    return sorted((tuple(x) for x in out), key=str)


def random_events(n=900):
    rng, t = random.Random(4), datetime(2024, 1, 1)
    rows = [("busy", t + timedelta(minutes=rng.randrange(40 * 24 * 60))) for _ in range(n // 3)]
    rows += [("busy", t + timedelta(days=50, hours=h)) for h in (0, 24, 48, 72.001)]
    rows += [(rng.choice(["a", "b", "c", None]), t + timedelta(hours=rng.randrange(24 * 200))) for _ in range(n)]
    return rows + [("a", None), ("d", None)]


@pytest.mark.parametrize("bound", [3, 50, 10**6])
def test_sessions_merge_over_chunks(spark, bound):
    rows = random_events()
    df = spark.createDataFrame(rows, "session_id string, ts timestamp").repartition(4)
    got = sorted((tuple(r) for r in session_spans(df, rows_per_chunk=bound).collect()), key=str)
    assert got == brute_sessions(rows) and len(got) > 40
    numbered = session_ttl(df.filter("ts IS NOT NULL").withColumn("query_id", F.monotonically_increasing_id()), rows_per_chunk=bound)
    assert numbered.select("session_id", "session_no").distinct().count() == len(got)


def test_a_busy_hour_is_many_chunks(spark):
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 > 0, "busy").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("session_id"),
        F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(3_600_000_000))).alias("ts"), F.col("id").alias("query_id"),
    )
    chunked = balanced_chunks(rows, ["session_id"], ["ts", "query_id"], 20_000)
    sizes = chunked.groupBy("session_id", "__chunk").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    assert max(r.n for r in sizes) <= 20_000 and sum(r.n for r in sizes) == 1_000_000
    busy = sorted((r["__chunk"], r.a, r.b) for r in sizes if r.session_id == "busy")
    assert len(busy) >= 34 and all(x[2] <= y[1] for x, y in zip(busy, busy[1:]))
    one = balanced_chunks(rows.withColumn("ts", F.lit(0).cast("timestamp")), ["session_id"], ["ts", "query_id"], 200_000)
    assert one.groupBy("session_id", "__chunk").count().agg(F.max("count")).first()[0] <= 200_000


def test_session_stream_over_many_batches(spark, tmp_path):
    """Rows in the order of time over several micro-batches, one session across all of them."""
    rows = sorted((r for r in random_events(300) if r[1]), key=lambda r: r[1])
    rows.append(("end", rows[-1][1] + timedelta(days=60)))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "chk"))
    size = len(rows) // 4 + 1
    for k in range(0, len(rows), size):
        df = spark.createDataFrame(rows[k : k + size], "session_id string, ts timestamp")
        df.repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        jobs.session_stream(stream, out, check).awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert got == [r for r in brute_sessions(rows) if r[0] != "end"]


def test_idle_of_exactly_a_day_stays_one_session(spark):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, t), (1, t + timedelta(hours=24)), (1, t + timedelta(hours=48, seconds=1))], "session_id int, ts timestamp")
    assert sorted(r.n for r in jobs.session_windows(events).collect()) == [1, 2]


def test_session_stream_equals_batch(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "chk"))
    t = datetime(2024, 1, 1)
    rows = [(u, t + timedelta(hours=h)) for u, h in [(1, 0), (1, 5), (1, 40), (2, 1), (2, 24), (2, 80)]]
    rows.append((9, t + timedelta(days=60)))  # closes everything before it
    events = spark.createDataFrame(rows, "session_id int, ts timestamp")
    events.coalesce(1).write.parquet(source)
    batch = {(r.session_id, r.n, r.first_ts) for r in jobs.session_windows(events).collect() if r.session_id != 9}
    stream = spark.readStream.schema(events.schema).parquet(source)
    jobs.session_stream(stream, out, check).awaitTermination()
    # a late row, beyond the watermark, is dropped
    spark.createDataFrame([(1, t)], "session_id int, ts timestamp").write.mode("append").parquet(source)
    jobs.session_stream(spark.readStream.schema(events.schema).parquet(source), out, check).awaitTermination()
    got = {(r.session_id, r.n, r.first_ts) for r in spark.read.parquet(out).collect()}
    assert got == batch and len(batch) == 4


def test_upsert_query_writes_its_feed_in_parallel(spark, tmp_path, monkeypatch):
    """The feed of ``catalog_upsert_stream`` is not drawn into one task."""
    from terrafold.plans.all_queries import load
    from terrafold.plans.registry import QUERIES

    load()
    rows = "id AS o_orderkey, id % 300 AS o_custkey, date_add(date'1995-01-01', CAST(id % 900 AS INT)) AS o_orderdate, id * 1.5D AS o_totalprice, 'F' AS o_orderstatus"
    spark.sql(f"SELECT {rows} FROM range(0, 2000, 1, 4)").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(type(spark.range(1)), "coalesce", None)
    assert QUERIES["catalog_upsert_stream"](spark, str(tmp_path)).count() == 2000 + sum(i % 9 == 0 for i in range(2000))
