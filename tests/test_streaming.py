"""Streams give what bounded tables give, over input in order, one file for each micro-batch, and go on after a restart."""

from datetime import timedelta

import pytest
from timebase import T0
from pyspark.sql import functions as F, types as T

from tidemark import operators as op
from tidemark.metrics import ProgressListener
from tidemark.sinks import MemorySink
from tidemark.streaming import Job, scan_stream, throttle_stream
from tidemark.streaming.processors import distinct_stream, join_stream, windows_stream

SCHEMA = "offset bigint, key string, event_time timestamp, ingest_time timestamp, v bigint"
ROWS = [(i, "ab"[i % 3 == 0], T0 + timedelta(seconds=7 * i), None, i * i % 5) for i in range(40)]


@pytest.fixture
def folder(spark, tmp_path):
    def put(part, rows, name="in"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    for k in range(0, len(ROWS), 10):
        put(k, ROWS[k : k + 10])
    return tmp_path


def stream(spark, folder, name="in"):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / name))


def through(df, folder, mode="update"):
    sink = MemorySink()
    job = Job([sink], delivery="effectively_once", checkpoint_dir=str(folder / "checkpoint"))
    sub = job.start(df, output_mode=mode)
    sub.drain()
    return sink.items


def test_throttle(spark, folder):
    batch = op.throttle("30s")
    from tidemark.flow import Flow

    expected = [r.offset for r in Flow(spark.createDataFrame(ROWS, SCHEMA)).pipe(batch).collect()]
    assert sorted(r.offset for r in through(throttle_stream(stream(spark, folder), "30s"), folder)) == expected


def test_scan_goes_on_after_a_restart(spark, folder):
    def run():
        return through(scan_stream(stream(spark, folder), lambda s, r: s + r["v"], 0, "total", T.LongType()), folder)

    first = run()
    spark.createDataFrame([(100, "a", T0 + timedelta(hours=1), None, 1000)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    second = run()
    assert max(r.total for r in first if r.key == "a") == sum(r[4] for r in ROWS if r[1] == "a")
    assert [(r.offset, r.total) for r in second] == [(100, 1000 + sum(r[4] for r in ROWS if r[1] == "a"))]


def test_distinct(spark, folder):
    from tidemark.flow import Flow

    expected = [r.offset for r in Flow(spark.createDataFrame(ROWS, SCHEMA)).pipe(op.distinct_until_changed("v")).collect()]
    assert sorted(r.offset for r in through(distinct_stream(stream(spark, folder), "v"), folder)) == expected


def test_windows_and_join(spark, folder):
    from tidemark.flow import Flow

    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        panes = windows_stream(stream(spark, folder), "1 minute", {"n": F.count("*")}, delay="0 seconds")
        got = {(r.key, r.start): r.n for r in through(panes, folder, "append")}
    finally:
        spark.streams.removeListener(listener)
    whole = {(r.key, r.start): r.n for r in Flow(spark.createDataFrame(ROWS, SCHEMA).withColumns({"partition": F.lit("0"), "headers": F.lit(None).cast("map<string,string>")})).pipe(op.tumbling_window("1m", {"n": F.count("*")})).df.collect()}
    assert got and got.items() <= whole.items() and len(whole) - len(got) <= 2
    left, right = (stream(spark, folder).where(f"v = {v}") for v in (1, 4))
    pairs = join_stream(left, right, "20s", delay="1 minute").select(F.col("l.offset").alias("a"), F.col("r.offset").alias("b"))
    sink = MemorySink()
    Job([sink], checkpoint_dir=str(folder / "joined")).start(pairs).drain()
    expected = {(x[0], y[0]) for x in ROWS for y in ROWS if x[4] == 1 and y[4] == 4 and x[1] == y[1] and abs((x[2] - y[2]).total_seconds()) <= 20}
    assert {(r.a, r.b) for r in sink.items} == expected


def test_at_most_once_marks_before_it_writes(spark, folder):
    class Broken(MemorySink):
        def write(self, df):
            raise OSError("down")

    job = Job([Broken()], delivery="at_most_once", checkpoint_dir=str(folder / "amo"))
    sub = job.start(stream(spark, folder).select("offset"))
    with pytest.raises(Exception):
        sub.queries[0].processAllAvailable()
    sink = MemorySink()
    Job([sink], delivery="at_most_once", checkpoint_dir=str(folder / "amo")).start(stream(spark, folder).select("offset")).drain()
    assert len(sink.items) == 30


def bounded(spark, *ops):
    from tidemark.flow import Flow

    return Flow(spark.createDataFrame(ROWS, SCHEMA)).pipe(*ops).df


def test_sample_debounce_timeout(spark, folder):
    from tidemark.streaming import debounce_stream, sample_stream, timeout_stream

    last = {max(r[0] for r in ROWS if r[1] == k) for k in "ab"}
    got = through(sample_stream(stream(spark, folder), "30s"), folder / "s")
    assert {r.offset for r in got} | last == {r.offset for r in bounded(spark, op.sample("30s")).collect()}
    got = through(debounce_stream(stream(spark, folder), "12s"), folder / "d")
    assert {r.offset: (r.key, r.v) for r in got} == {r.offset: (r.key, r.v) for r in bounded(spark, op.debounce("12s", in_order=True)).collect() if r.offset not in last}
    got = through(timeout_stream(stream(spark, folder), "14s"), folder / "t")
    expected = bounded(spark, op.timeout("14s")).collect()
    assert sorted((r.key, r.since, r.at) for r in got if r.timeout) == sorted((r.key, r.since, r.at) for r in expected if r.timeout) and len(got) == len(expected)


def test_late_and_lookup(spark, folder, tmp_path):
    from tidemark.streaming import late_stream, lookup_stream

    disordered = [(0, "a", T0 + timedelta(minutes=2), None, 0), (1, "a", T0 + timedelta(seconds=10), None, 1), (2, "a", T0 + timedelta(minutes=3), None, 2), (3, "b", T0, None, 3)]
    spark.createDataFrame(disordered, SCHEMA).coalesce(1).write.parquet(str(folder / "late"))
    got = through(late_stream(stream(spark, folder, "late"), "30s"), folder / "l")
    assert {r.offset: r.late for r in got} == {0: False, 1: True, 2: False, 3: False}
    changes = spark.createDataFrame([(-1, "a", 7), (-1, "b", None)], "offset bigint, key string, level bigint")
    changes.coalesce(1).write.parquet(str(folder / "changes"))
    log = spark.readStream.schema(changes.schema).parquet(str(folder / "changes"))
    got = through(lookup_stream(stream(spark, folder), log), folder / "j")
    assert {(r.key, r.right.level if r.right else None) for r in got} == {("a", 7), ("b", None)} and len(got) == 40
