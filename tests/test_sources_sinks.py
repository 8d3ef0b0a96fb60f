import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from timebase import T0

from tidemark import operators as op, sources
from tidemark.failures import StreamProcessingError
from tidemark.flow import Flow
from tidemark.functions.clock import VirtualClock
from tidemark.metrics import Metrics
from tidemark.operators import filter_op, validate
from tidemark.schema import from_iterable
from tidemark.sinks import CallbackSink, CircuitBreaker, FileSink, MemorySink, ProtectedSink, RowSink, Sink, StdoutSink, TableSink
from tidemark.state import KeyValueStore, load_checkpoint, save_checkpoint
from tidemark.streaming import Job


def test_lines_keep_their_index(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"n": 1}\n\nnot json\n{"n": 2}\n')
    rows = sources.read_lines(spark, str(f), schema="n bigint").orderBy("offset").collect()
    assert [(r.offset, r.value, r.payload.n if r.payload else None) for r in rows] == [(0, '{"n": 1}', 1), (2, "not json", None), (3, '{"n": 2}', 2)]
    assert rows[0].event_time is None and rows[0].key is None and rows[0].partition.endswith("a.jsonl")
    assert [r.offset for r in sources.read_lines(spark, str(f), seek=3).collect()] == [3]


def test_lines_of_many_blocks(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("".join(f"line {i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sources.read_lines(spark, str(f))
        assert df.where("value != concat('line ', offset)").count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_partitioned_log(spark, tmp_path):
    log = sources.PartitionedLog(str(tmp_path / "log"), 2)
    assert [log.append({"v": x}, key=x, event_time=T0) for x in "abc"] == [0, 1, 2]
    log.append({"v": "z"}, partition=1)
    with pytest.raises(IndexError):
        log.append({}, partition=2)
    c = log.consumer()
    rows = c.read(spark, "v string").orderBy("arrival").collect()
    assert [(r.partition, r.offset, r.v, r.key) for r in rows] == [("0", 0, "a", "a"), ("0", 1, "b", "b"), ("0", 2, "c", "c"), ("1", 0, "z", None)]
    assert rows[0].event_time.timestamp() == T0.timestamp()
    assert [r.v for r in log.consumer({0: 1, 1: 1}).read(spark, "v string").orderBy("offset").collect()] == ["b", "c"]
    c.commit(0, 1)
    assert c.committed(0) == 1 and log.consumer().position == {0: 2, 1: 0}
    assert sources.PartitionedLog(str(tmp_path / "log"), 2).append({"v": "d"}) == 3


def test_queue_policies(spark):
    q = sources.QueueSource(2, "drop_oldest")
    assert all(q.push(x) for x in "abc")
    rows = q.drain(spark).orderBy("offset").collect()
    assert [(r.offset, json.loads(r.value), r.partition) for r in rows] == [(1, "b", "q"), (2, "c", "q")]
    q = sources.QueueSource(1, "sample")
    assert [q.push(x) for x in "ab"] == [True, False]
    q = sources.QueueSource(1)
    q.push(1)
    with pytest.raises(sources.FullQueue):
        q.push(2, timeout=0.01)
    waiting = threading.Thread(target=q.push, args=(3,))
    waiting.start()
    assert q.drain(spark).count() == 1
    waiting.join()
    q.close()
    assert not q.push(4) and q.drain(spark, schema="n bigint").count() == 1
    with pytest.raises(ValueError):
        sources.QueueSource(policy="other")


def test_webhook(spark):
    w = sources.WebhookSource().start()

    def post(body, url=None):
        try:
            return urllib.request.urlopen(urllib.request.Request(url or w.url, data=body, method="POST")).status
        except urllib.error.HTTPError as e:
            return e.code

    assert [post(b'{"n": 1}'), post(b'[{"n": 2}, {"n": 3}]'), post(b""), post(b"{"), post(b"1", w.url + "x")] == [202, 202, 202, 400, 404]
    rows = w.drain(spark, schema="n bigint", wait=1).orderBy("offset").collect()
    assert [r.payload.n if r.payload else None for r in rows] == [1, 2, 3, None]
    w.close()


def test_tail_stream(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text('{"n": 1}\n')
    q = sources.tail(spark, str(f)).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    with f.open("a") as o:
        o.write('\n{"n": 2}\n{"half')
    q.processAllAvailable()
    q.stop()
    assert sorted((r.offset, r.value) for r in spark.table("tailed").collect()) == [(0, '{"n": 1}'), (2, '{"n": 2}')]


class Failing(RowSink):
    def write_row(self, row):
        raise OSError("down")


def test_protected_sink_and_breaker(spark):
    clock, dead = VirtualClock(T0), []
    breaker = CircuitBreaker(1, "30s", clock)
    ProtectedSink(Failing(), retries=0, breaker=breaker, dead=lambda *x: dead.append(x)).write(from_iterable(spark, ["x", "y"], "v string"))
    assert breaker.state == "open" and [(r.v, s, e) for r, s, e in dead] == [("x", "sink", "OSError: down"), ("y", "sink", "circuit_open")]
    clock.advance("30s")
    assert breaker.state == "half_open"
    breaker.failure()
    assert breaker.state == "open"
    clock.advance("31s")
    assert breaker.allows()
    breaker.success()
    assert breaker.state == "closed"


def test_sinks(spark, tmp_path, capsys):
    df, got = from_iterable(spark, [1, 2], "v bigint"), []
    for s in (CallbackSink(lambda r: got.append(r.v)), StdoutSink(), FileSink(str(tmp_path / "j")), TableSink(str(tmp_path / "p"))):
        assert isinstance(s, Sink)
        s.write(df)
        s.flush()
        s.close()
    assert got == [1, 2] and "'v': 2" in capsys.readouterr().out and spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_job_writes_main_and_side(spark):
    main, dead, done = MemorySink(), MemorySink(), []
    flow = Flow(from_iterable(spark, ["ok", "bad"], "v string")).pipe(validate("v = 'ok'"))
    Job([main], dlq=dead, on_complete=lambda: done.append(1)).run(flow)
    assert [r.v for r in main.items] == ["ok"] and [r.v for r in dead.items] == ["bad"] and done == [1]
    errors = []
    Job([Failing()], protect_sinks=False, on_error=errors.append).run(flow)
    Job([Failing()], on_error=errors.append).run(flow)
    assert isinstance(errors[0], OSError) and isinstance(errors[1], StreamProcessingError) and errors[1].stage == "sink"
    for bad in ({"delivery": "maybe"}, {"delivery": "effectively_once"}):
        with pytest.raises(ValueError):
            Job([main], **bad)


def test_protected_tables_are_written_or_buried(spark, tmp_path):
    df = from_iterable(spark, ["x", "y"], "v string")
    ProtectedSink(TableSink(str(tmp_path / "p"))).write(df)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2

    class Broken(TableSink):
        def write(self, df):
            raise OSError("full")

    dead, breaker = MemorySink(), CircuitBreaker(5)
    ProtectedSink(Broken("x"), breaker=breaker, dead=dead).write(df)
    assert [(r.v, r.headers["dlq_stage"], r.headers["dlq_error"]) for r in dead.items] == [("x", "sink", "OSError: full"), ("y", "sink", "OSError: full")]
    assert dead.payloads == [{"v": "x"}, {"v": "y"}]
    # three attempts each, and yet one failure for each record
    rows = ProtectedSink(Failing(), breaker=breaker, dead=dead)
    rows.write(df)
    assert breaker.state == "closed" and len(dead.items) == 4
    alone = ProtectedSink(Failing())
    alone.write(df)
    with pytest.raises(StreamProcessingError, match="2 records"):
        alone.flush()


def test_a_source_goes_on_from_its_checkpoint(spark, tmp_path):
    log, out = sources.PartitionedLog(str(tmp_path / "log")), MemorySink()

    def run():
        job = Job([out], delivery="effectively_once", checkpoint_dir=str(tmp_path / "c"), keep=("total",))
        scan = op.scan_op(lambda s, r: s + r["n"], 0, "total", "bigint", states=job.states(spark, "total"))
        consumer = log.consumer()
        job.run_source(spark, consumer, op.key_by(F.lit("k")), scan, schema="n bigint")
        return consumer

    for n in (1, 2):
        log.append({"n": n})
    assert run().committed(0) == 1 and [r.total for r in out.items] == [1, 3]
    run()  # nothing new
    for n in (3, 4):
        log.append({"n": n})
    assert run().committed(0) == 3 and [r.total for r in out.items] == [1, 3, 6, 10]
    assert isinstance(log.consumer(), sources.Source) and isinstance(sources.FileSource("x"), sources.Source)
    assert sources.from_source(spark, log.consumer({0: 2}), "n bigint").df.count() == 2


def test_store_and_checkpoint(spark, tmp_path):
    s = KeyValueStore()
    s.put("a", 1, "x")
    assert s.get("a", 1) == "x" and s.get("b", 1, 0) == 0 and list(s.items("a")) == [(1, "x")] and s.namespace("a") == {1: "x"}
    for n in (3, 4):
        save_checkpoint(spark, str(tmp_path), s, {"0": n})
    t, offsets, tables = load_checkpoint(spark, str(tmp_path))
    assert t.dump() == {"a": {1: "x"}} and offsets == {"0": 4} and tables == {}
    assert s.pop("a", 1) == "x" and s.dump() == {"a": {}}
    s.clear()
    assert load_checkpoint(spark, str(tmp_path / "none"))[1] == {}


def test_metrics(spark):
    from datetime import timedelta

    m = Metrics()
    flow = Flow(from_iterable(spark, [1, 2, 3], "v bigint")).pipe(m.stage("odd", filter_op("v % 2 = 1")), m.stage("small", validate("v < 3")))
    flow.df.collect()
    flow.side["dlq"].collect()
    snap = m.snapshot(read={"small": ("dlq",)})
    assert (snap["odd"].records_in, snap["odd"].records_out, snap["small"].records_out, snap["small"].dlq) == (3, 2, 1, 1) and "odd" in m.summary()
    m.told(T0, T0 + timedelta(minutes=5))
    assert m.lag_seconds == 300.0

    def poisoned(record):
        raise KeyError(record["v"])

    bad = Flow(from_iterable(spark, [1], "v bigint")).pipe(op.map_op(poisoned, "n bigint"))
    errors = []
    Job([MemorySink()], metrics=m, protect_sinks=False, on_error=errors.append).run(bad)
    assert (errors[0].stage, errors[0].original) == ("map_op", "KeyError: 1") and m.snapshot(read={"small": ("dlq",)})["map_op"].errors == 1
