"""Small goldens for each operator."""

from datetime import timedelta

import pytest
from timebase import T0
from pyspark.sql import functions as F

from tidemark import operators as op
from tidemark.errors import StreamProcessingError
from tidemark.flow import Flow, compose, operator
from tidemark.functions.clock import VirtualClock
from tidemark.functions.durations import interval, micros, parse_duration
from tidemark.schema import ENGINE, from_iterable


def values(flow, column="v"):
    df = flow.df if isinstance(flow, Flow) else flow
    return [r[column] for r in df.orderBy("offset").collect()]


def seconds(ts):
    return int(ts.timestamp() - T0.timestamp())


def numbers(spark, *n):
    return Flow(from_iterable(spark, list(n), "v bigint"))


def test_durations():
    assert [parse_duration(x) for x in ("250ms", "1.5h", 2, "2d", timedelta(seconds=-1))] == [timedelta(milliseconds=250), timedelta(minutes=90), timedelta(seconds=2), timedelta(days=2), timedelta(seconds=-1)]
    assert parse_duration("3m") == timedelta(minutes=3) and micros("1s") == 1_000_000 and interval("1ms") == "1000 microseconds"
    for bad in ("1h30m", "-1s", "", "5 weeks", "1"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_clock():
    c = VirtualClock(T0)
    c.advance("5m")
    assert c.now() == T0 + timedelta(minutes=5)
    c.set(T0)
    assert c.now() == T0


def test_from_iterable_needs_a_length(spark):
    with pytest.raises(TypeError):
        from_iterable(spark, (x for x in [1]), "v bigint")
    df = from_iterable(spark, [1, 2], "v bigint")
    assert df.columns == [*ENGINE, "v"] and [r.offset for r in df.collect()] == [0, 1]


def test_composition_is_associative(spark):
    a, b, c = op.map_op({"v": "v + 1"}), op.map_op({"v": "v + 1"}), op.filter_op("v % 2 = 0")
    flows = [compose(compose(a, b), c), compose(a, compose(b, c)), compose(a, b, c)]
    assert [values(numbers(spark, 1, 2, 3, 4).pipe(f)) for f in flows] == [[4, 6]] * 3
    assert values(numbers(spark, 1).pipe()) == [1] and values(numbers(spark, 1).pipe(op.identity())) == [1]


def test_operator_factory(spark):
    @operator
    def doubled(df, column):
        return df.withColumn(column, F.col(column) * 2)

    assert values(numbers(spark, 1, 2).pipe(doubled("v"))) == [2, 4]


def test_map_callable_fails_the_job(spark):
    with pytest.raises(Exception, match="map_op: ZeroDivisionError"):
        numbers(spark, 1).pipe(op.map_op(lambda r: {"v": r["v"] / 0}, "v bigint")).collect()
    assert str(StreamProcessingError("map_op", ValueError("x"))) == "map_op: x"


def test_skip_diverts_the_poisoned_record(spark):
    def times_ten(r):
        if r["v"] == 2:
            raise ValueError("poison")
        return {"v": r["v"] * 10}

    flow = numbers(spark, 1, 2, 3).pipe(op.map_op(times_ten, "v bigint", on_error="skip"))
    assert values(flow) == [10, 30]
    dead = flow.side["dlq"].collect()
    assert [(r.v, r.headers["dlq_stage"], r.headers["dlq_error"]) for r in dead] == [(2, "map_op", "ValueError: poison")]


def test_retries_count_for_every_policy(spark, tmp_path):
    log = str(tmp_path / "attempts")

    def failing(r):
        with open(log, "a") as f:
            f.write("x")
        raise ValueError("always")

    flow = numbers(spark, 1, 2).pipe(op.map_op(failing, "v bigint", on_error="skip", retries=3))
    assert values(flow) == [] and flow.side["dlq"].count() == 2 and len(open(log).read()) == 8


def test_map_payload_and_flat_map(spark):
    assert values(numbers(spark, 2).pipe(op.flat_map("array(v, v * 10)", "v"))) == [2, 20]
    assert sorted(values(numbers(spark, 2, 3).pipe(op.flat_map(lambda r: [r["v"]] * (r["v"] - 1), "v", "bigint")))) == [2, 3, 3]
    assert values(numbers(spark, 2).pipe(op.map_payload({"w": "v * 3"})), "w") == [6]
    assert values(numbers(spark, 2).pipe(op.map_payload(lambda p: {"w": p["v"] + 1}, "w bigint")), "w") == [3]


def test_tap_and_filter_callables(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def note(r):
        with open(seen, "a") as f:
            f.write(f"{r['v']};")

    assert values(numbers(spark, 1, 2).pipe(op.tap(note), op.filter_op(lambda r: r["v"] > 1))) == [2]
    assert set(open(seen).read().split(";")) == {"", "1", "2"}  # a sort samples its input, so effects may repeat
    dropped = numbers(spark, 1, 2).pipe(op.tap(lambda r: 1 / (r["v"] - 1), on_error="skip"))
    assert values(dropped) == [2] and dropped.side["dlq"].count() == 1


def test_validate(records):
    flow = records([("a", 0, "ok"), ("a", 1, "bad"), ("a", 2, None)]).pipe(op.validate("v = 'ok'"))
    assert values(flow) == ["ok"] and {r.headers["dlq_stage"] for r in flow.side["dlq"].collect()} == {"validate"} and flow.side["dlq"].count() == 2
    flow = records([("a", 0, "1"), ("a", 1, "x")]).pipe(op.validate(lambda r: int(r["v"]) == 1))
    assert values(flow) == ["1"] and "ValueError" in flow.side["dlq"].first().headers["dlq_error"]
    with pytest.raises(Exception, match="validate: invalid"):
        records([("a", 0, "bad")]).pipe(op.validate("v = 'ok'", on_invalid="fail_job")).collect()


def test_trace_id_is_kept(records):
    first = records([("a", 0, "x")]).pipe(op.assign_trace_id())
    held = first.with_df(first.df.withColumn("headers", F.create_map(F.lit("trace_id"), F.lit("mine"))))
    assert len(first.df.first().headers["trace_id"]) == 32 and held.pipe(op.assign_trace_id()).df.first().headers["trace_id"] == "mine"


def test_take_and_skip(spark):
    five = numbers(spark, *range(5))
    assert values(five.pipe(op.skip(2), op.take(2))) == [2, 3]
    assert values(five.pipe(op.take(0))) == [] and values(five.pipe(op.skip(0))) == [0, 1, 2, 3, 4] and values(five.pipe(op.skip(9))) == []


def test_scan_by_key(records):
    flow = records([("a", 0, 1), ("b", 1, 10), ("a", 2, 1)], "n bigint").pipe(op.scan_op(F.sum("n"), name="total"))
    assert values(flow, "total") == [1, 10, 2]
    flow = records([("a", 0, 1), (None, 1, 10), ("a", 2, 1), (None, 3, 5)], "n bigint").pipe(op.scan_op(lambda s, r: s + r["n"], 0, "total", "bigint"))
    assert values(flow, "total") == [1, 10, 2, 15]
    assert records([], "n bigint").pipe(op.scan_op(F.sum("n"), name="total")).collect() == []


def test_distinct_until_changed(records):
    assert values(records([("a", 0, "x"), ("b", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, None), ("b", 5, None)]).pipe(op.distinct_until_changed("v"))) == ["x", "x", "y", None]


def test_buffer_count(spark):
    rows = numbers(spark, *range(5)).pipe(op.buffer_count(3)).collect()
    assert [[i.v for i in r["items"]] for r in rows] == [[0, 1, 2], [3, 4]] and [r.offset for r in rows] == [2, 4]
    with pytest.raises(ValueError):
        op.buffer_count(0)


def panes(flow):
    return sorted((r.key, seconds(r.start), seconds(r.end), [i.v for i in r["items"]]) for r in flow.df.collect())


def test_tumbling_by_key(records):
    flow = records([("s", 0, "a"), ("s", 10, "b"), ("s", 70, "c"), ("t", 5, "d")]).pipe(op.tumbling_window("1m"))
    assert panes(flow) == [("s", 0, 60, ["a", "b"]), ("s", 60, 120, ["c"]), ("t", 0, 60, ["d"])]
    row = flow.df.where("key = 's'").orderBy("start").first()
    assert row.event_time == row.end and row.offset == 1


def test_late_records_go_aside(records):
    flow = records([("s", 120, "late-ok"), ("s", 10, "late"), ("s", 130, "also-ok")]).pipe(op.assign_watermarks("0s"), op.tumbling_window("1m"))
    assert [i for p in panes(flow) for i in p[3]] == ["late-ok", "also-ok"] and [r.v for r in flow.side["late"].collect()] == ["late"]


def test_watermark_is_global_and_ignores_missing_times(records):
    flow = records([("a", 100, "x"), ("b", None, "y"), ("b", 50, "z")]).pipe(op.assign_watermarks("10s"))
    assert [seconds(r.watermark) for r in flow.collect()] == [90, 90, 90]


def test_missing_event_time_takes_the_clock(records):
    flow = records([("a", None, "x")]).pipe(op.tumbling_window("1m", clock=T0 + timedelta(seconds=61)))
    assert panes(flow) == [("a", 60, 120, ["x"])]


def test_sliding(records):
    rows = [("k", 0, "1"), ("k", 30, "2"), ("k", 60, "3")]
    assert panes(records(rows).pipe(op.sliding_window("2m", "30s"))) == [
        ("k", -90, 30, ["1"]), ("k", -60, 60, ["1", "2"]), ("k", -30, 90, ["1", "2", "3"]), ("k", 0, 120, ["1", "2", "3"]), ("k", 30, 150, ["2", "3"]), ("k", 60, 180, ["3"]),
    ]
    assert panes(records(rows).pipe(op.sliding_window("75s", "30s"))) == [("k", -30, 45, ["1"]), ("k", 0, 75, ["1", "2"]), ("k", 30, 105, ["2", "3"]), ("k", 60, 135, ["3"])]
    assert panes(records(rows).pipe(op.sliding_window("20s", "1m"))) == [("k", 0, 20, ["1"]), ("k", 60, 80, ["3"])]


def test_sessions(records):
    assert panes(records([("u", 0, "a"), ("u", 10, "b"), ("u", 100, "c")]).pipe(op.session_window("30s"))) == [("u", 0, 40, ["a", "b"]), ("u", 100, 130, ["c"])]
    assert len(panes(records([("u", 0, "a"), ("u", 30, "b")]).pipe(op.session_window("30s")))) == 1


def test_rates(records):
    assert values(records([("a", 0, "1"), ("a", 10, "2"), ("a", 70, "3"), ("b", 5, "9")]).pipe(op.throttle("1m"))) == ["1", "3", "9"]
    assert values(records([("k", 0, "a"), ("k", 10, "b"), ("k", 100, "c")]).pipe(op.debounce("30s"))) == ["b", "c"]
    assert values(records([("k", 0, "a"), ("k", 10, "b"), ("k", 100, "c")]).pipe(op.debounce("30s", in_order=True))) == ["b", "c"]
    assert values(records([("k", 0, "1"), ("k", 10, "2"), ("k", 70, "3")]).pipe(op.sample("1m"))) == ["3"]


def test_timeout(records):
    rows = records([("k", 0, "a"), ("k", 100, "c")]).pipe(op.timeout("30s")).df.orderBy("position").collect()
    assert [(r.v, r.timeout) for r in rows] == [("a", False), (None, True), ("c", False)]
    assert (seconds(rows[1].since), seconds(rows[1].at), rows[1].offset) == (0, 100, None)


@pytest.fixture
def risk(spark):
    return spark.createDataFrame([("u1", 0.9), (None, 0.1)], "key string, risk double")


def test_join_table(records, risk):
    flow = records([("u1", 0, 10), ("u2", 1, 1), (None, 2, 5)], "amount bigint").pipe(op.join_table(risk))
    assert [(r.amount, r.right.risk) for r in flow.collect()] == [(10, 0.9), (5, 0.1)] and [r.key for r in flow.side["unmatched"].collect()] == ["u2"]
    left = records([("u2", 0, 1)], "amount bigint").pipe(op.join_table(risk, how="left"))
    assert left.collect()[0].right is None and "unmatched" not in left.side


def test_table_of_changes(spark, records):
    changes = spark.createDataFrame([(0, "a", 1), (2, "a", 2), (4, "a", None)], "offset bigint, key string, level bigint")
    flow = records([("a", i, str(i)) for i in range(6)]).pipe(op.join_table_state(changes))
    assert [(r.v, r.right.level) for r in flow.collect()] == [("0", 1), ("1", 1), ("2", 2), ("3", 2)] and values(flow.side["unmatched"]) == ["4", "5"]
    assert op.as_table(changes).count() == 0 and op.as_table(changes.where("offset < 4")).first().level == 2


def test_join_stream(records):
    left, right = records([("u", 0, "tx"), ("u", 100, "tx2")]), records([("u", 5, "login")])
    assert [(r.v, r.right.v) for r in left.pipe(op.join_stream(right, "10s")).collect()] == [("tx", "login")]
    eager = left.pipe(op.join_stream(right, "10s", how="left")).df.collect()
    assert sorted((r.v, r.right.v if r.right else None) for r in eager if r.v == "tx2") == [("tx2", None)] and len(eager) == 3
    assert records([(None, 0, "l")]).pipe(op.join_stream(records([(None, 10, "r")]), "10s")).df.count() == 1


def test_merge(records):
    flow = op.merge(records([("x", 10, "a"), ("x", 30, "c")]), records([("y", 20, "b"), ("y", 30, "d")]))
    assert values(flow) == ["a", "b", "c", "d"] and [r.offset for r in flow.collect()] == [0, 1, 2, 3]


def test_fan_out_and_share(spark):
    from tidemark.sinks import MemorySink

    extra, main = MemorySink(), MemorySink()
    from tidemark.streaming import Job

    flow = numbers(spark, 1, 2).pipe(op.fan_out(extra))
    assert extra.items == []
    shared = flow.df
    assert shared.storageLevel.useMemory
    Job([main]).run(flow)
    assert [r.v for r in extra.items] == [r.v for r in main.items] == [1, 2]


def test_failures_name_their_stage(spark):
    def poisoned(record):
        raise ValueError(f"v is {record['v']}")

    seen = []
    for broken in (op.map_op(poisoned, "n bigint"), op.flat_map(poisoned, "n", "bigint"), op.filter_op(poisoned), op.validate(poisoned, on_invalid="fail_job"), op.scan_op(lambda s, r: poisoned(r), 0, "n", "bigint")):
        with pytest.raises(StreamProcessingError) as e:
            numbers(spark, 1).pipe(broken).collect()
        seen.append((e.value.stage, e.value.original))
    assert seen == [(stage, "ValueError: v is 1") for stage in ("map_op", "flat_map", "filter_op", "validate", "scan_op")]
    got = []
    numbers(spark, 1, 2).subscribe(lambda r: got.append(r.v), on_complete=lambda: got.append("end"))
    numbers(spark, 1).pipe(op.map_op(poisoned, "n bigint")).subscribe(got.append, on_error=lambda e: got.append(e.stage))
    assert got == [1, 2, "end", "map_op"]


def test_scan_with_a_seed_and_failing_items(records):
    flow = records([("a", 0, 1), ("a", 1, -1), ("a", 2, 5), ("b", 3, 7)], "v bigint")
    assert values(flow.pipe(op.scan_op(F.sum("v"), 100, "total", combine=lambda seed, x: seed + x)), "total") == [101, 100, 105, 107]
    with pytest.raises(ValueError):
        op.scan_op(F.sum("v"), 100)

    def step(state, record):
        if record["v"] < 0:
            raise ValueError("negative")
        return state + record["v"]

    out = flow.pipe(op.scan_op(step, 100, "total", "bigint", on_error="skip"))
    assert values(out, "total") == [101, 106, 107] and [(r.v, r.headers["dlq_stage"], r.headers["dlq_error"]) for r in out.side["dlq"].collect()] == [(-1, "scan_op", "ValueError: negative")]
    out.release()
    kept = op.last_states(out.df, "total")
    assert values(records([("b", 0, 1), ("c", 1, 1)], "v bigint").pipe(op.scan_op(step, 100, "total", "bigint", states=kept)), "total") == [108, 101]


def test_a_table_with_two_rows_of_a_key_matches_once(spark, records):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "key string, w bigint")
    out = records([("a", 0, 1), ("b", 1, 2), (None, 2, 3), ("c", 3, 4)], "v bigint").pipe(op.join_table(table))
    assert sorted(r.v for r in out.df.collect()) == [1, 2, 3] and [r.v for r in out.side["unmatched"].collect()] == [4]


def test_a_pair_has_the_envelope_of_the_later_record(records):
    left, right = records([("a", 0, "l0"), ("a", 10, "l1")], "v string"), records([("a", 5, "r0"), ("a", 10, "r1")], "v string")
    rows = left.pipe(op.join_stream(right, "5s", how="left")).df.orderBy("position").collect()
    assert [(r.v, r["right"] and r["right"].v, seconds(r.event_time), r.offset) for r in rows] == [("l0", None, 0, 0), ("l0", "r0", 5, 0), ("l1", "r0", 10, 1), ("l1", "r1", 10, 1)]


def test_records_become_a_table_of_their_own_flow(records):
    flow = records([("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], "v bigint").pipe(op.upsert_table(F.col("key"), state_id="t"), op.join_table_state("t"))
    assert [(r.v, r["right"].v) for r in flow.collect()] == [(1, 1), (2, 2), (3, 3)]
    assert {r.key: r.v for r in op.as_table(flow.side["table:t"].select("offset", "key", "v")).collect()} == {"a": 3, "b": 2}


def test_slices_follow_the_rows_not_the_span(spark):
    from tidemark.plans.arrival import sliced

    df = spark.range(2500).selectExpr("if(id = 0, 1000000000000000, id) as x", "if(id % 100 = 0, null, id) as y")
    sizes = [r["count"] for r in sliced(df, F.col("x")).groupBy("__slice").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 120
    assert [r["__slice"] for r in sliced(df, F.col("y")).where("y is null").select("__slice").distinct().collect()] == [-1]


def test_debounce_compares_no_stream_with_itself(records):
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), max(0, i - rnd.choice([0, 0, 0, 30])), i) for i in range(400)]
    flow = records(rows, "v bigint").pipe(op.debounce("10s"))
    plan = flow.df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    expected = []
    for i, (k, t, v) in enumerate(rows):
        nxt = next((j for j in range(i + 1, len(rows)) if rows[j][0] == k), None)
        if nxt is None or any(rows[j][1] - t >= 10 for j in range(i + 1, nxt + 1)):
            expected.append(v)
    assert sorted(r.v for r in flow.df.collect()) == expected
