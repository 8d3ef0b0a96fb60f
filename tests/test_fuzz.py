"""The DataFrame forms against plain folds over random streams, in order and disordered."""

import random


import pytest

from pyspark.sql import functions as F

from tidemark import operators as op

N_STREAMS, KEYS = 60, "abc"


def streams(seed, disorder):
    """Many short streams in one table: the stream's number is part of the key, and streams are far apart in time and arrival."""
    rnd = random.Random(seed)
    out = []
    for _ in range(N_STREAMS):
        t, rows = 0, []
        for _ in range(rnd.randint(1, 12)):
            t += rnd.choice([0, 1, 3, 10, 11, 25])
            rows.append((rnd.choice(KEYS), t))
        if disorder:
            rnd.shuffle(rows)
        out.append(rows)
    return out


def flow_of(records, rows, schema="v string"):
    return records([(k, t, str(i)) for i, (k, t) in enumerate(rows)], schema)


def throttle(rows, gap):
    last, out = {}, []
    for i, (k, t) in enumerate(rows):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.append(i)
    return out


def sample(rows, gap):
    tick, out, latest = {}, [], {}
    for i, (k, t) in enumerate(rows):
        latest[k] = i
        if k not in tick:
            tick[k] = t + gap
        elif t >= tick[k]:
            tick[k] = t + gap
            out.append(i)
    return sorted({*out, *latest.values()})


def debounce(rows, gap):
    held, out = {}, []
    for i, (k, t) in enumerate(rows):
        for other in [x for x, (_, s) in held.items() if t - s >= gap]:
            out.append(held.pop(other)[0])
        held[k] = (i, t)
    return sorted([*out, *(i for i, _ in held.values())])


def sessions(rows, gap, bound):
    wm, last, groups = None, {}, {}
    late = []
    for i, (k, t) in enumerate(rows):
        wm = t if wm is None else max(wm, t)
        if t < wm - bound:
            late.append(i)
            continue
        if k not in last or t - last[k] > gap:
            groups.setdefault(k, []).append([])
        last[k] = max(last.get(k, t), t)
        groups[k][-1].append(i)
    return sorted(tuple(g) for gs in groups.values() for g in gs), late


@pytest.mark.parametrize("disorder", [False, True])
def test_rate_and_session_folds(records, disorder):
    for rows in streams(7, disorder)[:6]:
        flow = flow_of(records, rows)
        flow = flow.with_df(flow.df.coalesce(1))
        ids = lambda f: sorted(int(r.v) for r in f.df.collect())
        assert ids(flow.pipe(op.throttle("10s"))) == throttle(rows, 10)
        assert ids(flow.pipe(op.sample("10s"))) == sample(rows, 10)
        assert ids(flow.pipe(op.debounce("10s"))) == debounce(rows, 10), rows
        if not disorder:
            assert ids(flow.pipe(op.debounce("10s", in_order=True))) == debounce(rows, 10)
        made = flow.pipe(op.assign_watermarks("5s"), op.session_window("10s"))
        expected, late = sessions(rows, 10, 5)
        assert sorted(tuple(int(i.v) for i in r["items"]) for r in made.df.collect()) == expected
        assert sorted(int(r.v) for r in made.side["late"].collect()) == late


def test_interval_join_against_pairs(records):
    rnd = random.Random(3)
    left = [(rnd.choice("ab"), t) for t in sorted(rnd.randint(0, 200) for _ in range(60))]
    right = [(rnd.choice("ab"), t) for t in sorted(rnd.randint(0, 200) for _ in range(60))]
    lf, rf = flow_of(records, left), flow_of(records, right)
    pairs = {(i, j) for i, (k, t) in enumerate(left) for j, (q, s) in enumerate(right) if k == q and abs(t - s) <= 7}
    lone = {(i, None) for i, (k, t) in enumerate(left) if not any(k == q and t - 7 <= s < t for q, s in right)}
    got = lf.pipe(op.join_stream(rf, "7s", how="left")).df.collect()
    found = [(int(r.v), int(r.right.v) if r.right else None) for r in got]
    assert len(found) == len(set(found)) and set(found) == pairs | lone


def test_running_maximum_over_slices(spark):
    from tidemark.plans.arrival import ranked, running_max

    rnd = random.Random(5)
    rows = [(o * rnd.choice([1, 1, 1]) + 1000, rnd.choice([None, rnd.randint(0, 99)])) for o in range(500)]
    df = spark.createDataFrame(rows, "offset bigint, v bigint").repartition(5)
    high, expected = None, []
    for _, v in rows:
        high = v if high is None else high if v is None else max(high, v)
        expected.append(high)
    assert [r.m for r in running_max(df, F.col("v"), "m").orderBy("offset").collect()] == expected
    assert [r.r for r in ranked(df, "r").orderBy("offset").collect()] == list(range(500))
    assert running_max(df.where("false"), F.col("v"), "m").count() == 0
