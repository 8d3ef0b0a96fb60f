"""The registered queries over the events table and its companions, with DuckDB SQL for each.

``disordered`` rows arrive late by rule: every seventh event 25 places after its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators as op, sources
from ..flow import Flow
from ..schema import load_events
from ..sinks import ProtectedSink, RowSink, TableSink
from ..streaming import Job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = """SELECT event_id, user_id, event_type, value, props, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events"""
DISORDERED = f"""SELECT *, 2 * (event_id + CASE WHEN event_id % 7 = 0 THEN 25 ELSE 0 END) + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS o FROM ({EVENTS})"""
MARKED = f"""SELECT *, max(ts) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) - INTERVAL 30 MINUTE AS wm FROM ({DISORDERED})"""


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def events(spark: SparkSession, sf_dir: str) -> Flow:
    return Flow(load_events(spark, sf_dir))


def disordered(spark: SparkSession, sf_dir: str) -> Flow:
    late = F.col("event_id") % 7 == 0
    e = load_events(spark, sf_dir)
    return Flow(e.withColumn("offset", 2 * (F.col("event_id") + F.when(late, 25).otherwise(0)) + F.when(late, 0).otherwise(1)))


def naive(c: str):
    """A timestamp without zone, as DuckDB has it."""
    return F.col(c).cast("timestamp_ntz").alias(c)


@query(f"SELECT event_id, cents * 2 AS double_cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ({EVENTS})")
def map_payload(spark, sf_dir):
    flow = events(spark, sf_dir).pipe(op.map_payload({"event_id": "event_id", "double_cents": "cents * 2", "k": "cast(get_json_object(props, '$.k') as bigint)"}))
    return flow.df.select("event_id", "double_cents", "k")


@query(f"SELECT event_id, upper(event_type) AS event_type, cents + 1 AS cents FROM ({EVENTS})")
def map_op(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.map_op({"event_type": "upper(event_type)", "cents": "cents + 1"})).df.select("event_id", "event_type", "cents")


@query(f"SELECT event_id, cents % 1000 AS n FROM ({EVENTS}) WHERE cents % 3 <> 0")
def map_op_callable_skip(spark, sf_dir):
    def fn(r):
        if r["cents"] % 3 == 0:
            raise ValueError("a third")
        return {"n": r["cents"] % 1000}

    return events(spark, sf_dir).pipe(op.map_op(fn, "n bigint", on_error="skip")).df.select("event_id", "n")


@query(f"SELECT event_id, 'map_op' AS stage, 'ValueError: a third' AS error FROM ({EVENTS}) WHERE cents % 3 = 0")
def map_op_callable_dlq(spark, sf_dir):
    def fn(r):
        if r["cents"] % 3 == 0:
            raise ValueError("a third")
        return {"n": 0}

    dlq = events(spark, sf_dir).pipe(op.map_op(fn, "n bigint", on_error="retry", retries=1)).side["dlq"]
    return dlq.select("event_id", F.col("headers")["dlq_stage"].alias("stage"), F.col("headers")["dlq_error"].alias("error"))


@query(f"SELECT event_id, event_type, cents FROM ({EVENTS}) WHERE event_type = 'error' AND cents > 1000")
def filter_op(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.filter_op("event_type = 'error' AND cents > 1000")).df.select("event_id", "event_type", "cents")


@query(f"SELECT event_id, unnest([cents, cents * 10]) AS v FROM ({EVENTS})")
def flat_map(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.flat_map("array(cents, cents * 10)", "v")).df.select("event_id", "v")


@query(f"SELECT event_id, cents FROM ({EVENTS}) WHERE coalesce(cents < 20000 AND event_type <> 'error', false)")
def validate_ok(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.validate("cents < 20000 AND event_type <> 'error'")).df.select("event_id", "cents")


@query(f"SELECT event_id, 'validate' AS stage FROM ({EVENTS}) WHERE NOT coalesce(cents < 20000 AND event_type <> 'error', false)")
def validate_dlq(spark, sf_dir):
    flow = events(spark, sf_dir).pipe(op.validate("cents < 20000 AND event_type <> 'error'"))
    return flow.side["dlq"].select("event_id", F.col("headers")["dlq_stage"].alias("stage"))


@query(f"SELECT event_id, true AS has_id FROM ({EVENTS})")
def assign_trace_id(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.assign_trace_id()).df.select("event_id", F.col("headers")["trace_id"].rlike("^[0-9a-f]{32}$").alias("has_id"))


@query(f"SELECT event_id, cents FROM ({EVENTS})")
def tap_identity(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.identity(), op.tap(observe={"n": F.count("*")}, name="tapped")).df.select("event_id", "cents")


@query(f"SELECT event_id, event_type AS key, sum(cents) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS total FROM ({EVENTS})")
def key_by_scan_sum(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.key_by("event_type"), op.scan_op(F.sum("cents"), name="total")).df.select("event_id", "key", "total")


@query(f"SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS most FROM ({EVENTS})")
def scan_max(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.scan_op(F.max("cents"), name="most")).df.select("event_id", "most")


@query(f"SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM ({EVENTS})")
def scan_callable(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.scan_op(lambda s, r: s + r["cents"], 0, "total", "bigint")).df.select("event_id", "total")


@query(f"""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
           WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def distinct_until_changed(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.distinct_until_changed("event_type")).df.select("event_id", "event_type")


@query(f"""SELECT batch, count(*) AS n, max(event_id) AS "offset", string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids
           FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events) GROUP BY batch""")
def buffer_count(spark, sf_dir):
    df = events(spark, sf_dir).pipe(op.buffer_count(64)).df
    return df.select("batch", F.size("items").cast("long").alias("n"), "offset", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def take(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.take(100)).df.select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def skip(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.skip(100)).df.select("event_id")


@query(f"SELECT event_id, wm AS watermark FROM ({MARKED})")
def watermark(spark, sf_dir):
    return disordered(spark, sf_dir).pipe(op.assign_watermarks("30m")).df.select("event_id", naive("watermark"))


@query(f"SELECT event_id FROM ({MARKED}) WHERE ts < wm")
def late_events(spark, sf_dir):
    return disordered(spark, sf_dir).pipe(op.assign_watermarks("30m"), op.tumbling_window("1h", {"n": F.count("*")})).side["late"].select("event_id")


@query(f"""SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS "end",
           count(*) AS n, sum(cents)::BIGINT AS cents, max(o)::BIGINT AS "offset" FROM ({MARKED}) WHERE ts >= wm GROUP BY ALL""")
def tumbling_window(spark, sf_dir):
    df = disordered(spark, sf_dir).pipe(op.assign_watermarks("30m"), op.tumbling_window("1h", {"n": F.count("*"), "cents": F.sum("cents")}, allowed_lateness="5m")).df
    return df.select("key", naive("start"), naive("end"), "n", "cents", "offset")


@query(f"""SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM ({EVENTS}) GROUP BY ALL""")
def tumbling_items(spark, sf_dir):
    df = events(spark, sf_dir).pipe(op.tumbling_window("1h")).df
    return df.select("key", naive("start"), F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


def _sliding_sql(size: int, slide: int) -> str:
    return f"""SELECT user_id AS key, s AS start, s + INTERVAL {size} MINUTE AS "end", count(*) AS n, sum(cents)::BIGINT AS cents FROM (
               SELECT *, time_bucket(INTERVAL {slide} MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL {slide} MINUTE AS s FROM ({MARKED}), (SELECT unnest(range(0, {max(size // slide, 1)})) AS i) WHERE ts >= wm)
               WHERE ts < s + INTERVAL {size} MINUTE GROUP BY ALL"""


def _sliding(spark, sf_dir, size, slide):
    df = disordered(spark, sf_dir).pipe(op.assign_watermarks("30m"), op.sliding_window(size, slide, {"n": F.count("*"), "cents": F.sum("cents")})).df
    return df.select("key", naive("start"), naive("end"), "n", "cents")


@query(_sliding_sql(120, 30))
def sliding_window(spark, sf_dir):
    return _sliding(spark, sf_dir, "2h", "30m")


@query(_sliding_sql(75, 30))
def sliding_nondivisible(spark, sf_dir):
    return _sliding(spark, sf_dir, "75m", "30m")


@query(_sliding_sql(20, 60))
def sliding_gaps(spark, sf_dir):
    return _sliding(spark, sf_dir, "20m", "1h")


@query(f"""SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, sum(cents)::BIGINT AS cents FROM (
           SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS s FROM (
           SELECT *, CASE WHEN ts - max(ts) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh
           FROM ({MARKED}) WHERE ts >= wm)) GROUP BY user_id, s""")
def session_window(spark, sf_dir):
    df = disordered(spark, sf_dir).pipe(op.assign_watermarks("30m"), op.session_window("1h", {"n": F.count("*"), "cents": F.sum("cents")})).df
    return df.select("key", naive("start"), naive("end"), "n", "cents")


CHAIN = """WITH RECURSIVE r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
           c AS (SELECT *, ts AS last, true AS pass FROM r WHERE n = 1
                 UNION ALL SELECT r.*, CASE WHEN r.ts - c.last >= INTERVAL 1 HOUR THEN r.ts ELSE c.last END, r.ts - c.last >= INTERVAL 1 HOUR
                 FROM c JOIN r ON r.user_id = c.user_id AND r.n = c.n + 1)"""


@query(CHAIN + " SELECT event_id FROM c WHERE pass")
def throttle(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.throttle("1h")).df.select("event_id")


@query(CHAIN + " SELECT event_id FROM c WHERE (pass AND n > 1) OR n = m")
def sample(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.sample("1h")).df.select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR""")
def debounce(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.debounce("1h", in_order=True)).df.select("event_id")


@query(f"""WITH d AS (SELECT *, lead(o) OVER (PARTITION BY user_id ORDER BY o) AS nxt FROM ({DISORDERED}))
           SELECT event_id FROM d WHERE nxt IS NULL OR EXISTS (SELECT 1 FROM d x WHERE x.o > d.o AND x.o <= d.nxt AND x.ts - d.ts >= INTERVAL 1 HOUR)""")
def debounce_disordered(spark, sf_dir):
    return disordered(spark, sf_dir).pipe(op.debounce("1h")).df.select("event_id")


@query("""WITH b AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
          SELECT event_id, user_id AS key, false AS timeout, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS at FROM b
          UNION ALL SELECT NULL, user_id, true, before, ts FROM b WHERE ts - before >= INTERVAL 1 HOUR""")
def timeout(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.timeout("1h")).df.select("event_id", "key", "timeout", naive("since"), naive("at"))


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")


C = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"SELECT event_id, c_name, c_nationkey FROM events JOIN {C} ON user_id = c_custkey")
def join_table_inner(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.join_table(_customers(spark, sf_dir))).df.select("event_id", "right.c_name", "right.c_nationkey")


@query(f"SELECT event_id, c_name FROM events LEFT JOIN {C} ON user_id = c_custkey")
def join_table_left(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.join_table(_customers(spark, sf_dir), how="left")).df.select("event_id", "right.c_name")


@query(f"SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM {C})")
def join_table_unmatched(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.join_table(_customers(spark, sf_dir))).side["unmatched"].select("event_id")


@query("SELECT user_id AS key, max(event_id) AS \"offset\", arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def as_table(spark, sf_dir):
    return op.as_table(events(spark, sf_dir).df.select("offset", "key", "event_type")).select("key", "offset", "event_type")


def _clicks_with_logins(spark, sf_dir, how):
    e = events(spark, sf_dir)
    log = e.df.where("event_type = 'signup'").select("offset", "key", F.when(F.col("event_id") % 5 != 0, F.col("cents")).alias("at_signup"))
    return e.pipe(op.filter_op("event_type = 'click'"), op.join_table_state(log, how=how))


STATE = f"""SELECT c.event_id, s.at_signup FROM (SELECT * FROM ({EVENTS}) WHERE event_type = 'click') c
            ASOF LEFT JOIN (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN cents END AS at_signup FROM ({EVENTS}) WHERE event_type = 'signup') s ON c.user_id = s.user_id AND c.event_id >= s.event_id"""


@query(f"SELECT * FROM ({STATE}) WHERE at_signup IS NOT NULL")
def join_table_state(spark, sf_dir):
    return _clicks_with_logins(spark, sf_dir, "inner").df.select("event_id", "right.at_signup")


@query(f"SELECT event_id FROM ({STATE}) WHERE at_signup IS NULL")
def join_table_state_unmatched(spark, sf_dir):
    return _clicks_with_logins(spark, sf_dir, "inner").side["unmatched"].select("event_id")


def _purchases_with_errors(spark, sf_dir, how):
    e = events(spark, sf_dir)
    errors = e.pipe(op.filter_op("event_type = 'error'"))
    return e.pipe(op.filter_op("event_type = 'purchase'"), op.join_stream(errors, "6h", how=how)).df.select("event_id", F.col("right.event_id").alias("error_id"))


PAIRS = "SELECT p.event_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR"


@query(PAIRS)
def join_stream_inner(spark, sf_dir):
    return _purchases_with_errors(spark, sf_dir, "inner")


@query(f"""{PAIRS} UNION ALL SELECT event_id, NULL FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (
           SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts >= p.ts - INTERVAL 6 HOUR AND e.ts < p.ts)""")
def join_stream_left_eager(spark, sf_dir):
    return _purchases_with_errors(spark, sf_dir, "left")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, source, event_id) - 1 AS "offset" FROM (
          SELECT *, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 1 END AS source FROM events WHERE event_type IN ('click', 'error'))""")
def merge(spark, sf_dir):
    e = events(spark, sf_dir)
    return op.merge(e.pipe(op.filter_op("event_type = 'click'")), e.pipe(op.filter_op("event_type = 'error'"))).df.select("event_id", "offset")


@query("""WITH RECURSIVE p AS (SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS n FROM p),
          c AS (SELECT *, start AS last, true AS pass FROM r WHERE n = 1
                UNION ALL SELECT r.*, CASE WHEN r.start - c.last >= INTERVAL 2 HOUR THEN r.start ELSE c.last END, r.start - c.last >= INTERVAL 2 HOUR FROM c JOIN r ON r.key = c.key AND r.n = c.n + 1)
          SELECT key, start + INTERVAL 1 HOUR AS window_end, errors FROM c WHERE pass""")
def error_rate_pipeline(spark, sf_dir):
    """Errors by user and hour, at most one alert in two hours for each user."""
    flow = events(spark, sf_dir).pipe(
        op.filter_op("event_type = 'error'"), op.key_by("user_id"), op.tumbling_window("1h", {"errors": F.count("*")}), op.map_op({"offset": F.unix_micros("end")}), op.throttle("2h"),
    )
    return flow.df.select("key", F.col("end").cast("timestamp_ntz").alias("window_end"), "errors")


def _folder(spark: SparkSession) -> str:
    """A folder of this query's own: beside the checkpoints, or (tests) on this machine."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.gettempdir()}/tidemark-{uuid.uuid4().hex}"


def _first(spark, sf_dir, n: int) -> DataFrame:
    """Some events, as plain columns."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(f"event_id < {n}").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query(f"SELECT event_id AS line, CASE WHEN event_id % 3 <> 1 THEN event_id END AS event_id, CASE WHEN event_id % 3 <> 1 THEN cents END AS cents FROM ({EVENTS}) WHERE event_id >= 5 AND event_id % 3 <> 2")
def file_source(spark, sf_dir):
    """Lines of a file, from the sixth on: two of three are kept, of which every other isn't JSON; the third is blank and yet takes an index."""
    to, rows = _folder(spark), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id", "cents"))).when(F.col("event_id") % 3 == 1, "{broken").otherwise("")
    rows.coalesce(1).sortWithinPartitions("event_id").select(text.alias("value")).write.text(to)
    source = sources.FileSource(to)
    source.seek(None, 5)
    return sources.from_source(spark, source, "event_id bigint, cents bigint").df.select(F.col("offset").alias("line"), "payload.event_id", "payload.cents")


@query("SELECT \"offset\", partition, n FROM (SELECT range // 3 AS \"offset\", (range % 3)::VARCHAR AS partition, range AS n FROM range(300)) WHERE \"offset\" >= CASE partition WHEN '0' THEN 90 WHEN '1' THEN 41 ELSE 0 END")
def log_consumer(spark, sf_dir):
    """A log of three partitions: one is read from a given offset, one from after what was committed, one whole."""
    with tempfile.TemporaryDirectory(prefix="tidemark-log-") as at:
        log = sources.PartitionedLog(at, 3)
        for n in range(300):
            log.append({"n": n}, partition=n % 3)
        consumer = log.consumer()
        consumer.seek(0, 90)
        consumer.commit(1, 40)
        rows = consumer.read(spark, "n bigint").select("offset", "partition", "n").collect()
    return spark.createDataFrame(rows, "offset bigint, partition string, n bigint")


@query("SELECT unnest(range(4, 10)) AS n, 'drop_oldest' AS policy UNION ALL SELECT unnest(range(0, 6)), 'sample'")
def queue_policies(spark, sf_dir):
    """Ten records into a queue of six, by policy."""
    out = None
    for policy in ("drop_oldest", "sample"):
        queue = sources.QueueSource(6, policy)
        for n in range(10):
            queue.push({"n": n})
        got = queue.drain(spark, schema="n bigint").select("payload.n", F.lit(policy).alias("policy"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"SELECT event_id, cents, 'main' AS place FROM ({EVENTS}) WHERE cents < 20000 UNION ALL SELECT event_id, cents, 'dlq' FROM ({EVENTS}) WHERE NOT cents < 20000")
def job_tables(spark, sf_dir):
    """A job that writes valid records to one table and dead letters to another."""
    to = _folder(spark)
    Job([TableSink(f"{to}/main")], dlq=TableSink(f"{to}/dlq")).run(events(spark, sf_dir).pipe(op.validate("cents < 20000")))
    return spark.read.parquet(f"{to}/main").select("event_id", "cents", F.lit("main").alias("place")).unionByName(spark.read.parquet(f"{to}/dlq").select("event_id", "cents", F.lit("dlq").alias("place")))


@query(f"SELECT event_id, 'sink' AS stage, 'OSError: down' AS error FROM ({EVENTS}) WHERE event_id < 5 UNION ALL SELECT event_id, 'sink', 'circuit_open' FROM ({EVENTS}) WHERE event_id BETWEEN 5 AND 49")
def protected_sink(spark, sf_dir):
    """Fifty records to a sink that is down: five fail, each once whatever the retries, and the breaker keeps the others off; all are dead letters."""

    class Down(RowSink):
        def write_row(self, row):
            raise OSError("down")

    to = _folder(spark)
    Job([ProtectedSink(Down(), dead=TableSink(to))]).run(events(spark, sf_dir).pipe(op.filter_op("event_id < 50")))
    return spark.read.parquet(to).select("event_id", F.col("headers")["dlq_stage"].alias("stage"), F.col("headers")["dlq_error"].alias("error"))


def _resumed(spark, sf_dir, delivery: str) -> DataFrame:
    to = _folder(spark)
    with tempfile.TemporaryDirectory(prefix="tidemark-log-") as at:
        log, rows = sources.PartitionedLog(at), _first(spark, sf_dir, 200).orderBy("event_id").collect()
        for part in (rows[:120], [], rows[120:]):
            for r in part:
                log.append({"event_id": r.event_id, "cents": r.cents}, key=str(r.user_id % 3))
            job = Job([TableSink(f"{to}/out")], delivery=delivery, checkpoint_dir=f"{to}/state", keep=("total",))
            scan = op.scan_op(lambda s, r: s + r["cents"], 0, "total", "bigint", states=job.states(spark, "total"))
            job.run_source(spark, log.consumer(), scan, schema="event_id bigint, cents bigint")
    return spark.read.parquet(f"{to}/out").select("event_id", "key", "total")


RESUMED = f"SELECT event_id, (user_id % 3)::VARCHAR AS key, sum(cents) OVER (PARTITION BY user_id % 3 ORDER BY event_id)::BIGINT AS total FROM ({EVENTS}) WHERE event_id < 200"


@query(RESUMED)
def effectively_once_restart(spark, sf_dir):
    """Three runs of one job, the second with nothing new: running totals go on, and no record is written twice."""
    return _resumed(spark, sf_dir, "effectively_once")


@query(RESUMED)
def at_least_once_restart(spark, sf_dir):
    return _resumed(spark, sf_dir, "at_least_once")


@query(RESUMED)
def at_most_once_restart(spark, sf_dir):
    return _resumed(spark, sf_dir, "at_most_once")


@query(f"SELECT event_id, event_type, cents FROM ({EVENTS}) WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, cents FROM ({EVENTS}) WHERE event_type = 'error' AND cents > 1000")
def fan_out(spark, sf_dir):
    """Records to a sink within the flow, and on to the job's."""
    to = _folder(spark)
    Job([TableSink(f"{to}/end")]).run(events(spark, sf_dir).pipe(op.filter_op("event_type = 'error'"), op.fan_out(TableSink(f"{to}/middle")), op.filter_op("cents > 1000")))
    return spark.read.parquet(f"{to}/middle").select("event_id", "event_type", "cents").unionByName(spark.read.parquet(f"{to}/end").select("event_id", "event_type", "cents"))


@query(f"SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT + 100 AS total FROM ({EVENTS}) WHERE cents % 3 <> 0")
def scan_skip(spark, sf_dir):
    """A fold with a seed that leaves its state alone where it fails."""

    def step(state, record):
        if record["cents"] % 3 == 0:
            raise ValueError("a third")
        return state + record["cents"]

    return events(spark, sf_dir).pipe(op.scan_op(step, 100, "total", "bigint", on_error="skip")).df.select("event_id", "total")


@query(f"SELECT event_id, 100 + sum(cents) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM ({EVENTS})")
def scan_seeded_sum(spark, sf_dir):
    return events(spark, sf_dir).pipe(op.scan_op(F.sum("cents"), 100, "total", combine=lambda seed, x: seed + x)).df.select("event_id", "total")


@query("""SELECT p.event_id AS left_id, e.event_id AS right_id, greatest(p.ts, e.ts) AS event_time, CASE WHEN e.ts >= p.ts THEN e.event_id ELSE p.event_id END AS "offset"
          FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error' AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR""")
def join_stream_envelope(spark, sf_dir):
    """Each pair has time and offset of the record that came later."""
    e = events(spark, sf_dir)
    df = e.pipe(op.filter_op("event_type = 'purchase'"), op.join_stream(e.pipe(op.filter_op("event_type = 'error'")), "6h")).df
    return df.select(F.col("event_id").alias("left_id"), F.col("right.event_id").alias("right_id"), naive("event_time"), "offset")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def join_table_repeated(spark, sf_dir):
    """A table that holds each key twice gives one match all the same."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), "c_name")
    return events(spark, sf_dir).pipe(op.join_table(table.unionAll(table))).df.select("event_id", "right.c_name")


@query(f"""SELECT event_id, lag(cents, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS latest FROM ({EVENTS})""")
def upsert_table(spark, sf_dir):
    """Each record finds itself as its key's latest row."""
    return events(spark, sf_dir).pipe(op.upsert_table(state_id="t"), op.join_table_state("t")).df.select("event_id", F.col("right.cents").alias("latest"))


@query("SELECT event_id, event_id AS \"offset\" FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT event_id, event_id FROM events WHERE event_id % 50 = 0")
def share(spark, sf_dir):
    """Two readers of one shared flow."""
    kept = events(spark, sf_dir).share()
    return kept.pipe(op.filter_op("event_id % 50 <> 0")).df.select("event_id", "offset").unionByName(kept.pipe(op.filter_op("event_id % 50 = 0")).df.select("event_id", "offset"))


@query("""SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '2030-01-01' ELSE ts END, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL""")
def missing_event_time(spark, sf_dir):
    """Records without a time of their own take the clock's."""
    flow = events(spark, sf_dir).pipe(op.map_op({"event_time": F.when(F.col("event_id") % 10 != 0, F.col("event_time"))}))
    df = flow.pipe(op.tumbling_window("1h", {"n": F.count("*")}, clock=datetime(2030, 1, 1, tzinfo=timezone.utc))).df
    return df.select("key", naive("start"), "n")


@query(f"""WITH RECURSIVE valid AS (SELECT * FROM ({MARKED}) WHERE event_type = 'purchase' AND cents > 0 AND ts >= wm),
          fresh AS (SELECT * FROM (SELECT *, lag(cents) OVER (PARTITION BY user_id ORDER BY o) AS b, row_number() OVER (PARTITION BY user_id ORDER BY o) AS k FROM valid) WHERE k = 1 OR cents IS DISTINCT FROM b),
          panes AS (SELECT user_id AS key, s AS start, count(*) AS n, sum(cents)::BIGINT AS cents FROM (
                    SELECT *, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 30 MINUTE AS s FROM fresh, (SELECT unnest(range(0, 4)) AS i)) GROUP BY ALL),
          risky AS (SELECT panes.*, c_nationkey FROM panes JOIN customer ON key = c_custkey WHERE cents >= 5000 AND c_acctbal > 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS k FROM risky),
          c AS (SELECT *, start AS last, true AS pass FROM r WHERE k = 1
                UNION ALL SELECT r.*, CASE WHEN r.start - c.last >= INTERVAL 3 HOUR THEN r.start ELSE c.last END, r.start - c.last >= INTERVAL 3 HOUR FROM c JOIN r ON r.key = c.key AND r.k = c.k + 1)
          SELECT key, start + INTERVAL 2 HOUR AS window_end, n, cents, c_nationkey FROM c WHERE pass""")
def fraud_pipeline(spark, sf_dir):
    """Validated purchases, without repeats, summed over sliding windows, joined to customers in credit, at most one alert in three hours for each user."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_nationkey")
    flow = disordered(spark, sf_dir).pipe(
        op.assign_watermarks("30m"),
        op.filter_op("event_type = 'purchase'"),
        op.validate("cents > 0"),
        op.filter_op("event_time >= watermark"),
        op.distinct_until_changed("cents"),
        op.sliding_window("2h", "30m", {"n": F.count("*"), "cents": F.sum("cents")}),
        op.filter_op("cents >= 5000"),
        op.join_table(customers),
        # panes of a key are throttled in order of their ends
        op.map_op({"offset": F.unix_micros("end")}),
        op.throttle("3h"),
    )
    return flow.df.select("key", F.col("end").cast("timestamp_ntz").alias("window_end"), "n", "cents", "right.c_nationkey")
