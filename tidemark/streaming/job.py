"""Jobs: a flow's tables to sinks, bounded or streaming, with a delivery promise."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..failures import StreamProcessingError, told
from ..flow import Flow, Operator
from ..metrics import Metrics
from ..operators.keyed import last_states
from ..sinks import ProtectedSink, Sink, close_all
from ..sources.base import Source
from ..state import KeyValueStore, load_checkpoint, save_checkpoint
from ..storage import read_bytes, write_bytes

DELIVERY = ("at_most_once", "at_least_once", "effectively_once")


class Subscription:
    """A running job."""

    def __init__(self, queries: list[StreamingQuery], sinks: list[Sink]):
        self.queries, self.sinks = queries, sinks

    def drain(self) -> None:
        """Finish what has arrived, then stop."""
        for q in self.queries:
            q.processAllAvailable()
        self.cancel()

    def cancel(self) -> None:
        """Stop; checkpoints stay, so a later run goes on."""
        for q in self.queries:
            q.stop()
        close_all(self.sinks)

    def wait(self) -> None:
        for q in self.queries:
            q.awaitTermination()


class Ledger:
    """Which micro-batches were begun or delivered, beside the checkpoint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> int:
        held = read_bytes(self.spark, self.path)
        return -1 if held is None else json.loads(held)["batch"]

    def mark(self, batch: int) -> None:
        write_bytes(self.spark, self.path, json.dumps({"batch": batch}).encode())


class Job:
    """``run`` writes a bounded flow, ``run_source`` what a source has from its checkpoint on; ``start`` runs a streaming flow.

    * ``at_most_once``: a batch is committed before it is written; a crash loses it.
    * ``at_least_once``: a batch is written, then committed; a crash between repeats it.
    * ``effectively_once``: offsets and state are saved together after each batch, and a batch that is saved isn't written again.

    With ``protect_sinks`` a failing sink's records go to ``dlq`` (see :class:`ProtectedSink`).  ``keep`` names columns whose last value for each key is kept as a table beside
    the checkpoint; ``states`` gives it back to a later run.  ``state`` is small and the driver's.
    """

    def __init__(self, sinks: list[Sink], *, dlq: Sink | None = None, side_outputs: dict[str, Sink] | None = None, delivery: str = "at_most_once", checkpoint_dir: str | None = None,
                 protect_sinks: bool = True, keep: tuple[str, ...] = (), state: KeyValueStore | None = None, metrics: Metrics | None = None,
                 on_error: Callable[[Exception], object] | None = None, on_complete: Callable[[], object] | None = None):
        if delivery not in DELIVERY:
            raise ValueError(f"unknown delivery {delivery!r}")
        if checkpoint_dir is None and (delivery == "effectively_once" or keep):
            raise ValueError(f"{delivery} with {len(keep)} states needs a checkpoint_dir")
        self.sinks = [ProtectedSink(s, dead=dlq) if protect_sinks and not isinstance(s, ProtectedSink) else s for s in sinks]
        self.delivery, self.checkpoint_dir, self.keep = delivery, checkpoint_dir, keep
        self.side = dict(side_outputs or {}) | ({"dlq": dlq} if dlq else {})
        self.state, self.metrics = state or KeyValueStore(), metrics
        self.on_error, self.on_complete = on_error, on_complete
        self.offsets: dict = {}

    def states(self, spark: SparkSession, name: str) -> DataFrame | None:
        """(key, state) of a kept column, as the last run left it."""
        at = load_checkpoint(spark, self.checkpoint_dir)[2].get(name)
        return None if at is None else spark.read.parquet(at)

    def _write(self, flow: Flow) -> None:
        flow.serve()
        shared = flow.share() if len(self.sinks) + len(self.keep) > 1 else flow
        try:
            for sink in self.sinks:
                sink.write(shared.df)
                sink.flush()
            for name, sink in self.side.items():
                if name in flow.side:
                    sink.write(flow.side[name])
                    sink.flush()
            self._kept = {name: self._keep(shared.df, name) for name in self.keep}
        finally:
            shared.release()

    def _keep(self, df: DataFrame, name: str) -> str:
        new, old = last_states(df, name), self.states(df.sparkSession, name)
        if old is not None:
            new = new.unionByName(old.join(new.select(F.col("key").alias("__key")), F.col("key").eqNullSafe(F.col("__key")), "left_anti"))
        to = f"{self.checkpoint_dir}/states/{name}-{uuid.uuid4().hex}"
        new.write.parquet(to)
        return to

    def _guarded(self, work: Callable[[], None], closing: list) -> None:
        try:
            work()
        except Exception as e:
            error = told(e)
            if self.metrics is not None and isinstance(error, StreamProcessingError):
                self.metrics.failed(error.stage)
            if self.on_error is None:
                raise error from e
            self.on_error(error)
            return
        finally:
            close_all([*self.sinks, *self.side.values(), *closing])
        if self.on_complete:
            self.on_complete()

    def run(self, flow: Flow | DataFrame) -> None:
        flow = flow if isinstance(flow, Flow) else Flow(flow)

        def work() -> None:
            self._write(flow)
            if self.checkpoint_dir:
                save_checkpoint(flow.df.sparkSession, self.checkpoint_dir, self.state, self.offsets, self._kept)

        self._guarded(work, [])

    def run_source(self, spark: SparkSession, source: Source, *ops: Operator, schema=None) -> None:
        """What the source has beyond the checkpoint's offsets, through the operators, to the sinks; then source and checkpoint are told how far it went."""

        def work() -> None:
            if self.checkpoint_dir:
                held, self.offsets, _ = load_checkpoint(spark, self.checkpoint_dir)
                self.state.load(held.dump() | self.state.dump())
            for part, offset in self.offsets.items():
                source.seek(part, offset + 1)
            rows = source.read(spark, schema)
            ends = {int(r["partition"]) if str(r["partition"]).isdigit() else r["partition"]: r["last"] for r in rows.groupBy("partition").agg(F.max("offset").alias("last")).collect()}
            # what comes in the meantime is for the next run
            due = [(F.col("partition") == str(p)) & (F.col("offset") <= end) for p, end in ends.items()]
            taken = rows.where(F.lit(False) if not due else due[0] if len(due) == 1 else F.greatest(*due))
            if self.delivery == "at_most_once":
                for part, end in ends.items():
                    source.commit(part, end)
            self._write(Flow(taken, source=source).pipe(*ops))
            self.offsets = self.offsets | ends
            if self.checkpoint_dir:
                save_checkpoint(spark, self.checkpoint_dir, self.state, self.offsets, self._kept)
            if self.delivery != "at_most_once":
                for part, end in ends.items():
                    source.commit(part, end)

        self._guarded(work, [source])

    def _start(self, df: DataFrame, sinks: list[Sink], name: str, output_mode: str, trigger: dict) -> StreamingQuery:
        ledger = Ledger(df.sparkSession, f"{self.checkpoint_dir}/{name}-ledger/batch.json") if self.checkpoint_dir else None

        def deliver(batch: DataFrame, number: int) -> None:
            if ledger and self.delivery != "at_least_once" and number <= ledger.last():
                return
            if ledger and self.delivery == "at_most_once":
                ledger.mark(number)
            batch = batch.persist() if len(sinks) > 1 else batch
            for sink in sinks:
                sink.write(batch)
                sink.flush()
            if self.delivery == "effectively_once":
                ledger.mark(number)
            batch.unpersist()

        writer = df.writeStream.outputMode(output_mode).foreachBatch(deliver).trigger(**trigger)
        if self.checkpoint_dir:
            writer = writer.option("checkpointLocation", f"{self.checkpoint_dir}/{name}")
        return writer.start()

    def start(self, flow: Flow | DataFrame, *, output_mode: str = "append", trigger: dict | None = None) -> Subscription:
        """One query for the main table, one for each side table that has a sink."""
        flow = flow if isinstance(flow, Flow) else Flow(flow)
        trigger = trigger or {"processingTime": "0 seconds"}
        queries = [self._start(flow.df, self.sinks, "main", output_mode, trigger)]
        queries += [self._start(flow.side[n], [s], n, "append", trigger) for n, s in self.side.items() if n in flow.side]
        return Subscription(queries, [*self.sinks, *self.side.values()])
