"""Counts by stage, collected in the plan while it runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .flow import Flow, Operator


@dataclass
class StageMetrics:
    records_in: int = 0
    records_out: int = 0
    dropped: int = 0
    late: int = 0
    dlq: int = 0
    errors: int = 0


@dataclass
class Metrics:
    """``stage`` wraps an operator; after an action on its flow ``snapshot`` has the counts (a side table counts once it has been read)."""

    watermark: datetime | None = None
    lag_seconds: float | None = None
    _seen: dict[str, dict[str, Observation]] = field(default_factory=dict)
    _errors: dict[str, int] = field(default_factory=dict)

    def stage(self, name: str, op: Operator) -> Operator:
        def run(flow: Flow) -> Flow:
            seen = self._seen.setdefault(name, {})
            before = set(flow.side)
            seen["records_in"] = Observation(f"{name}_in_{len(self._seen)}")
            out = op(flow.with_df(flow.df.observe(seen["records_in"], F.count("*").alias("n"))))
            seen["records_out"] = Observation(f"{name}_out_{len(self._seen)}")
            out = out.with_df(out.df.observe(seen["records_out"], F.count("*").alias("n")))
            side = dict(out.side)
            for k in set(side) - before:
                kind = {"late": "late", "dlq": "dlq"}.get(k, "dropped")
                seen[kind] = Observation(f"{name}_{k}_{len(self._seen)}")
                side[k] = side[k].observe(seen[kind], F.count("*").alias("n"))
            return out.with_side(side)

        return run

    def snapshot(self, *, read: dict[str, tuple[str, ...]] | None = None) -> dict[str, StageMetrics]:
        """Counts by stage.  ``read`` names, for a stage, the side tables (``late``, ``dlq``, ``dropped``) that have been read, since waiting for others would not end."""
        out = {}
        for name, seen in self._seen.items():
            wanted = ("records_in", "records_out", *(read or {}).get(name, ()))
            out[name] = StageMetrics(**{k: seen[k].get["n"] for k in wanted if k in seen})
        for name, n in self._errors.items():
            out.setdefault(name, StageMetrics()).errors = n
        return out

    def failed(self, stage: str) -> None:
        """A stage stopped the job."""
        self._errors[stage] = self._errors.get(stage, 0) + 1

    def summary(self, **kw) -> str:
        return "\n".join(f"{k}: {asdict(v)}" for k, v in self.snapshot(**kw).items())

    def told(self, watermark: datetime | None, now: datetime) -> None:
        """Record a watermark, and how far it is behind the clock."""
        self.watermark = watermark
        self.lag_seconds = None if watermark is None else (now - watermark).total_seconds()


class ProgressListener(StreamingQueryListener):
    """Keeps each streaming query's rows, watermark and state sizes."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.watermarks: dict[str, str] = {}
        self.state_rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p, name = event.progress, event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        if "watermark" in (p.eventTime or {}):
            self.watermarks[name] = p.eventTime["watermark"]
        self.state_rows[name] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
