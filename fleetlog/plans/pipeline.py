"""As-of pipelines: a cadence, a lookback, gates and tasks, as one set-based plan.

Ticks are a table. Gates narrow it by semi-joins, each task is one plan over what is left.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_seconds
from ..operators.gates import gate_and
from ..operators.lookback import TICK, asof_rows, lookback_frames, lookback_time
from ..operators.panes import Mergeable, aggregate_frames, aggregate_time
from ..operators.rowindex import join_same
from ..operators.ticks import ticks_at_end, ticks_every_frames, ticks_every_seconds

NAME = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*")
UNITS = ("frame", "second", "minute", "hour")


class SpecError(ValueError):
    """A pipeline's description is wrong."""


@dataclass(frozen=True)
class Every:
    value: float
    unit: str

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise SpecError(f"unknown unit {self.unit!r}")
        if self.value <= 0:
            raise SpecError("a cadence or lookback is above 0")

    def seconds(self) -> float:
        return to_seconds(self.value, self.unit)


@dataclass(frozen=True)
class Seen:
    """What each of ``ticks`` sees: its lookback by time or by frames, without one all so far.

    Calling it on a frame, or on none for the run's own messages, gives the rows, copied to each tick that sees them;
    ``aggregate`` gives mergeable aggregates of them, at a cost of rows and ticks, however much lookbacks overlap."""

    ticks: DataFrame
    lookback: Every | None
    messages: DataFrame | None = None

    def __call__(self, df: DataFrame | None = None) -> DataFrame:
        df = self.messages if df is None else df
        if self.lookback is None:
            return asof_rows(df, self.ticks)
        if self.lookback.unit == "frame":
            return lookback_frames(df, self.ticks, int(self.lookback.value))
        return lookback_time(df, self.ticks, self.lookback.seconds())

    def aggregate(self, df: DataFrame | None, aggregates: dict[str, Mergeable], huge: bool = False, empty: bool = False) -> DataFrame:
        df = self.messages if df is None else df
        if self.lookback is not None and self.lookback.unit == "frame":
            return aggregate_frames(df, self.ticks, int(self.lookback.value), aggregates, huge, empty)
        return aggregate_time(df, self.ticks, self.lookback and self.lookback.seconds(), aggregates, huge, empty)


#: A gate or a task: takes ticks, and ``Seen`` if it has a second argument.
Step = Callable[..., DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """``when``: None is once, at the end. ``lookback`` is that of all gates and tasks that have none of
    their own in ``lookbacks``."""

    name: str
    topic: str
    when: Every | None = None
    lookback: Every | None = None
    gates: dict[str, Step] = field(default_factory=dict)
    tasks: dict[str, Step] = field(default_factory=dict)
    allow_failure: bool = False
    lookbacks: dict[str, Every] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in (self.name, *self.gates, *self.tasks):
            if not NAME.fullmatch(name):
                raise SpecError(f"{name!r} is not lower_snake_case")

    def ticks(self, messages: DataFrame) -> DataFrame:
        cadence = messages.filter(F.col("topic") == self.topic)
        if self.when is None:
            return ticks_at_end(cadence)
        if self.when.unit == "frame":
            return ticks_every_frames(cadence, int(self.when.value))
        return ticks_every_seconds(cadence, self.when.seconds())

    def step(self, name: str, fn: Step, ticks: DataFrame, messages: DataFrame | None = None) -> DataFrame:
        if len(inspect.signature(fn).parameters) < 2:
            return fn(ticks)
        return fn(ticks, Seen(ticks, self.lookbacks.get(name, self.lookback), messages))

    def reaches(self) -> list[Every | None]:
        """The lookbacks of all gates and tasks; None sees all so far."""
        return [self.lookbacks.get(name, self.lookback) for name in (*self.gates, *self.tasks)]

    def run(self, messages: DataFrame, ticks: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
        """Each task's rows, and the run log. A task may mark ticks that failed with a column ``error``:
        later tasks have no rows there and, unless ``allow_failure``, no task has any at later ticks of
        that log."""
        ticks = self.ticks(messages) if ticks is None else ticks
        passed = gate_and(ticks, [lambda t, n=name, g=gate: self.step(n, g, t, messages) for name, gate in self.gates.items()])
        made = {name: self.step(name, task, passed, messages) for name, task in self.tasks.items()}
        failed = failures(list(made.values()))
        log = run_log(ticks, passed, failed, self.allow_failure)
        return {name: until_failed(df, i, failed, self.allow_failure) for i, (name, df) in enumerate(made.items())}, log


def failures(outputs: list[DataFrame]) -> DataFrame | None:
    """Ticks at which one of ``outputs`` has an error: the position of the first that failed, and its error."""
    found = None
    for i, df in enumerate(outputs):
        if "error" in df.columns:
            one = df.filter("error IS NOT NULL").select(*TICK, F.struct(F.lit(i).alias("task"), "error").alias("first"))
            found = one if found is None else found.union(one)
    return None if found is None else found.groupBy(*TICK).agg(F.min("first").alias("first")).select(*TICK, "first.task", "first.error")


def stops(failed: DataFrame) -> DataFrame:
    return failed.groupBy("log_id").agg(F.min("tick_no").alias("stopped"))


def until_failed(df: DataFrame, position: int, failed: DataFrame | None, allow_failure: bool) -> DataFrame:
    """The rows of the task at ``position`` that a run makes before it fails."""
    if failed is None or not set(TICK) <= set(df.columns):
        return df
    made = join_same(df, failed.select(*TICK, "task"), list(TICK), how="left").filter(F.col("task").isNull() | (F.col("task") >= position))
    if not allow_failure:
        made = join_same(made, stops(failed), ["log_id"], how="left").filter("stopped IS NULL OR tick_no <= stopped")
    return made.select(*df.columns)


def run_log(ticks: DataFrame, passed: DataFrame, failed: DataFrame | None, allow_failure: bool = False) -> DataFrame:
    """executed, skipped (a gate said no) or failed for each tick, with the error. Unless failures
    are allowed, ticks after a log's first failure are left out: the run stops there."""
    log = join_same(ticks.select(*TICK), passed.select(*TICK).withColumn("ok", F.lit(True)), list(TICK), how="left")
    log = log.withColumn("error", F.lit(None).cast("string")) if failed is None else join_same(log, failed.drop("task"), list(TICK), how="left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("ok"), "executed").otherwise("skipped")
    log = log.select(*TICK, status.alias("status"), "error")
    if allow_failure or failed is None:
        return log
    return join_same(log, stops(failed), ["log_id"], how="left").filter("stopped IS NULL OR tick_no <= stopped").drop("stopped")


def every_from(spec: dict | None, what: str) -> Every | None:
    if spec is None or spec == "once_at_end":
        return None
    if not isinstance(spec, dict) or set(spec) != {"value", "unit"}:
        raise SpecError(f"{what} needs value and unit")
    return Every(float(spec["value"]), str(spec["unit"]))


def pipeline_from_config(spec: dict, gates: dict[str, Step], tasks: dict[str, Step]) -> Pipeline:
    """A pipeline from a dict: name, cadence {topic, when}, lookback, gates and tasks. A gate or task is
    its name, or a dict of ``name`` and a ``lookback`` of its own."""
    for key in ("name", "cadence", "tasks"):
        if key not in spec:
            raise SpecError(f"a pipeline needs {key!r}")
    if "topic" not in spec["cadence"]:
        raise SpecError("a cadence needs 'topic'")
    chosen, lookbacks = {}, {}
    for kind, asked, known in (("gate", spec.get("gates", []), gates), ("task", spec["tasks"], tasks)):
        listed = [{"name": x} if isinstance(x, str) else x for x in asked]
        if any("name" not in x for x in listed):
            raise SpecError(f"a {kind} needs 'name'")
        if unknown := [x["name"] for x in listed if x["name"] not in known]:
            raise SpecError(f"unknown {kind}: {', '.join(unknown)}")
        chosen[kind] = {x["name"]: known[x["name"]] for x in listed}
        lookbacks |= {x["name"]: every_from(x["lookback"], "a lookback") for x in listed if x.get("lookback")}
    return Pipeline(
        spec["name"],
        spec["cadence"]["topic"],
        every_from(spec["cadence"].get("when"), "a cadence"),
        every_from(spec.get("lookback"), "a lookback"),
        chosen["gate"],
        chosen["task"],
        bool(spec.get("allow_failure", False)),
        lookbacks,
    )
