"""Keyed state: the status of issues, and lag, dead-letter and failure rules for queues.

The transitions are plain functions of a state and an input; the stream keeps a state for each key, and a batch job can fold the same functions.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR, HISTORY = 3600, 7 * 24


@dataclass(frozen=True)
class Thresholds:
    lag_min: int = 1000
    lag_factor: float = 5.0
    oldest_age: int = 300
    sustain: int = 300
    resolve: int = 900


@dataclass
class BusState:
    """peaks: hour to highest backlog; breach_since, below_since: seconds, 0 for not; open: an issue is open; depth: last known dead letters."""

    peaks: dict[int, int] = field(default_factory=dict)
    breach_since: int = 0
    below_since: int = 0
    open: bool = False
    depth: int | None = None


def baseline(peaks: dict[int, int], hour: int) -> int:
    """Nearest-rank 95th percentile of the completed hours' peaks, 0 without any."""
    values = sorted(v for h, v in peaks.items() if h < hour)
    return values[min(max((len(values) * 95 + 99) // 100 - 1, 0), len(values) - 1)] if values else 0


def lag(state: BusState, now: int, backlog: int | None, age: int, t: Thresholds) -> list[tuple[str, str, int]]:
    """(event, severity, threshold) for one reading of a queue's backlog and oldest message: lag while a breach is sustained, resolved after it has stayed away."""
    hour = now // HOUR
    state.peaks = {h: v for h, v in state.peaks.items() if h > hour - HISTORY}
    state.peaks[hour] = max(state.peaks.get(hour, 0), backlog or 0)
    threshold = max(t.lag_min, int(t.lag_factor * baseline(state.peaks, hour)))
    breach = (backlog is not None and backlog > threshold) or (t.oldest_age > 0 and age > t.oldest_age)
    if not breach:
        state.breach_since = 0
        if not state.open:
            return []
        state.below_since = state.below_since or now
        if now - state.below_since < t.resolve:
            return []
        state.open, state.below_since = False, 0
        return [("resolved", "info", threshold)]
    state.below_since = 0
    state.breach_since = state.breach_since or now
    if now - state.breach_since < t.sustain:
        return []
    state.open = True
    return [("lag", "critical" if t.oldest_age and age > 4 * t.oldest_age else "error", threshold)]


def dead_letters(state: BusState, depth: int | None, classes: list[str], newest: bool) -> list[tuple[str, int]]:
    """(error class, new messages) for one reading of a dead-letter queue. The first known depth is a baseline; with an unknown depth every sample is new."""
    if depth is None:
        added = len(classes)
        if not added:
            return []
    else:
        before, state.depth = state.depth, depth
        if before is None or depth <= before:
            return []
        added = depth - before
        if newest and added < len(classes):
            classes = classes[len(classes) - added :]
    return [(c, added) for c in sorted(set(classes))] or [("", added)]


def known(x: float | None) -> int | None:
    """A number as a whole one; none for null and NaN."""
    return None if x is None or x != x else int(x)


def evaluate(state: BusState, row: Any, t: Thresholds) -> list[dict]:
    """Events of one reading: condition (lag, dlq, failures), now, backlog, age, failures, classes, newest."""
    if row.condition == "lag":
        found = [{"event": e, "severity": s, "error_class": "", "amount": n} for e, s, n in lag(state, int(row.now), known(row.backlog), int(row.age or 0), t)]
    elif row.condition == "dlq":
        found = [{"event": "dlq", "severity": "error", "error_class": c, "amount": n} for c, n in dead_letters(state, known(row.backlog), list(row.classes), bool(row.newest))]
    else:
        found = [{"event": "failures", "severity": "error", "error_class": "", "amount": int(row.failures)}] if row.failures and row.failures > 0 else []
    return [f | {"now": int(row.now)} for f in found]


BUS_OUTPUT = "connector_id string, resource string, event string, severity string, error_class string, amount long, now long"
#: peaks as JSON: this kind of state holds no maps.
_STATE = "peaks string, breach_since long, below_since long, open boolean, depth long"


class BusRules(StatefulProcessor):
    """Readings of each (connector_id, resource) in time order through evaluate()."""

    def __init__(self, thresholds: Thresholds):
        self.thresholds = thresholds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bus", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        state = BusState({int(h): v for h, v in json.loads(known[0]).items()}, known[1], known[2], known[3], known[4]) if known else BusState()
        out = []
        for row in pd.concat(list(rows)).sort_values("now", kind="stable").itertuples():
            out += [dict(zip(("connector_id", "resource"), key, strict=True)) | e for e in evaluate(state, row, self.thresholds)]
        self.state.update((json.dumps(state.peaks), state.breach_since, state.below_since, state.open, state.depth))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BUS_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def bus_events(readings: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Events of readings, streaming: state by (connector_id, resource)."""
    return readings.groupBy("connector_id", "resource").transformWithStateInPandas(BusRules(thresholds or Thresholds()), BUS_OUTPUT, "Append", "None")


def bus_events_batch(readings: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """The same over a table: tasks go through the readings of one resource after the other, in time order, and hold the state of one."""
    t = thresholds or Thresholds()
    columns = ["condition", "now", "backlog", "age", "failures", "classes", "newest"]
    of = Window.partitionBy("connector_id", "resource").orderBy("now")  # brings a resource's readings together, unless they are, and sorts them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, state = namedtuple("reading", columns), BusState()
        for batch in batches:
            places, out = [], []
            for i, (n, *values) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", *columns)), strict=True)):
                state = BusState() if n == 1 else state
                for e in evaluate(state, reading(*values), t):
                    places.append(i)
                    out.append(e)
            keys = [batch.column(c).take(pa.array(places, pa.int64())) for c in ("connector_id", "resource")]
            found = [pa.array([e[c] for e in out], kind) for c, kind in (("event", pa.string()), ("severity", pa.string()), ("error_class", pa.string()), ("amount", pa.int64()), ("now", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, *found], names=[c.split()[0] for c in BUS_OUTPUT.split(", ")])

    return readings.withColumn("n", F.row_number().over(of)).select("connector_id", "resource", "n", *columns).mapInArrow(run, BUS_OUTPUT)


def next_status(status: str | None, occurrences: int, suppressed: int, decoded: bool) -> str:
    if status is None:
        return "suppressed" if occurrences == 0 and suppressed > 0 else "new"
    if occurrences > 0 and status == "resolved":
        return "regressed"
    if occurrences > 0 and status == "suppressed":
        return "decoded" if decoded else "new"
    if occurrences == 0 and suppressed > 0 and status not in ("acknowledged", "resolved"):
        return "suppressed"
    return status


STATUS_OUTPUT = "fingerprint string, status string, occurrences long, suppressed long"


class IssueStatus(StatefulProcessor):
    """Status and totals of each fingerprint over windows (fingerprint, window, occurrences, suppressed, command), in window order.

    command: acknowledge, resolve or decode, set by people and decoders; null for a window of events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("issue", "status string, occurrences long, suppressed long, decoded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, occurrences, suppressed, decoded = self.state.get() if self.state.exists() else (None, 0, 0, False)
        for row in pd.concat(list(rows)).sort_values("window", kind="stable").itertuples():
            if isinstance(row.command, str):
                decoded = decoded or row.command == "decode"
                status = {"acknowledge": "acknowledged", "resolve": "resolved", "decode": "decoded"}[row.command] if status else status
                continue
            status = next_status(status, row.occurrences, row.suppressed, decoded)
            occurrences, suppressed = occurrences + int(row.occurrences), suppressed + int(row.suppressed)
        self.state.update((status, occurrences, suppressed, decoded))
        yield pd.DataFrame({"fingerprint": [key[0]], "status": [status], "occurrences": [occurrences], "suppressed": [suppressed]})

    def close(self) -> None:
        pass


def issue_statuses(windows: DataFrame) -> DataFrame:
    """The status of each fingerprint after each micro-batch that touched it."""
    return windows.groupBy("fingerprint").transformWithStateInPandas(IssueStatus(), STATUS_OUTPUT, "Update", "None")
