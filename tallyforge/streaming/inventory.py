"""VM run history from a stream of snapshots.

The history of a machine is a list of run cycles, each a summary that takes
snapshots in any order. A group of machines has one state and one timer,
set to when the first of them is gone unless it is listed again. When it ends,
the machines not listed since are gone: their cycles leave the state and their
intervals the table. It is set anew for the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge.sources.state import StateTable, load_state
from tallyforge.streaming.sink import keep_state

_TS, _STR, _LONG, _BOOL = T.TimestampType(), T.StringType(), T.LongType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


INTERVALS = _schema(project_id=_STR, vm_id=_STR, start=_TS, stop=_TS)
#: A run cycle; times are microseconds.
CYCLE = ("started", "first_seen", "last_seen", "first_stopped", "stop_reported", "opens_running", "opens_last_stop")
#: In place of a time that is null, since pandas has no null among integers.
NEVER = -2 ** 63
_SEEN = ("project_id", "vm_id", "at", "running", "started", "last_stop")
_CHANGED = _schema(project_id=_STR, vm_id=_STR, start=_LONG, stop=_LONG, gone=_BOOL)


def merged(cycles: dict, at: int, running: bool, started: int | None, last_stop: int | None) -> None:
    """Bring one snapshot into the cycles of its machine."""
    c = cycles.get(started)
    if c is None:
        c = cycles[started] = {"first_seen": at, "last_seen": at, "first_stopped": None, "stop_reported": None,
                               "opens_running": running, "opens_last_stop": last_stop}
    if at < c["first_seen"]:
        c.update(first_seen=at, opens_running=running, opens_last_stop=last_stop)
    c["last_seen"] = max(c["last_seen"], at)
    if not running and (c["first_stopped"] is None or at < c["first_stopped"]):
        c.update(first_stopped=at, stop_reported=last_stop)


def intervals(cycles: dict) -> dict[int | None, int | None]:
    """Start and stop of every cycle, by the rules of ``operators.inventory.cycle_intervals``."""
    order = sorted(cycles.items(), key=lambda c: (c[1]["first_seen"], c[0] is not None, c[0] or 0))
    out = {}
    for (started, c), (_, following) in zip(order, [*order[1:], (None, None)]):
        if c["first_stopped"] is not None:
            stop = c["stop_reported"]
        elif following is None:
            stop = None
        else:
            stop = following["opens_last_stop"] if following["opens_running"] else c["last_seen"]
        out[started] = stop
    return out


def _changed(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        out = pd.DataFrame(rows, columns=_CHANGED.names, dtype=object)
        yield out.assign(**{c: [NEVER if t is None else t for t in out[c]] for c in ("start", "stop")}).astype(
            {"start": "int64", "stop": "int64", "gone": "bool"})


class VmHistory(StatefulProcessor):
    """Cycles of a group of machines; one is gone once the watermark is ``absent`` past its last listing.

    The store takes several calls for every key with rows, so the key is a group of machines and not a machine, and
    the cycles of a group are one JSON text: lists of project, machine and cycles, which are lists as in ``CYCLE``.
    """

    def __init__(self, absent: timedelta):
        self.absent_ms = absent // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machines = handle.getValueState("machines", _schema(machines=_STR))

    def _held(self) -> dict[tuple[str, str], dict]:
        held = self.machines.get()
        return {(project, vm): {c[0]: dict(zip(CYCLE[1:], c[1:])) for c in cycles}
                for project, vm, cycles in (json.loads(held[0]) if held else ())}

    def _hold(self, machines: dict[tuple[str, str], dict]) -> None:
        if machines:
            rows = [(*vm, [(started, *c.values()) for started, c in cycles.items()]) for vm, cycles in machines.items()]
            self.machines.update((json.dumps(rows, separators=(",", ":")),))
        else:
            self.machines.clear()

    def _ends(self, cycles: dict) -> int:
        return max(c["last_seen"] for c in cycles.values()) // 1000 + self.absent_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machines = self._held()
        before = {}
        for part in rows:
            for project, vm_id, *seen in zip(*(part[c].tolist() for c in _SEEN)):
                vm = project, vm_id
                cycles = machines.setdefault(vm, {})
                if vm not in before:
                    before[vm] = intervals(cycles)
                merged(cycles, *(None if v == NEVER else v for v in seen))
        self._hold(machines)
        first = min(self._ends(cycles) for cycles in machines.values())
        if all(timer > first for timer in self.handle.listTimers()):
            self.handle.registerTimer(first)
        yield from _changed([(*vm, start, stop, False) for vm, known in before.items() for start, stop in intervals(machines[vm]).items()
                             if start not in known or known[start] != stop])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machines = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        gone = {vm: machines.pop(vm) for vm in [vm for vm, cycles in machines.items() if self._ends(cycles) < now]}
        if gone:
            self._hold(machines)
        if machines:
            # Spark deletes the timer that ended after this, also if it was set anew, so the next is later than it
            first = min(self._ends(cycles) for cycles in machines.values())
            self.handle.registerTimer(max(first, expiredTimerInfo.getExpiryTimeInMs() + 1))
        yield from _changed([(*vm, start, stop, True) for vm, cycles in gone.items() for start, stop in intervals(cycles).items()])

    def close(self) -> None:
        pass


def uptime_state(path: str) -> StateTable:
    return StateTable(path, INTERVALS, ("project_id", "vm_id", "start"), "date_format(start, 'yyyy-MM')", BUCKETS)


#: Groups that machines are dealt to, fixed for a checkpoint. A worker holds the cycles of one group at a time.
GROUPS = 512
#: Buckets of the table of intervals.
BUCKETS = 24


def stream_vm_uptime(snapshots: DataFrame, path: str, checkpoint: str, lateness: str, absent: timedelta,
                     once: bool = True, groups: int = GROUPS) -> StreamingQuery:
    """Keep the run history of every machine still listed at ``path``.

    A machine that no snapshot shows for ``absent``, as of the watermark, is no
    longer listed: its state and its intervals go. If it shows up again its
    history begins anew. ``lateness`` is how far snapshots may be out of order;
    Spark leaves out, and counts, what comes later than that.
    """
    micros = lambda c: F.coalesce(F.unix_micros(c), F.lit(NEVER))
    rows = snapshots.select(F.pmod(F.xxhash64("project_id", "vm_id"), F.lit(groups)).alias("machine_group"), "project_id", "vm_id",
                            "inventory_time", micros("inventory_time").alias("at"), (F.col("status") == "RUNNING").alias("running"),
                            micros("started").alias("started"), micros("last_stop").alias("last_stop"))
    changed = rows.withWatermark("inventory_time", lateness).groupBy("machine_group").transformWithStateInPandas(
        VmHistory(absent), _CHANGED, "Update", "EventTime")
    timed = changed.withColumns({c: F.timestamp_micros(F.nullif(F.col(c), F.lit(NEVER))) for c in ("start", "stop")})
    return keep_state(timed, uptime_state(path), checkpoint, once, removed=F.col("gone"))


def current_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Run/stop history of the listed machines as of the last batch."""
    return load_state(spark, uptime_state(path))
