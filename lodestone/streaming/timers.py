"""Watch state that lives on timers: debounced batches, quiet periods, overflow recovery, notifications, arming.

Each is a small machine over one (user, device): ``on_event`` and ``on_timer`` take the state, a plain dictionary, and
a time in milliseconds, and give the rows that come out; ``state["due"]`` is when the machine wants to be called
again. ``streamed`` runs a machine by ``transformWithState`` with timers of event time, so a recovered stream goes on
where it was; ``replayed`` runs the same machine over a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of the timers, the longest delay, and the largest count of failures.
BATCH_MS, QUIET_MS, NOTIFY_MS, MAX_BATCH_MS = 250, 2_000, 250, 5_000
WATCH_BASE_MS, OVERFLOW_BASE_MS, MOST_MS, MOST_FAILS = 30_000, 10_000, 600_000, 20
#: What machines take and give; ``kind`` says what a row is, and ``detail`` holds a JSON object.
EVENT = "uid long, device_id string, ts timestamp, kind string, detail string"
OUT = "uid long, device_id string, at_ms long, kind string, detail string"


def backoff_ms(base: int, doublings: int) -> int:
    return min(MOST_MS, base << min(max(doublings, 0), 30))


class Debounce:
    """``touch`` and ``overflow`` events gathered until ``BATCH_MS`` without one, or ``MAX_BATCH_MS`` after the first.

    Masks of one (fsid, handle, name) are or-ed. Touches of which none has a name leave one generic token.
    """

    def on_event(self, state: dict, now: int, kind: str, detail: dict) -> list:
        if kind not in ("touch", "overflow"):
            return []
        state.setdefault("first", now)
        state["due"] = min(now + BATCH_MS, state["first"] + MAX_BATCH_MS)
        if kind == "overflow":
            state["overflow"] = True
            return []
        state["seen"] = True
        key = [detail.get("fsid") or "", detail.get("handle") or "", detail.get("name") or ""]
        if all(key):
            held = state.setdefault("held", {})
            name = json.dumps(key, ensure_ascii=False)
            held[name] = held.get(name, 0) | int(detail.get("mask") or 0)
        return []

    def on_timer(self, state: dict, now: int) -> list:
        touched = [[*json.loads(k), m] for k, m in sorted(state.get("held", {}).items())]
        if state.get("seen") and not touched:
            touched = [["", "", "*", 1]]
        out = {"touched": touched, "overflow": state.get("overflow", False)}
        state.clear()
        return [("batch", out)]


class Quiet:
    """One ``rescan`` after ``QUIET_MS`` without an ``unsafe`` event."""

    def on_event(self, state: dict, now: int, kind: str, detail: dict) -> list:
        if kind == "unsafe":
            state["due"] = now + QUIET_MS
        return []

    def on_timer(self, state: dict, now: int) -> list:
        state.clear()
        return [("rescan", {})]


class Overflow:
    """A ``recovery`` some time after an ``overflow``, later after each ``refused`` one; the earliest schedule is kept."""

    def on_event(self, state: dict, now: int, kind: str, detail: dict) -> list:
        if kind == "refused":
            state["fails"] = min(state.get("fails", 0) + 1, MOST_FAILS)
        elif kind == "started":
            state.pop("fails", None)
        if kind in ("overflow", "refused"):
            at = now + backoff_ms(OVERFLOW_BASE_MS, state.get("fails", 0))
            state["due"] = min(state.get("due", at), at)
        return []

    def on_timer(self, state: dict, now: int) -> list:
        state.pop("due")
        return [("recovery", {"fails": state.get("fails", 0)})]


class Notify:
    """One ``notification`` with the last ``update``, ``NOTIFY_MS`` after the first of them."""

    def on_event(self, state: dict, now: int, kind: str, detail: dict) -> list:
        if kind == "update":
            state.setdefault("due", now + NOTIFY_MS)
            state["last"] = detail
        return []

    def on_timer(self, state: dict, now: int) -> list:
        last = state["last"]
        state.clear()
        return [("notification", last)]


class Arm:
    """The state of a watch: ``pending``, ``watching``, ``notMounted`` or ``error``.

    ``target`` events bring the mount point that is wanted now (none: not mounted; ``wanted`` false: no watch at
    all), ``armed`` and ``failed`` what came of the last try. A try is a row ``arm``; a failed one is repeated after a
    growing delay, or with ``permanent`` only when the mount point changes.
    """

    def on_event(self, state: dict, now: int, kind: str, detail: dict) -> list:
        if kind == "target":
            mount = (detail.get("mount") or "").strip()
            if not detail.get("wanted", True):
                was = state.get("state")
                state.clear()
                return [("state", {"state": "off"})] if was else []
            if not mount:
                was = state.get("state")
                state.clear()
                state["state"] = "notMounted"
                return [("state", {"state": "notMounted"})] if was != "notMounted" else []
            changed = state.get("mount") != mount
            if changed or state.get("state") not in ("watching", "error", "pending"):
                state.clear()
                state.update(mount=mount, state="pending")
                return [("arm", {"mount": mount})]
            return []
        if kind == "armed" and state.get("state") == "pending":
            mount = state["mount"]
            state.clear()
            state.update(mount=mount, state="watching", mode=detail.get("mode", ""))
            return [("state", {"state": "watching", "mode": state["mode"]})]
        if kind == "failed" and state.get("state") in ("pending", "watching"):
            state["state"] = "error"
            state["fails"] = state.get("fails", 0) + 1
            out = {"state": "error", "error": detail.get("error", ""), "fails": state["fails"]}
            if detail.get("permanent"):
                state["only_on_remount"] = True
                return [("state", out | {"retry": "onRemount"})]
            state["due"] = now + backoff_ms(WATCH_BASE_MS, state["fails"] - 1)
            return [("state", out | {"retry": "backoff", "retry_at": state["due"]})]
        return []

    def on_timer(self, state: dict, now: int) -> list:
        state.pop("due")
        state["state"] = "pending"
        return [("arm", {"mount": state["mount"]})]


def rescan_allowed(indexed: bool, watch_enabled: bool, running: bool) -> bool:
    """An automatic rescan needs an index, a watch that is on, and no job at work."""
    return indexed and watch_enabled and not running


def stepped(machine, state: dict, events: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Rows from events in order of time; timers that fall due before an event go first."""
    out = []
    for now, kind, detail in sorted(events):
        while state.get("due", now + 1) <= now:
            out += fired(machine, state)
        out += [(now, k, json.dumps(d, sort_keys=True, ensure_ascii=False)) for k, d in machine.on_event(state, now, kind, json.loads(detail or "{}"))]
    return out


def fired(machine, state: dict) -> list[tuple[int, str, str]]:
    at = state["due"]
    return [(at, k, json.dumps(d, sort_keys=True, ensure_ascii=False)) for k, d in machine.on_timer(state, at)]


class Processor(StatefulProcessor):
    """A machine whose state is kept as one JSON value, with one timer at a time."""

    def __init__(self, machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", "json string")

    def _load(self) -> dict:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def _save(self, before: int | None, state: dict) -> None:
        due = state.get("due")
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if state:
            self.kept.update((json.dumps(state),))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._load()
        before = state.get("due")
        events = [(int(r["ts"].timestamp() * 1000), r["kind"], r["detail"]) for r in rows]
        out = stepped(self.machine, state, events)
        self._save(before, state)
        for at, kind, detail in out:
            yield Row(uid=key[0], device_id=key[1], at_ms=at, kind=kind, detail=detail)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        due = state.get("due")
        out = fired(self.machine, state) if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs() else []
        # The timer that has expired is gone; only a new one is registered.
        new = state.get("due")
        if new is not None and new != due:
            self.handle.registerTimer(new)
        if state:
            self.kept.update((json.dumps(state),))
        else:
            self.kept.clear()
        for at, kind, detail in out:
            yield Row(uid=key[0], device_id=key[1], at_ms=at, kind=kind, detail=detail)

    def close(self) -> None:
        pass


def streamed(events: DataFrame, machine, watermark: str = "1 second") -> DataFrame:
    """Rows of ``OUT`` from a stream of ``EVENT`` rows; timers fire as the watermark passes them.

    Needs a state store with timers (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    keyed = events.select("uid", "device_id", "ts", "kind", "detail").withWatermark("ts", watermark).groupBy("uid", "device_id")
    return keyed.transformWithState(Processor(machine), OUT, "Append", "EventTime")


def replayed(events: DataFrame, machine) -> DataFrame:
    """The same over a table of ``EVENT`` rows, all timers run out; one user's device at a time."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        times = (rows["ts"].astype("datetime64[ms]").astype("int64")).tolist()
        out = stepped(machine, state, list(zip(times, rows["kind"], rows["detail"].fillna("{}"), strict=True)))
        while "due" in state:
            out += fired(machine, state)
        return pd.DataFrame([(key[0], key[1], *r) for r in out], columns=["uid", "device_id", "at_ms", "kind", "detail"])

    return events.select("uid", "device_id", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), "kind", "detail").groupBy("uid", "device_id").applyInPandas(run, OUT)
