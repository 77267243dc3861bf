"""Session context in event time: calls wait until the watermark has passed them.

State of a session is its waiting calls, the newest turns that a later call can still
be shown, and how many calls there were. A call waits until the watermark has passed
its time; calls whose turn has come are given out in the order of time and id,
each with the earlier ones that fit the budget, whatever order they arrived in.
A session that has no call for ``idle`` is forgotten by a timer, so state is
bounded by open sessions; a call after that begins the session anew.

A row without a time is dropped; one that is later than the watermark is dropped by the engine.
Equal rows are calls of their own. Null texts read as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, tool_use_id string, ts timestamp, prior_actions array<string>, actions_total bigint"
COLUMNS = ["session_id", "tool_use_id", "ts", "prior_actions", "actions_total"]
#: Rows that are given out at once.
ROWS = 1000


def fitting(turns: list[str], budget: int, turn_cost: int) -> list[str]:
    """The newest turns that fit; the newest always does."""
    used, n = 0, 0
    for turn in reversed(turns):
        if n and used + len(turn) + turn_cost > budget:
            break
        used, n = used + len(turn) + turn_cost, n + 1
    return turns[len(turns) - n :]


class SessionContext(StatefulProcessor):
    """Holds calls back, then gives them out in order."""

    def __init__(self, budget: int, turn_cost: int, idle_ms: int) -> None:
        self.budget, self.turn_cost, self.idle_ms = budget, turn_cost, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, id string, text string")
        self.turns = handle.getListState("turns", "text string")
        # calls given out, the time of the last, and the one timer that is set (0: none)
        self.seen = handle.getValueState("seen", "total bigint, last bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        earliest = None
        for part in rows:
            part = part[part["ts"].notna()]
            ms = part["ts"].astype("datetime64[us]").astype("int64") // 1000
            new = list(zip(ms.tolist(), part["tool_use_id"].tolist(), part["call_text"].fillna("").tolist()))
            if new:
                self.waiting.appendList(new)
                earliest = min(ms.min(), earliest) if earliest is not None else ms.min()
        if earliest is not None:
            total, last, timer = self._seen()
            if not timer or earliest < timer:
                self._set_timer(total, last, timer, int(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        total, last, timer = self._seen()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in held if r[0] <= now)
        held = [r for r in held if r[0] > now]
        turns = [r[0] for r in self.turns.get()] if self.turns.exists() else []
        out = []
        for ms, call, text in ready:
            if total and ms - last > self.idle_ms:
                turns, total = [], 0
            turns = fitting(turns, self.budget, self.turn_cost)
            out.append((key[0], call, pd.Timestamp(ms, unit="ms"), list(turns), total))
            turns, total, last = [*turns, text], total + 1, ms
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)
        if not held and now > last + self.idle_ms:
            for state in (self.waiting, self.turns, self.seen):
                state.clear()
            return
        self.turns.put([(t,) for t in fitting(turns, self.budget, self.turn_cost)])
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        self._set_timer(total, last, 0, min((r[0] for r in held), default=last + self.idle_ms + 1))

    def close(self) -> None:
        pass

    def _seen(self) -> tuple[int, int, int]:
        return tuple(self.seen.get()) if self.seen.exists() else (0, 0, 0)

    def _set_timer(self, total: int, last: int, old: int, timer: int) -> None:
        if old:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timer)
        self.seen.update((total, last, timer))


def stream_session_context(calls: DataFrame, delay: str = "1 hour", budget: int = 12000, turn_cost: int = 8, idle_ms: int = 86_400_000) -> DataFrame:
    """Per call, in event order, the newest earlier calls of its session that fit the budget.

    ``calls``: ``session_id, tool_use_id, ts, call_text``. Needs the RocksDB state store (``use_state_store``).
    """
    held = calls.select("session_id", "tool_use_id", "ts", "call_text").withWatermark("ts", delay)
    return held.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionContext(budget, turn_cost, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def use_state_store(spark) -> None:  # noqa: ANN001
    """The session's streams keep their state in RocksDB, which state with timers asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
