"""Live chat sessions: the state of each session kept by a streaming query, and left when nothing came for a while."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import STATE, opening, step

#: What a session's state is kept as, and the seconds after which a session without a line is forgotten.
_KEPT = "state string"
IDLE_SECONDS = 3600


class Sessions(StatefulProcessor):
    """Applies each session's lines in order of seq to its kept state; each line is answered with the state after it."""

    def __init__(self, start: dict[str, Any] | None, idle_seconds: int):
        self.start, self.idle = opening(start), idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        then, state = json.loads(self.state.get()[0]) if self.state.exists() else (now, None)
        if state is None or now - then > 1000 * self.idle:  # its timer may not have been seen to yet
            state = dict(self.start)
        lines = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, line in zip(lines["seq"], lines["line"], strict=True):
            said = step(state, line if isinstance(line, str) else "")
            out.append((key[0], seq, said, *(state[k] for k in self.start)))
        self.state.update((json.dumps([now, state]),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + 1000 * self.idle)
        yield pd.DataFrame(out, columns=["session", "seq", "answer", *self.start])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def live(events: DataFrame, start: dict[str, Any] | None = None, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """A stream of events (session, seq, line) with what each is answered and the state after it.

    Within a batch lines are taken in order of seq, and batches as they come; a session that is idle for longer than ``idle_seconds`` leaves the state, and
    begins anew with its next line. Needs the settings of STORE. A run of all that is available ends only without batches of no data, which else look after timers.
    """
    rows = events.select("session", "seq", "line").groupBy("session")
    return rows.transformWithStateInPandas(Sessions(start, idle_seconds), STATE, outputMode="Update", timeMode="ProcessingTime")


#: The state store that live sessions need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
