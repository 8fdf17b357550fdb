"""State of one sensor's missing periods: what it owes next, and the period that is open."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

EVENTS = "machine string, sensor string, gap_start timestamp, gap_end timestamp, n_buckets long, event string"


class GapProcessor(StatefulProcessor):
    """Timers and state of `gap_events`; a bucket is known by its start in seconds."""

    def __init__(self, step_s: int, least: int):
        self.step, self.least = step_s, least

    def init(self, handle) -> None:
        self.handle = handle
        #: The bucket owed next, the first one of the open period, and how many it has: 0 without one.
        self.state = handle.getValueState("gap", "owed long, gap long, many long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # One row here; the call may hand over a row or the rows of the key.
        rows = [initialState] if isinstance(initialState, Row) else list(initialState)
        self._owe(min(-(-r.since_s // self.step) * self.step for r in rows), 0, 0, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        owed, gap, many = self.state.get() if self.state.exists() else (None, 0, 0)
        before = owed
        for start, n in sorted((int(r.bucket_start.timestamp()), r.n) for r in rows):
            if owed is None:
                owed = start
            if start < owed:
                continue  # before the sensor was expected
            gap, many, opened = self._silent(owed, start, gap, many)
            if n < self.least:
                opened = opened or not many
                gap, many = (gap if many else start), many + 1
            if opened:
                yield self._row(key, gap, many, "open")
            if n >= self.least and many:
                yield self._row(key, gap, many, "closed")
                gap = many = 0
            owed = start + self.step
        if owed is not None and owed != before:
            self._owe(owed, gap, many, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        owed, gap, many = self.state.get()
        upto = timerValues.getCurrentWatermarkInMs() // 1000 // self.step * self.step
        gap, many, opened = self._silent(owed, upto, gap, many)
        if opened:
            yield self._row(key, gap, many, "open")
        self._owe(max(owed, upto), gap, many, None)

    def close(self) -> None:
        pass

    def _silent(self, owed: int, upto: int, gap: int, many: int) -> tuple[int, int, bool]:
        """(first of the open period, its buckets, whether it opened now) after silence from *owed* up to *upto*."""
        missed = max(0, (upto - owed) // self.step)
        return (gap if many else owed, many + missed, not many) if missed else (gap, many, False)

    def _owe(self, owed: int, gap: int, many: int, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer((before + self.step) * 1000)
        self.handle.registerTimer((owed + self.step) * 1000)
        self.state.update((owed, gap, many))

    def _row(self, key, gap: int, many: int, event: str) -> Row:
        first, last = (datetime.fromtimestamp(s, timezone.utc) for s in (gap, gap + (many - 1) * self.step))
        return Row(machine=key[0], sensor=key[1], gap_start=first, gap_end=last, n_buckets=many, event=event)
