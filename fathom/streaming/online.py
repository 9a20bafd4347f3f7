"""The best window of each dataset, found while its readings arrive.

State of a dataset: readings not yet settled, the last n - 1 settled ones and the best window so far; it does not grow with
the stream but for what the watermark lets come late. A reading settles when the watermark has passed it, so readings
that come late but not too late take their place. A dataset's event closes when close_after has passed, in event time,
since its last reading, or before its next one; then its best window is emitted and the state is dropped. What comes later than the watermark is
dropped by Spark; readings of a closed event's dataset open a new event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session must set for this operator: its state needs a store that holds lists.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: The best window of an event without readings.
_NONE = (None, None, None, None, 0, None)


class BestWindow(StatefulProcessor):
    """Emits dataset, first and last (positions), n_rows (of the event) and score of the n readings in a row whose mean is
    greatest (least if calm), the first of equals as rounded to nine digits."""

    def __init__(self, key: str, n: int, calm: bool, close_after_ms: int, batch: bool):
        self.key, self.n, self.calm, self.close_after, self.batch = key, n, calm, close_after_ms, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, pos long, value double")
        self.tail = handle.getListState("tail", "pos long, value double")
        self.best = handle.getValueState("best", "first long, last long, score double, rounded double, seen long, at long")
        self.last = handle.getValueState("last", "at long")

    def _settle(self, upto: int | None) -> list[tuple]:
        """Moves readings up to a time (all of them if None) from pending through the window; the events that a gap closes."""
        rows = sorted(tuple(r) for r in self.pending.get())
        done = [r for r in rows if upto is None or r[0] <= upto]
        if not done:
            return []
        closed, left = [], rows[len(done) :]
        tail = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        first, last, score, rounded, seen, before = tuple(self.best.get()) if self.best.exists() else _NONE
        for at, pos, value in done:
            if before is not None and at - before > self.close_after:
                closed.append((first, last, seen, score))
                tail, (first, last, score, rounded, seen, before) = [], _NONE
            tail.append((pos, value))
            seen, before = seen + 1, at
            if len(tail) == self.n:
                mean = sum(v for _, v in tail) / self.n
                own = round(-mean if self.calm else mean, 9)
                if rounded is None or own > rounded:
                    first, last, score, rounded = tail[0][0], pos, mean, own
                tail.pop(0)
        self.pending.clear()
        if left:
            self.pending.put(left)
        self.tail.clear()
        if tail:
            self.tail.put(tail)
        self.best.update((first, last, score, rounded, seen, before))
        return closed

    def _frame(self, key, events: list[tuple]) -> pd.DataFrame:
        first, last, seen, score = ([e[k] for e in events] for k in range(4))
        return pd.DataFrame({self.key: [key[0]] * len(events), "first": pd.array(first, "Int64"), "last": pd.array(last, "Int64"), "n_rows": seen, "score": pd.array(score, "Float64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            at = part["at"].astype("int64").tolist()
            self.pending.appendList(list(zip(at, part["pos"].astype("int64").tolist(), part["value"].astype("float64").tolist())))
            newest = max(at + ([newest] if newest is not None else []))
        if self.batch:  # a table comes whole, and no timer would follow
            yield self._frame(key, self._close())
            return
        if newest is not None:
            if self.last.exists():
                self.handle.deleteTimer(self.last.get()[0] + self.close_after)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.close_after)
        closed = self._settle(timerValues.getCurrentWatermarkInMs() or -1)
        yield self._frame(key, closed) if closed else pd.DataFrame()

    def _close(self) -> list[tuple]:
        """The events that are left, whose states are dropped."""
        closed = self._settle(None)
        first, last, score, _, seen, _ = tuple(self.best.get()) if self.best.exists() else _NONE
        for state in (self.pending, self.tail, self.best, self.last):
            state.clear()
        return [*closed, (first, last, seen, score)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(key, self._close())

    def close(self) -> None:
        pass


def best_windows(
    readings: DataFrame, key: str = "dataset_id", time: str = "ts", pos: str = "id", value: str = "anomaly", n: int = 36, calm: bool = False, late: str = "2 hours", close_after_hours: float = 24
) -> DataFrame:
    """A row for each event of a dataset, when it closes: key, first, last, n_rows, score. Windows that never fill give nulls.
    readings may be a stream or a table; a table's events all close at its end."""
    if not readings.isStreaming:
        readings.sparkSession.streams.active  # noqa: B018 - a session has no home for states before its streams are asked for
    kind = readings.schema[key].dataType.simpleString()
    rows = readings.selectExpr(f"{key}", f"cast({time} as timestamp) as seen_at", f"unix_millis(cast({time} as timestamp)) as at", f"cast({pos} as long) as pos", f"cast({value} as double) as value")
    rows = rows.where("at is not null and value is not null").withWatermark("seen_at", late)
    processor = BestWindow(key, n, calm, int(close_after_hours * 3_600_000), not readings.isStreaming)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, first long, last long, n_rows long, score double", "append", "eventtime")
