"""Processors of the keyed streams: state per link or client in RocksDB, timers in event time.

Event times are a millisecond after the rows' own, because a row at the watermark counts as late, and the first watermark is the epoch.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import DEAD_CODES


def with_state(df: DataFrame) -> DataFrame:
    """``df`` for a stream whose processors keep state and timers: only the RocksDB store has them."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


class Limit(StatefulProcessor):
    """A client's accepted hits of the last ``window`` seconds, and a timer that clears them once they are out of every window to come."""

    def __init__(self, max_hits: int, window: float):
        self.max_hits, self.window = max_hits, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getValueState("recent", "at array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.recent.exists()
        recent = list(self.recent.get()[0]) if known else []
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            ok = accept(r.at, recent, self.max_hits, self.window)
            yield Row(client=key[0], seq=r.seq, at=r.at, accepted=ok)
        if recent:
            self.recent.update((recent,))
            if not known:
                self.handle.registerTimer(self.ends(recent))
        elif known:
            self.recent.clear()  # its timer finds nothing

    def ends(self, recent: list[float]) -> int:
        return int((recent[-1] + self.window) * 1000) + 2

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.recent.exists():
            end = self.ends(list(self.recent.get()[0]))
            if end <= expiredTimerInfo.getExpiryTimeInMs():
                self.recent.clear()
            else:
                self.handle.registerTimer(end)
        yield from ()

    def close(self) -> None:
        pass


def accept(t: float, recent: list[float], max_hits: int, window: float) -> bool:
    """Whether a hit at ``t`` keeps the sliding limit: fewer than ``max_hits`` accepted ones in the window before it.

    ``recent``, the sorted times of accepted hits, loses those that are out of the window and gains the hit if it is accepted; rejected hits leave no trace.
    """
    del recent[: bisect_right(recent, t - window)]
    if len(recent) >= max_hits:
        return False
    insort(recent, t)
    return True


STATE = "url string, fails long, first long, due long, told boolean, seq long, code int"
HEALTH_OUT = "kind string, id long, platform string, seq long, url string, status string, checked_at long, consecutive_failures long, first_fail_at long, http_code int"


class Health(StatefulProcessor):
    """The failure state of a link, and a timer at which it will be dead for certain if no probe comes before."""

    def __init__(self, min_fails: int, min_age_s: int):
        self.min_fails, self.min_age_s = min_fails, min_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("link", STATE)

    def row(self, key, kind: str, seq: int, url: str, status: str, at: int, fails: int, first: int | None, code: int | None) -> Row:
        return Row(kind=kind, id=key[0], platform=key[1], seq=seq, url=url, status=status, checked_at=at, consecutive_failures=fails, first_fail_at=first, http_code=code)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        url, fails, first, due, told, seq, code = tuple(self.state.get()) if self.state.exists() else (None, 0, None, None, False, 0, None)
        for r in sorted(rows, key=lambda r: (r.checked_at, r.seq)):
            if due is not None and due < r.checked_at:
                yield self.row(key, "death", seq, url, "dead", due, fails, first, code)
                due, told = None, True
            if r.url != url or r.status == "alive":
                url, fails, first, told = r.url, 0, None, False
            due, seq, code = None, r.seq, r.http_code
            if r.status == "dead":
                fails, first = fails + 1, r.checked_at if first is None else first
            yield self.row(key, "state", seq, url, r.status, r.checked_at, fails, first, code)
            if r.status == "dead" and fails >= self.min_fails and not told:
                due = r.checked_at if code in DEAD_CODES else max(r.checked_at, first + self.min_age_s)
                if due == r.checked_at:
                    yield self.row(key, "death", seq, url, "dead", due, fails, first, code)
                    due, told = None, True
        self.state.update((url, fails, first, due, told, seq, code))
        if due is not None:
            self.handle.registerTimer(due * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        url, fails, first, due, told, seq, code = tuple(self.state.get())
        if due is not None and due * 1000 < expiredTimerInfo.getExpiryTimeInMs():  # else a probe came in between
            self.state.update((url, fails, first, None, True, seq, code))
            yield self.row(key, "death", seq, url, "dead", due, fails, first, code)

    def close(self) -> None:
        pass
