"""Lane leases as a stream with state: claims and heartbeats hold a lane, timers end what isn't renewed and what waits after failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "ts long, id long, kind string, good_ts long, good_id long, fail_ts array<long>, fail_id array<long>"
OUT = "lane string, at long, state string, failures int"


class Leases(StatefulProcessor):
    """Events of a lane (micros, id, kind: claim, beat, done or fail) to changes of its state: claimed, expired, backoff or idle.

    What is kept is the newest event, the newest that didn't fail, and the failures since, so events of a lane may come in any order within what the watermark
    allows. One timer a lane stands at the end of its lease (expired) or of its wait (idle).
    """

    def __init__(self, lease: int, base: int, most: int):
        self.lease, self.base, self.most = lease, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lane = handle.getValueState("lane", STATE)

    def deadline(self, ts: int, kind: str, failures: int) -> int | None:
        """Milliseconds at which the state changes by itself."""
        if kind == "done":
            return None
        wait = self.lease if kind in ("claim", "beat") else min(self.most, self.base * 2 ** min(max(failures - 1, 0), 20))
        return -(-ts // 1000) + 1000 * wait

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, id, kind, good_ts, good_id, fail_ts, fail_id = self.lane.get() if self.lane.exists() else (-1, -1, "done", -1, -1, [], [])
        fails = list(zip(fail_ts or [], fail_id or []))
        for frame in rows:
            for at, number, what in zip(frame["micros"].tolist(), frame["id"].tolist(), frame["kind"].tolist()):
                if what == "fail":
                    fails.append((at, number))
                else:
                    good_ts, good_id = max((good_ts, good_id), (at, number))
                if (at, number) >= (ts, id):
                    ts, id, kind = at, number, what
        fails = sorted(f for f in set(fails) if f > (good_ts, good_id))
        self.lane.update((ts, id, kind, good_ts, good_id, [f[0] for f in fails], [f[1] for f in fails]))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        state = {"claim": "claimed", "beat": "claimed", "fail": "backoff", "done": "idle"}[kind]
        out = [(key[0], ts // 1000, state, len(fails))]
        end = self.deadline(ts, kind, len(fails))
        if end is not None and end <= timerValues.getCurrentWatermarkInMs():
            out.append(self.ended(key, end, kind, len(fails)))
        elif end is not None:
            self.handle.registerTimer(end)
        yield pd.DataFrame(out, columns=["lane", "at", "state", "failures"])

    def ended(self, key: tuple, at: int, kind: str, failures: int) -> tuple:
        return (key[0], at, "idle" if kind == "fail" else "expired", failures)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, _, kind, _, _, fail_ts, _ = self.lane.get()
        yield pd.DataFrame([self.ended(key, expiredTimerInfo.getExpiryTimeInMs(), kind, len(fail_ts or []))], columns=["lane", "at", "state", "failures"])

    def close(self) -> None:
        pass


def lease_changes(events: DataFrame, lane: str, ts: str, id: str, kind: str, lease: int, base: int, most: int, late: str = "1 hour") -> DataFrame:
    """A stream of lane, at (milliseconds), state and failures from a stream of events; times are in seconds. Events later than the watermark are left out.

    The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.withWatermark(ts, late).selectExpr(f"CAST({lane} AS STRING) AS lane", f"{ts} AS ts", f"unix_micros({ts}) AS micros", f"CAST({id} AS LONG) AS id", f"{kind} AS kind")
    return rows.groupBy("lane").transformWithStateInPandas(Leases(lease, base, most), OUT, "Append", "EventTime")
