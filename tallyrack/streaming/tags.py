"""The states of printed tags as a stream: ``transformWithState``, with a timer a tag.

A tag's state is one row: since when it waits, when it was last printed, its last answer, and when
something is due next.  It lives as long as something can still come of it: a tag that nobody
answered and no shelf printed for ``KEEP_DAYS`` is forgotten by its timer.  What is emitted does not
depend on how days are dealt over micro-batches: before a row is taken in, what fell due before
its day is settled.  Rows older than a tag's last row are late and dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tags import EVENTS, KEEP_DAYS, RECHECK_DAYS

STATE = "since date, printed date, waited boolean, answered boolean, found boolean, checked date, last date"
COLUMNS = ["since", "printed", "waited", "answered", "found", "checked", "last"]
EMPTY = (None, None, False, False, None, None, None)


def _ms(day: dt.date) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp() * 1000)


class TagStates(StatefulProcessor):
    """Emits (tag, day, event, since): waits, answered, due, forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tag", STATE)

    def _held(self) -> dict:
        return dict(zip(COLUMNS, self.state.get() if self.state.exists() else EMPTY, strict=True))

    @staticmethod
    def _next(s: dict) -> dt.date | None:
        """When something falls due: a package that was not found, or a tag to forget."""
        if s["checked"] and s["found"] is False:
            return s["checked"] + dt.timedelta(days=RECHECK_DAYS)
        if s["last"] and s["found"] is None:
            return s["last"] + dt.timedelta(days=KEEP_DAYS)
        return None

    def _settle(self, tag: str, s: dict, day: dt.date, out: list) -> dict:
        """What falls due up to ``day``."""
        due = self._next(s)
        if due is None or due > day:
            return s
        if s["found"] is False:
            out.append((tag, due, "due", None))
            return s | {"checked": None}  # once is enough; the answer stays
        out.append((tag, due, "forgotten", None))
        return dict(zip(COLUMNS, EMPTY, strict=True))

    def _take(self, tag: str, s: dict, row, out: list) -> dict:
        s = self._settle(tag, s, row.day, out)
        if row.kind == "shelf":
            waits = s["found"] is None
            goes_on = waits and s["waited"] and s["printed"] is not None and s["printed"] == row.before
            if waits and not goes_on:
                out.append((tag, row.day, "waits", row.day))
            return s | {"since": (s["since"] if goes_on else row.day) if waits else None, "printed": row.day, "waited": waits, "last": row.day}
        if row.found is not None:
            out.append((tag, row.day, "answered", None))
        return s | {"answered": True, "found": row.found, "checked": row.day, "last": row.day}

    def _keep(self, s: dict) -> None:
        """Write the state, with one timer for what is due next."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s["last"] is None:
            self.state.clear()
            return
        self.state.update(tuple(s[c] for c in COLUMNS))
        due = self._next(s)
        if due is not None:
            self.handle.registerTimer(_ms(due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._held(), []
        table = pd.concat(list(rows))
        table = table.astype(object).where(table.notna(), None)
        for row in sorted(table.itertuples(index=False), key=lambda r: (r.day, r.kind == "answer")):
            if s["last"] is None or row.day >= s["last"]:
                s = self._take(key[0], s, row, out)
        self._keep(s)
        yield pd.DataFrame(out, columns=["tag", "day", "event", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        day = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).date()
        s = self._settle(key[0], self._held(), day, out)
        self._keep(s)
        yield pd.DataFrame(out, columns=["tag", "day", "event", "since"])

    def close(self) -> None:
        pass


def tag_events(stream: DataFrame) -> DataFrame:
    """The events of a stream of rows as ``operators.tags`` takes them.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``)."""
    timed = stream.withColumn("at", F.to_timestamp("day")).withWatermark("at", "0 seconds")
    return timed.groupBy("tag").transformWithStateInPandas(statefulProcessor=TagStates(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
