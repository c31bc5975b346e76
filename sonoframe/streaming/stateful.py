"""Operators on streams whose state lives over micro-batches: rows are put into time order behind the watermark and folded into a key's state.

Rows of a key wait in a list until the watermark has passed them; an event-time timer then releases them in time order, so what comes out does not
depend on how the stream is cut into batches, or on the order of rows within the allowed lateness. Rows later than that are left out, as
Spark does with late rows. A key's state is the waiting rows and what its fold keeps: the last value, a window, an open event, a cursor. It lives in the RocksDB
state store below the query's checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sonoframe.functions import kernels
from sonoframe.session import ship

# Spark runs a stateful operator's init in a Python process of the driver that does not get shipped code: these two modules travel with it
for _module in (sys.modules[__name__], kernels):
    cloudpickle.register_pickle_by_value(_module)

#: (what is kept or None, released rows in order, watermark in micros) -> (what to keep or None, columns of the output, when to wake, in micros, or None)
Fold = Callable[[tuple | None, list[tuple], int], tuple[tuple | None, dict[str, list], int | None]]


class InOrder(StatefulProcessor):
    """Holds a key's rows (first field: time in micros) back until the watermark and folds them in order."""

    def __init__(self, fold: Fold, row: str, kept: str):
        self.fold, self.row, self.kept = fold, row, kept
        self.fields = [f.split(" ", 1)[0] for f in row.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.folded: set[tuple] = set()  # (watermark, key) of this task: one entry for each key that had a timer
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("kept", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own = [tuple(r[n] for n in self.fields) for r in rows]
        if own:
            self.waiting.appendList(own)
            self.handle.registerTimer(min(r[0] for r in own) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        if (mark, key[0]) in self.folded:  # another timer of the key at the same watermark: all that it waits for has been folded
            return iter(())
        self.folded.add((mark, key[0]))
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((v is None, v) for v in r))
        ready = [r for r in rows if r[0] // 1000 <= mark]
        before = self.state.get()
        before = None if before is None else tuple(before)
        after, out, wake = self.fold(before, ready, mark * 1000)
        if after is not None:
            self.state.update(after)
        elif before is not None:
            self.state.clear()
        if ready:
            rest = rows[len(ready) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000)
            else:
                self.waiting.clear()
        if wake is not None:
            self.handle.registerTimer(wake // 1000)
        made = Row("key", *out)
        return (made(key[0], *values) for values in zip(*out.values(), strict=True))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, time: str, late: str, fields: dict[str, str], fold: Fold, kept: str, out: str) -> DataFrame:
    """The stream `rows` with fields (output name: expression) folded by key; key is a column of the output."""
    ship(rows.sparkSession)
    stamped = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    own = stamped.select(F.col(key).alias("key"), F.unix_micros("_time").alias("at"), *[F.expr(e).alias(n) for n, e in fields.items()], "_time")
    row = ", ".join(["at long", *(f"{n} {own.schema[n].dataType.simpleString()}" for n in fields)])
    kind = own.schema["key"].dataType.simpleString()
    return own.groupBy("key").transformWithState(InOrder(fold, row, kept), f"key {kind}, {out}", "Append", "eventTime")


def thin(events: DataFrame, key: str, time: str, separation: float, late: str) -> DataFrame:
    """(key, at) of the events that begin at least `separation` seconds after the last that stayed."""

    def fold(kept, rows, mark):
        last, out = kept[0] if kept else None, []
        for (at,) in rows:
            if last is None or at - last >= separation * 1e6:
                last = at
                out.append(at / 1e6)
        return (None if last is None else (last,)), {"at": out}, None

    return _run(events, key, time, late, {}, fold, "last long", "at double")


def running_baseline(values: DataFrame, key: str, time: str, value: str, seconds: float, late: str) -> DataFrame:
    """(key, at, value, median, mad) over the values of the last `seconds`, its own included: the state is the window."""

    def fold(kept, rows, mark):
        at, held = (list(kept[0]), list(kept[1])) if kept else ([], [])
        window, out = kernels.SortedWindow(1 << 62, held), {"at": [], "value": [], "median": [], "mad": []}
        for t, v in rows:
            at.append(t)
            window.push(v)
            while t - at[0] >= seconds * 1e6:
                at.pop(0)
                window.drop()
            middle = window.median()
            for name, x in zip(out, (t / 1e6, v, middle, window.deviation(middle)), strict=True):
                out[name].append(x)
        return ((at, list(window.ring)) if at else None), out, None

    return _run(values, key, time, late, {"value": f"cast({value} as double)"}, fold, "at array<long>, value array<double>", "at double, value double, median double, mad double")


def flux(frames: DataFrame, key: str, time: str, order: str, mag: str, late: str) -> DataFrame:
    """(key, frame, flux) of magnitude frames: the state of a recording is its last frame."""

    def fold(kept, rows, mark):
        last, out = np.array(kept[0]) if kept else None, {"frame": [], "flux": []}
        for _, frame, own in rows:
            own = np.array(own, float)
            rise = np.maximum(own - (own if last is None else last), 0)
            out["frame"].append(frame)
            out["flux"].append(float(np.sqrt((rise * rise).sum())))
            last = own
        return (None if last is None else (last.tolist(),)), out, None

    return _run(frames, key, time, late, {"frame": f"cast({order} as long)", "mag": f"cast({mag} as array<double>)"}, fold, "last array<double>", "frame long, flux double")


def merged_events(crossings: DataFrame, key: str, time: str, value: str, gap: float, late: str) -> DataFrame:
    """(key, onset, last, peak, mean, n) of runs of crossings at most `gap` seconds apart, when nothing can join them any more.

    The mean folds as that of the batch does: ((m1 + m2) / 2 + m3) / 2 ...
    """

    def fold(kept, rows, mark):
        out = {n: [] for n in ("onset", "last", "peak", "mean", "n")}

        def close():
            for name, x in zip(out, (kept[0] / 1e6, kept[1] / 1e6, *kept[2:]), strict=True):
                out[name].append(x)

        for at, v in rows:
            if kept and at - kept[1] <= gap * 1e6:
                kept = (kept[0], at, max(kept[2], v), (kept[3] + v) / 2, kept[4] + 1)
            else:
                if kept:
                    close()
                kept = (at, at, v, v, 1)
        if kept and kept[1] + gap * 1e6 < mark:
            close()
            kept = None
        return kept, out, (int(kept[1] + gap * 1e6) + 1000 if kept else None)

    return _run(crossings, key, time, late, {"value": f"cast({value} as double)"}, fold, "onset long, last long, peak double, mean double, n long", "onset double, last double, peak double, mean double, n long")


def replies(requests: DataFrame, client: str, time: str, verb: str, arg: str, calendar: DataFrame, late: str, namespace: str = "/phenology") -> DataFrame:
    """(client, at, verb, frame) for each request that gets a reply, of a stream of requests for days of a calendar (columns day and _i, its number).

    A client has a cursor, 0 at first: next and prev go around the calendar, day goes to the day of that number (the nearest there is), date to the day of that
    date; meta and events reply without moving it (frame is null). A number or date that cannot be read, an unknown date and an
    unknown verb get no reply. Dates are looked up by joining the stream with the calendar, the cursor is state.
    """
    n = calendar.count()
    prefix = f"{namespace.rstrip('/')}/query/"
    days = calendar.select(F.col("day").cast("string").alias("_day"), F.col("_i").cast("long").alias("_index"))
    asked = requests.withColumns({"_verb": F.regexp_replace(F.col(verb), f"^{prefix}", ""), "_arg": F.col(arg).cast("string")})
    dated = asked.join(F.broadcast(days) if n < 100_000 else days, F.when(F.col("_verb") == "date", F.col("_arg")) == F.col("_day"), "left")  # a row a day
    wanted = dated.withColumn("_to", F.when(F.col("_verb") == "date", F.col("_index")).when(F.col("_verb") == "day", F.expr("try_cast(_arg AS BIGINT)")))

    def fold(kept, rows, mark):
        cursor, out = kept[0] if kept else 0, {"at": [], "verb": [], "frame": []}
        for at, what, to in rows:
            frame = None
            if what in ("day", "date", "next", "prev"):
                if not n or (what in ("day", "date") and to is None):
                    continue
                cursor = frame = (cursor + 1) % n if what == "next" else (cursor - 1) % n if what == "prev" else max(0, min(int(to), n - 1))
            elif what not in ("meta", "events"):
                continue
            for name, x in zip(out, (at / 1e6, what, frame), strict=True):
                out[name].append(x)
        return (cursor,), out, None

    return _run(wanted, client, time, late, {"verb": "_verb", "to": "_to"}, fold, "cursor long", "at double, verb string, frame long").withColumnRenamed("key", "client")
