"""Attempts that stall and files that expire: event-time timers on a stream, and the same rows from a whole table.

A stream says a thing once its watermark has passed it, so nothing that is still to come
can change it, and the rows equal those of the whole table up to the watermark. A key's
state is one attempt, or one job with its open downloads; timers remove it. Rows older than
the watermark are late and count for nothing. Times are held in milliseconds.

The streaming forms need ``spark.sql.streaming.stateStore.providerClass`` set to Spark's
RocksDB provider, as all of Spark's stateful processors do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Seconds without an end after which an attempt is warned about, and after which it has failed.
WARN, CAP = 60, 600
#: Minutes that files stay after a job's end, and those added when a download is under way then.
STAY, MORE = 10, 5
#: Hours after which a download without an end counts as over.
LONGEST = 24


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


class _Timed(StatefulProcessor):
    """A key's state beside timers for the times at which something may fall due."""

    schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def _keep(self, values: tuple, times: set[int]) -> None:
        """The new state; its timers replace the old ones."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update(values)
        for t in times:
            self.handle.registerTimer(t)

    def _forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.clear()

    def close(self) -> None:
        pass


class Attempts(_Timed):
    """begin and end of one attempt, whether it was warned about and whether it is settled."""

    schema = "begin long, end long, warned boolean, settled boolean"

    def __init__(self, warn: int, cap: int):
        self.warn, self.cap = 1000 * warn, 1000 * cap

    def handleInputRows(self, key, rows, timerValues):
        begin, end, warned, settled = self.state.get() if self.state.exists() else (None, None, False, False)
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["ms"] >= passed]
            for kind, ms in zip(pdf["kind"], pdf["ms"].tolist(), strict=True):
                if kind == "begin":
                    begin = ms if begin is None else min(begin, ms)
                elif kind == "end":
                    end = ms if end is None else min(end, ms)
        if begin is None and end is None:
            return
        if settled:
            times = {begin + self.cap + 1}
        elif begin is None:
            times = {end + self.cap + 1}
        else:
            times = {begin + self.warn, begin + self.cap, *([] if end is None else [max(begin, end)])}
        self._keep((begin, end, warned, settled), times)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        begin, end, warned, settled = self.state.get()
        if settled or begin is None:
            if now > (end if begin is None else begin) + self.cap:
                self._forget()
            return
        out = []
        late = end is None or end > begin + self.warn
        if not warned and late and now >= begin + self.warn:
            out.append(("stalled", begin + self.warn))
            warned = True
        ended = end is not None and end - begin < self.cap
        if ended and now >= max(begin, end):
            out.append(("done", max(begin, end)))
            settled = True
        elif not ended and now >= begin + self.cap:
            out.append(("failed", begin + self.cap))
            settled = True
        if settled:
            self._keep((begin, end, warned, settled), {begin + self.cap + 1})
        else:
            self.state.update((begin, end, warned, settled))
        if out:
            yield pd.DataFrame({"id": [key[0]] * len(out), "event": [e for e, _ in out], "ms": [t for _, t in out]})


def attempt_events_stream(attempts: DataFrame, delay: str = "10 minutes", warn: int = WARN, cap: int = CAP) -> DataFrame:
    """``attempt_events`` on a stream (id, kind, ts); rows may come ``delay`` late. An id is used once: it may begin anew ``cap`` seconds after."""
    rows = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("id", "kind", "ts", _millis(F.col("ts")).alias("ms"))
    found = rows.groupBy("id").transformWithStateInPandas(Attempts(warn, cap), "id long, event string, ms long", "append", "eventTime")
    return found.select("id", "event", F.timestamp_millis("ms").alias("at"))


def attempt_events(attempts: DataFrame, until: Column | None = None, warn: int = WARN, cap: int = CAP) -> DataFrame:
    """What becomes of attempts (id, kind begin/end, ts): id, event, at.

    ``stalled`` once, ``warn`` seconds after a begin without an end by then; ``done`` at an
    end within ``cap`` seconds; else ``failed`` at the cap. Of several begins or ends the
    first counts; an end before the begin ends it at once; ends alone give nothing. Only
    events up to ``until`` are there.
    """
    ms = _millis(F.col("ts"))
    first = {k: F.min(F.when(F.col("kind") == k, ms)).alias(k) for k in ("begin", "end")}
    spans = attempts.groupBy("id").agg(*first.values()).where("begin IS NOT NULL")
    begin, end = F.col("begin"), F.col("end")
    ended = F.coalesce(end - begin < 1000 * cap, F.lit(False))
    event = lambda name, at: F.struct(F.lit(name).alias("event"), at.alias("ms"))
    stalled = F.when(F.coalesce(end > begin + 1000 * warn, F.lit(True)), event("stalled", begin + 1000 * warn))
    last = F.when(ended, event("done", F.greatest(begin, end))).otherwise(event("failed", begin + 1000 * cap))
    rows = spans.select("id", F.explode(F.array_compact(F.array(stalled, last))).alias("e"))
    if until is not None:
        rows = rows.where(F.col("e.ms") <= _millis(until))
    return rows.select("id", "e.event", F.timestamp_millis("e.ms").alias("at"))


class Retention(_Timed):
    """End of one job, its downloads that may still run, and whether its expiry was put off."""

    schema = "done long, downloads array<long>, begins array<long>, finishes array<long>, put_off boolean"

    def __init__(self, stay: int, more: int, longest: int):
        self.stay, self.more, self.longest = 60_000 * stay, 60_000 * more, 3_600_000 * longest

    def _held(self):
        done, ids, begins, finishes, put_off = self.state.get() if self.state.exists() else (None, [], [], [], False)
        return done, {d: [b, f] for d, b, f in zip(ids, begins, finishes, strict=True)}, put_off

    def _hold(self, done, downloads, put_off, times) -> None:
        columns = [list(c) for c in zip(*[(d, b, f) for d, (b, f) in downloads.items()], strict=True)] or [[], [], []]
        self._keep((done, *columns, put_off), times)

    def handleInputRows(self, key, rows, timerValues):
        done, downloads, put_off = self._held()
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["ms"] >= passed]
            for kind, download, ms in zip(pdf["kind"], pdf["download"].tolist(), pdf["ms"].tolist(), strict=True):
                if kind == "done":
                    done = ms if done is None else min(done, ms)
                elif kind in ("begin", "finish"):
                    span = downloads.setdefault(int(download), [-1, -1])
                    at = int(kind == "finish")
                    span[at] = ms if span[at] < 0 else min(span[at], ms)
        # a download that is over matters no more while the job's expiry is still to come
        open_ = {d: s for d, s in downloads.items() if (s[1] if s[1] >= 0 else s[0] + self.longest) > passed}
        if done is None and not open_:
            self._forget()
            return
        if done is None:
            times = {max(s) + self.longest for s in open_.values()}
        else:
            times = {done + self.stay + (self.more if put_off else 0)}
        self._hold(done, open_, put_off, times)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        done, downloads, put_off = self._held()
        if done is None:
            open_ = {d: s for d, s in downloads.items() if max(s) + self.longest > now}
            if open_:
                self._hold(done, open_, put_off, {max(s) + self.longest for s in open_.values()})
            else:
                self._forget()
            return
        expiry = done + self.stay
        running = (b <= expiry < (f if f >= 0 else b + self.longest) for b, f in downloads.values() if b >= 0)
        if not put_off and any(running):
            put_off = True
            if timerValues.getCurrentWatermarkInMs() < expiry + self.more:
                self._hold(done, downloads, True, {expiry + self.more})
                return
        self._forget()
        yield pd.DataFrame({"job": [key[0]], "ms": [expiry + (self.more if put_off else 0)]})


def expiries_stream(events: DataFrame, delay: str = "10 minutes", stay: int = STAY, more: int = MORE, longest: int = LONGEST) -> DataFrame:
    """``expiries`` on a stream (job, kind, download, ts); rows may come ``delay`` late."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("job", "kind", F.coalesce("download", F.lit(0)).cast("long").alias("download"), "ts", _millis(F.col("ts")).alias("ms"))
    found = rows.groupBy("job").transformWithStateInPandas(Retention(stay, more, longest), "job long, ms long", "append", "eventTime")
    return found.select("job", F.timestamp_millis("ms").alias("expiry"))


def expiries(events: DataFrame, until: Column | None = None, stay: int = STAY, more: int = MORE, longest: int = LONGEST) -> DataFrame:
    """When each job's files expire (job, expiry): ``stay`` minutes after its end, ``more`` later if a download runs at that moment.

    ``events``: job, kind (done, or begin/finish of a ``download``), ts. A download without a
    finish is over after ``longest`` hours, one without a begin never ran. Jobs without an end
    do not expire. Only expiries up to ``until`` are there.
    """
    ms = _millis(F.col("ts"))
    first = {k: F.min(F.when(F.col("kind") == k, ms)).alias(k) for k in ("done", "begin", "finish")}
    done = events.groupBy("job").agg(first["done"]).where("done IS NOT NULL")
    spans = events.where("kind <> 'done'").groupBy("job", F.coalesce("download", F.lit(0)).alias("download")).agg(first["begin"], first["finish"])
    expiry = F.col("done") + 60_000 * stay
    running = (F.col("begin") <= expiry) & (F.coalesce("finish", F.col("begin") + 3_600_000 * longest) > expiry)
    busy = spans.join(done, "job").groupBy("job").agg(F.max(F.coalesce(running, F.lit(False))).alias("busy"))
    rows = done.join(busy, "job", "left").select("job", (expiry + F.when(F.col("busy"), 60_000 * more).otherwise(0)).alias("ms"))
    if until is not None:
        rows = rows.where(F.col("ms") <= _millis(until))
    return rows.select("job", F.timestamp_millis("ms").alias("expiry"))
