"""Per-key state over time-stamped events: a batch form of each operator, and streaming forms on Structured Streaming.

The streaming forms keep bounded state: a watermark closes windows, and the rate limiter
keeps the accepted times of one window for each key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp of either kind; only differences of them are used."""
    return F.unix_micros(ts.cast("timestamp"))


def request_key(session: Column, forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """Bucket of a request: its session, else the first forwarded address, else the real one, else the peer."""

    def named(kind: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(kind), value))

    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(named("session:", session), named("ip:", first), named("ip:", real_ip), named("ip:", peer), F.lit("ip:unknown"))


def limited(path: Column) -> Column:
    """Whether a path counts at all: the API without health checks and previews."""
    return path.startswith("/api/") & (path != "/api/health") & ~(path.startswith("/api/job/") & path.contains("/preview/"))


def _admit(times: list[float], accepted: list[float], most: int, seconds: float) -> tuple[list[bool], list[int], list[float]]:
    """Sliding log: a request passes when fewer than ``most`` accepted ones lie within the window before it."""
    passed, left, start = [], [], 0
    for t in times:
        while start < len(accepted) and accepted[start] <= t - seconds:
            start += 1
        ok = len(accepted) - start < most
        if ok:
            accepted.append(t)
        passed.append(ok)
        left.append(most - (len(accepted) - start))
    return passed, left, accepted[start:]


def rate_limit(events: DataFrame, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """Events (id, key, ts) with ``accepted`` and ``remaining``. A key's decisions depend on its earlier ones, so a key is one group, in time order."""

    def one_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"])
        passed, left, _ = _admit((pdf["ts"].astype("int64") / 1e6).tolist(), [], most, seconds)
        return pdf.assign(accepted=passed, remaining=left)[["id", "key", "accepted", "remaining"]]

    timed = events.select("id", "key", micros(F.col("ts")).alias("ts"))
    return timed.groupBy("key").applyInPandas(one_key, "id long, key long, accepted boolean, remaining int")


def rate_limit_stream(events: DataFrame, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """The same on a stream: each key's state is the accepted times of its last window."""

    def one_key(key, batches, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        passed, left, held = _admit((pdf["ts"].astype("int64") / 1e6).tolist(), held, most, seconds)
        state.update((held,))
        yield pdf.assign(key=key[0], accepted=passed, remaining=left)[["id", "key", "accepted", "remaining"]]

    timed = events.select("id", "key", micros(F.col("ts")).alias("ts"))
    return timed.groupBy("key").applyInPandasWithState(
        one_key, "id long, key long, accepted boolean, remaining int", "times array<double>", "append", GroupStateTimeout.NoTimeout
    )


def api_calls(calls: DataFrame) -> DataFrame:
    """Calls that count (id, key, ts, strict): exempt paths go; ``strict`` marks what the second limit is for.

    ``calls``: id, ts, path, method, session, forwarded, real_ip, peer.
    """
    key = request_key(F.col("session"), F.col("forwarded"), F.col("real_ip"), F.col("peer"))
    strict = (F.col("path") == "/api/generate") & (F.col("method") == "POST")
    return calls.where(limited(F.col("path"))).select("id", key.alias("key"), "ts", F.coalesce(strict, F.lit(False)).alias("strict"))


class SlidingLogs:
    """Two sliding logs of one key: calls are judged in the order of time."""

    def __init__(self, most: tuple[int, float], strict: tuple[int, float], times=(), strict_times=()):
        self.limits, self.logs = (most, strict), (list(times), list(strict_times))

    def judge(self, t: float, strict: bool) -> tuple[bool, str | None, int]:
        """Whether a call passes, which limit stops it, and how many the first limit leaves. Rejected calls count for nothing."""
        for (_, seconds), log in zip(self.limits, self.logs, strict=True):
            while log and log[0] <= t - seconds:
                log.pop(0)
        (most, _), (strict_most, _) = self.limits
        if len(self.logs[0]) >= most:
            return False, "general", 0
        if strict:
            if len(self.logs[1]) >= strict_most:
                return False, "strict", 0
            self.logs[1].append(t)
        self.logs[0].append(t)
        return True, None, most - len(self.logs[0])


_JUDGED = "id long, key string, accepted boolean, reason string, remaining int"


def rate_limits(calls: DataFrame, most: tuple[int, float] = (60, 60.0), strict: tuple[int, float] = (10, 3600.0)) -> DataFrame:
    """Calls (id, key, ts, strict) with ``accepted``, ``reason`` and ``remaining``; both limits are (number, seconds).

    A pause longer than both windows forgets all, so a key's history falls into stretches
    that are judged apart. Stretches are dealt over tasks and streamed in the order of time: a
    task holds the logs of one stretch, however long a key's history is.
    """
    order = Window.partitionBy("key").orderBy("ts", "id")
    timed = calls.select("id", F.col("key").cast("string").alias("key"), micros(F.col("ts")).alias("ts"), "strict")
    pause = F.col("ts") - F.lag("ts").over(order) >= max(most[1], strict[1]) * 1e6
    parted = timed.withColumn("_part", F.sum(F.coalesce(pause, F.lit(True)).cast("int")).over(order))

    def work(frames):
        now, logs = None, None
        for pdf in frames:
            out = []
            for i, key, t, part, hard in zip(pdf["id"], pdf["key"], pdf["ts"], pdf["_part"], pdf["strict"], strict=True):
                if (key, part) != now:
                    now, logs = (key, part), SlidingLogs(most, strict)
                out.append((i, key, *logs.judge(t / 1e6, bool(hard))))
            yield pd.DataFrame(out, columns=["id", "key", "accepted", "reason", "remaining"])

    return parted.repartition("key", "_part").sortWithinPartitions("key", "_part", "ts", "id").mapInPandas(work, _JUDGED)


def rate_limits_stream(calls: DataFrame, most: tuple[int, float] = (60, 60.0), strict: tuple[int, float] = (10, 3600.0)) -> DataFrame:
    """The same on a stream: a key's state is its two logs, no longer than the limits."""

    def one_key(key, batches, state: GroupState):
        logs = SlidingLogs(most, strict, *(state.get if state.exists else ()))
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        judged = [(i, key[0], *logs.judge(t / 1e6, bool(hard))) for i, t, hard in zip(pdf["id"], pdf["ts"], pdf["strict"], strict=True)]
        state.update(logs.logs)
        yield pd.DataFrame(judged, columns=["id", "key", "accepted", "reason", "remaining"])

    timed = calls.select("id", F.col("key").cast("string").alias("key"), micros(F.col("ts")).alias("ts"), "strict")
    return timed.groupBy("key").applyInPandasWithState(one_key, _JUDGED, "times array<double>, strict_times array<double>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, hours: int = 24) -> DataFrame:
    """Sessions of each key: a gap of strictly more than ``hours`` starts a new one."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(order)) > hours * 3_600_000_000
    numbered = events.withColumn("session", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    return numbered.groupBy("key", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def sessions_stream(events: DataFrame, hours: int = 24) -> DataFrame:
    """Sessions on a stream, closed by the watermark."""
    late = events.withWatermark("ts", f"{hours} hours")
    return late.groupBy("key", F.session_window("ts", f"{hours} hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def last_logs(events: DataFrame, most: int = 5000) -> DataFrame:
    """The newest ``most`` events of each key."""
    newest = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    return events.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most).drop("_k")


def logs_since(events: DataFrame, cursor: int) -> DataFrame:
    """Events of each key after the first ``cursor``, with their number and the total."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    rows = events.withColumn("n", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("key")))
    return rows.where(F.col("n") > cursor)


def stalled(attempts: DataFrame, seconds: int = 60) -> DataFrame:
    """Attempts (key, id, kind begin/end, ts) that begin and have no end within ``seconds``: one warning each."""
    spans = attempts.groupBy("id").agg(F.min(F.when(F.col("kind") == "begin", F.col("ts"))).alias("begin"), F.min(F.when(F.col("kind") == "end", F.col("ts"))).alias("end"))
    late = F.col("end").isNull() | (micros(F.col("end")) - micros(F.col("begin")) > seconds * 1_000_000)
    return spans.where(F.col("begin").isNotNull() & late)


def attempt_counts(attempts: DataFrame, now: DataFrame, warn: int = 60, cap: int = 600) -> DataFrame:
    """Attempts of each key at the time ``now`` (one row): done, in flight, failed (no end within ``cap`` seconds) and warned (over ``warn`` seconds)."""
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    spans = attempts.groupBy("id").agg(F.min("key").alias("key"), of("begin").alias("begin"), of("end").alias("end")).where("begin IS NOT NULL")
    rows = spans.crossJoin(F.broadcast(now))  # one row
    took = micros(F.coalesce("end", "now")) - micros(F.col("begin"))
    open_ = F.col("end").isNull()
    return rows.groupBy("key").agg(
        F.count_if(~open_).alias("done"), F.count_if(open_ & (took < cap * 1_000_000)).alias("in_flight"),
        F.count_if(open_ & (took >= cap * 1_000_000)).alias("failed"), F.count_if(took > warn * 1_000_000).alias("warned"),
    )


def minutes_left(expiries: DataFrame, now: DataFrame) -> DataFrame:
    """``expiries`` with the whole minutes left at ``now`` (one row), begun ones counted, 0 at least."""
    left = (micros(F.col("expiry")) - micros(F.col("now"))) / 60_000_000
    return expiries.crossJoin(F.broadcast(now)).withColumn("minutes", F.greatest(F.lit(0).cast("long"), F.ceil(left))).drop("now")


def retention(jobs: DataFrame, downloads: DataFrame, minutes: int = 10, more: int = 5) -> DataFrame:
    """Expiry of each job: ten minutes after its end, five more when a download was active then."""
    base = jobs.withColumn("expiry", F.col("done") + F.make_dt_interval(mins=F.lit(minutes)))
    active = base.join(downloads, "job").where("begin <= expiry AND finish > expiry").select("job").distinct().withColumn("_busy", F.lit(True))
    later = F.when(F.col("_busy"), F.col("expiry") + F.make_dt_interval(mins=F.lit(more))).otherwise(F.col("expiry"))
    return base.join(active, "job", "left").select("job", "done", later.alias("expiry"))


def job_progress(events: DataFrame) -> DataFrame:
    """Latest action of each job and how many it has seen; an aggregation that also runs on a stream in update mode."""
    return events.groupBy("key").agg(F.max_by("action", F.struct("ts", "id")).alias("status"), F.count("*").alias("steps"), F.max("ts").alias("at"))


def rank_sources(probes: DataFrame) -> DataFrame:
    """Healthy sources by latency, then the others in pool order."""
    order = Window.partitionBy("pool").orderBy(F.desc("healthy"), F.when(F.col("healthy"), F.col("latency")).otherwise(F.col("place")), "place")
    return probes.withColumn("rank", F.row_number().over(order))


def job_log_tail_stream(events: DataFrame, most: int = 5000) -> DataFrame:
    """The newest ``most`` events of each key on a stream, in update mode: a key's state is that list and no more."""

    def one_key(key, batches, state: GroupState):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(batches)).sort_values(["ts", "id"])
        held = sorted([*held, *zip(new["ts"].tolist(), new["id"].tolist(), strict=True)])[-most:]
        state.update(([t for t, _ in held], [i for _, i in held]))
        yield pd.DataFrame({"key": [key[0]], "ids": [[i for _, i in held]]})

    timed = events.select("id", "key", micros(F.col("ts")).alias("ts"))
    return timed.groupBy("key").applyInPandasWithState(one_key, "key long, ids array<long>", "ts array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)

