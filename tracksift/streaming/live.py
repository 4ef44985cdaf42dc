"""Streaming forms of the batch transforms, with watermarks for late rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracksift.session import ship


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark; times without a zone count as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def per_window(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than `late` are left out."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _timed(events, ts, late).groupBy(win.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_seen(events: DataFrame, ids: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark(ids)


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after `gap` without rows."""
    out = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def fresh_cache(events: DataFrame, key: str, ts: str = "ts", ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The first event of each key and `ttl` window: what is asked for again within it comes from the cache."""
    return _timed(events, ts, late).groupBy(F.window(ts, ttl).alias("w"), key).agg(F.min(ts).alias("first_ts"), F.count("*").alias("asked")).select(key, "first_ts", "asked")


class _States(StatefulProcessor):
    """Keeps a key's state until its time to live is over; the first event starts it and gives fresh."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n = sum(len(r) for r in rows)
        before = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((before + n,))
        yield pd.DataFrame({"key": [key[0]], "fresh": [before == 0], "asked": [before + n]})

    def close(self) -> None:
        pass


def with_ttl(events: DataFrame, key: str, ttl_s: int) -> DataFrame:
    """key, fresh, asked for each key of a batch: a state that expires ttl_s seconds after its last update (transformWithState)."""
    kind = events.schema[key].dataType.simpleString()
    ship(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(_States(ttl_s * 1000), f"key {kind}, fresh boolean, asked long", "Update", "processingTime")


def lru(requests: DataFrame, key: str, ts: str = "ts", size: int = 100, ttl_s: int = 3600, within: tuple[str, ...] = ()) -> DataFrame:
    """Batch form of a cache's answers: hit is whether the key was asked for at most ttl_s seconds and `size` requests before.

    A bound on requests between is the cache's size where they are all different; `within` parts the requests by cache.
    """
    own = Window.partitionBy(*within, key).orderBy(ts)
    nth = F.row_number().over(Window.partitionBy(*within).orderBy(ts)) if within else F.lit(None).cast("int")
    rows = requests.withColumn("_nth", nth)
    last, at = F.lag(ts).over(own), F.lag("_nth").over(own)
    age = F.unix_timestamp(ts) - F.unix_timestamp(last)
    near = (F.col("_nth") - at <= size) if within else F.lit(True)
    return rows.withColumn("hit", F.coalesce((age <= ttl_s) & near, F.lit(False))).drop("_nth")


class _Windows(StatefulProcessor):
    """A key's current window: when it opened and how many it has let through. A timer clears it when it is over."""

    def __init__(self, limit: int, span_ms: int) -> None:
        self.limit, self.span_ms = limit, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        opened, n = self.window.get() if self.window.exists() else (None, 0)
        span = self.span_ms * 1000
        for pdf in rows:
            pdf = pdf.sort_values(["us", "id"], kind="stable")
            allowed, wait = [], []
            for us in pdf["us"]:
                if opened is None or us - opened >= span:
                    opened, n = us, 0
                    self.handle.registerTimer(us // 1000 + self.span_ms)
                n += 1
                allowed.append(n <= self.limit)
                wait.append(None if n <= self.limit else max(1, -(-(opened + span - us) // 1_000_000)))
            yield pd.DataFrame({"key": [key[0]] * len(pdf), "id": pdf["id"].to_numpy(), "allowed": allowed, "retry_after": pd.array(wait, "Int32")})
        self.window.update((opened, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.window.exists() and self.window.get()[0] // 1000 + self.span_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, id_col: str, ts: str, limit: int, span_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, id, allowed, retry_after of each request of a stream, as operators.order.limited gives them in batch: `limit` a window of span_s that a key's first request opens.

    Requests of a key must come in order of time from one step to the next; within a step they are put in order.
    """
    ship(requests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    own = _timed(requests, ts, late).select(key, F.col(id_col).alias("id"), ts, F.unix_micros(ts).alias("us"))
    out = f"key {kinds[key]}, id {kinds[id_col]}, allowed boolean, retry_after int"
    return own.groupBy(key).transformWithStateInPandas(_Windows(limit, span_s * 1000), out, "Append", "eventTime")
