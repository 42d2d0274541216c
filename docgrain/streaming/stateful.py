"""Streams with state of their own: serial segments of a document, and calendar months fed by days. State has timers and ends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rates import usage_counters

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED, FINALISED, DEAD = "released", "finalised", "dead"


def state_on_disk(spark: SparkSession) -> None:
    """These operators need a state store that keeps its keys on disk."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Chain(StatefulProcessor):
    """One document's segments: the next one is released once it and all before it have succeeded; the last one finalises the
    document. What can't be whole is closed as dead: a segment out of tries, one beyond the document's end, pages that don't add up, or
    no news until the deadline. A closed document keeps a mark, so that late rows don't open it again, until its timer ends that too."""

    def __init__(self, most: int, patience: int):
        self.most, self.patience = most, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "upcoming int, pages int, deadline long, closed boolean")
        self.early = handle.getMapState("early", "segment int", "pages int")

    def _deadline(self, old: int, new: int) -> None:
        if new > old:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        upcoming, pages, deadline, closed = self.about.get() if self.about.exists() else (0, 0, -1, False)
        held = sorted(rows, key=lambda r: (r["ts"], r["segment"], not r["ok"]))
        latest = max(int(r["ts"].timestamp() * 1000) for r in held) + self.patience
        if latest > deadline:
            self._deadline(deadline, latest)
            deadline = latest
        for r in held:
            if closed:
                break
            segment, total = r["segment"], r["total"]
            if segment < 0 or segment >= total or not r["ok"] and r["attempts"] >= self.most:
                closed = True
                yield Row(document=key[0], event=DEAD, segment=segment)
            elif r["ok"] and segment >= upcoming and not self.early.containsKey((segment,)):
                self.early.updateValue((segment,), (r["pages"],))
                while not closed and self.early.containsKey((upcoming,)):
                    pages += self.early.getValue((upcoming,))[0]
                    self.early.removeKey((upcoming,))
                    yield Row(document=key[0], event=RELEASED, segment=upcoming)
                    upcoming += 1
                    if upcoming == total:
                        closed = True
                        yield Row(document=key[0], event=FINALISED if pages == r["all_pages"] else DEAD, segment=total)
        if closed:
            self.early.clear()
        self.about.update((upcoming, pages, deadline, closed))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upcoming, _, _, closed = self.about.get()
        self.about.clear()
        self.early.clear()
        if not closed:
            yield Row(document=key[0], event=DEAD, segment=upcoming)

    def close(self) -> None:
        pass


def serial_segments(stream: DataFrame, most: int = 3, patience: str = "2 days", late: str = "10 minutes") -> DataFrame:
    """(document, event, segment) of rows (document, segment from 0, ok, attempts, pages, total segments, all_pages, ts): segments
    released in order, and at the end finalised or dead. A repeated segment counts once. Without news for `patience` a document is dead."""
    spark = stream.sparkSession
    state_on_disk(spark)
    wait = spark.range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {patience}) AS LONG) AS ms")).first()["ms"]
    kind = dict(stream.dtypes)["document"]
    rows = stream.select("document", F.col("segment").cast("int").alias("segment"), "ok", F.col("attempts").cast("int").alias("attempts"), F.col("pages").cast("int").alias("pages"), F.col("total").cast("int").alias("total"), F.col("all_pages").cast("int").alias("all_pages"), "ts")
    return rows.withWatermark("ts", late).groupBy("document").transformWithState(Chain(most, wait), f"document {kind}, event string, segment int", "append", "eventTime")


class Months(StatefulProcessor):
    """One user's months: days add to their month, which is told and dropped once the watermark passes its end and the time it is kept."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "ends long", "month string, tokens double, messages long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            first = r["day"].replace(day=1)
            ends = int((first + dt.timedelta(days=32)).replace(day=1, tzinfo=dt.timezone.utc).timestamp() * 1000) + self.kept
            if self.months.containsKey((ends,)):
                _, tokens, messages = self.months.getValue((ends,))
            else:
                tokens, messages = 0.0, 0
                self.handle.registerTimer(ends)
            self.months.updateValue((ends,), (f"{first:%Y%m}", tokens + (r["tokens"] or 0.0), messages + r["messages"]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ends = (expiredTimerInfo.getExpiryTimeInMs(),)
        if self.months.containsKey(ends):
            month, tokens, messages = self.months.getValue(ends)
            self.months.removeKey(ends)
            yield Row(user=key[0], month=month, tokens=tokens, messages=messages)

    def close(self) -> None:
        pass


def monthly_counters(stream: DataFrame, ts: str, user: str, tokens: str, late: str = "36 hours", kept_days: int = 35) -> DataFrame:
    """(user, month, tokens, messages) of calendar months in UTC, fed by the closed days of `usage_counters`; a month is told
    `kept_days` after its end, when its counter expires."""
    state_on_disk(stream.sparkSession)
    kind = dict(stream.dtypes)[user]
    days = usage_counters(stream, ts, user, tokens, late)
    days = days.select(F.col(user).alias("user"), F.col("day"), F.col("tokens").cast("double").alias("tokens"), "messages", "at")
    days = days.select("user", F.to_timestamp_ntz(F.date_format("day", "yyyy-MM-dd")).alias("day"), "tokens", "messages", "at")
    return days.groupBy("user").transformWithState(Months(kept_days * 86_400_000), f"user {kind}, month string, tokens double, messages long", "append", "eventTime")
