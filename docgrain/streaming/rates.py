"""Streaming counters: rate limits, windowed aggregates, alerts, lockouts; and streaming ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docgrain.operators.reports import BUCKETS, interpolated


def over_limit(stream: DataFrame, user: str, ts: str, limit: int = 20, late: str = "10 minutes") -> DataFrame:
    """(minute, user, n): fixed epoch minutes in which a user made more than `limit` requests."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w"), user).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(F.col("w.start").alias("minute"), user, "n")


def windowed(stream: DataFrame, ts: str, by: str, value: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, error counts and sums per window and group."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, length).alias("w"), by)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total")
    )


def alerts(stream: DataFrame, ts: str, failed: Column, length: str = "1 hour", share: float = 0.2, least: int = 5, late: str = "10 minutes") -> DataFrame:
    """Windows in which the share of failures passes a bound."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return w.where((F.col("n") >= least) & (F.col("failed") > F.col("n") * share)).select(F.col("w.start").alias("start"), "n", "failed")


def slow_alerts(stream: DataFrame, ts: str, seconds: Column, length: str = "5 minutes", share: float = 0.95, most: float = 1.0, least: int = 5, late: str = "10 minutes") -> DataFrame:
    """(start, n, p): windows of at least `least` durations whose quantile passes a bound.

    A window's state is a histogram of cumulative counts, which merges by addition; the quantile is interpolated in its bucket.
    """
    names = [f"le{i}" for i in range(len(BUCKETS))]
    counts = [F.count_if(F.col("_s") <= b).alias(name) for b, name in zip(BUCKETS, names)]
    w = stream.withColumn("_s", seconds).where("_s IS NOT NULL").withWatermark(ts, late).groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("n"), *counts)
    quantile = interpolated(F.array(*names), F.col("n"), share)
    return w.select(F.col("w.start").alias("start"), "n", F.round(quantile, 6).alias("p")).where((F.col("n") >= least) & (F.col("p") > most))


def usage_counters(stream: DataFrame, ts: str, user: str, tokens: str, late: str = "36 hours") -> DataFrame:
    """Daily tokens and messages by user, and each day's event time; state older than the watermark is dropped, as a counter's expiry would."""
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), user)
    return days.agg(F.sum(tokens).alias("tokens"), F.count("*").alias("messages")).select(F.col("w.start").alias("day"), user, "tokens", "messages", F.window_time("w").alias("at"))


def lockouts(stream: DataFrame, user: str, ts: str, failed: str, most: int = 5, minutes: int = 15) -> DataFrame:
    """(user, locked_at): after `most` failures in a row a user is locked for some minutes, in which attempts don't count."""
    kind = dict(stream.dtypes)[user]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, -1)
        out = []
        rows = pd.concat(list(frames)).sort_values(ts)
        for at, bad in zip(rows[ts], rows[failed]):
            micros = at.value // 1000
            if micros < until:
                continue
            count = count + 1 if bad else 0
            if count >= most:
                out.append((key[0], at))
                count, until = 0, micros + minutes * 60_000_000
        state.update((count, until))
        if out:
            yield pd.DataFrame(out, columns=[user, "locked_at"])

    return stream.select(user, ts, failed).groupBy(user).applyInPandasWithState(step, f"{user} {kind}, locked_at timestamp", "count long, until long", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows of a key that was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], good: Column, path: str, checkpoint: str, most: int = 3):
    """Write handled batches below `path`: a batch that is replayed overwrites itself; rows that aren't `good` (or have used
    up their attempts) go to a dead-letter folder. Starts the query and returns it."""

    def batch(df: DataFrame, number: int) -> None:
        bad = ~F.coalesce(good, F.lit(False)) | (F.coalesce(F.col("attempts"), F.lit(0)) >= most)
        handle(df.where(~bad)).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        df.where(bad).write.mode("overwrite").parquet(f"{path}/dead/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
