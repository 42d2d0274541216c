"""Aggregates of audit records and load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import at_places, percentiles

#: Bucket bounds of durations, in seconds; beyond the last is +Inf (null here).
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part * 100.0 / whole, digits))


SHARES = (0.5, 0.95, 0.99)


def latency_percentiles(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Exact interpolated p50, p95 and p99 of each column, by selection; 0 where all values are null."""
    each = rows.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(by, "x.name", "x.value")
    found = percentiles(each, [by, "name"], "value", SHARES)
    absent = rows.groupBy(by).agg(F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("share"), F.lit(None).cast("double").alias("value"))
    name = lambda c, p: F.round(F.coalesce(F.max(F.when((F.col("name") == c) & (F.col("share") == p), F.col("value"))), F.lit(0.0)), 6).alias(f"{c}_p{int(p * 100)}")
    return found.unionByName(absent).groupBy(by).agg(*(name(c, p) for c in columns for p in SHARES))


def usage(rows: DataFrame, by: str, day: Column) -> DataFrame:
    """Tokens and messages of the day and of all rows; a row without one of its counts adds no tokens."""
    today = (F.col("ts") >= day) & (F.col("ts") < F.date_add(day, 1))
    return rows.groupBy(by).agg(
        F.coalesce(F.sum(F.when(today, F.col("tokens"))), F.lit(0)).alias("day_tokens"),
        F.count_if(today).alias("day_messages"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("month_tokens"),
    )


def histogram(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """(by, le, n): cumulative counts by bucket bound, null for +Inf. Rows are counted by bucket before they are summed up."""
    at = F.lit(len(BUCKETS))
    for i in reversed(range(len(BUCKETS))):
        at = F.when(F.col(seconds) <= BUCKETS[i], i).otherwise(at)
    counts = rows.groupBy(by, at.alias("at")).agg(F.count("*").alias("c"))
    each = counts.groupBy(by).agg(*[F.sum(F.when(F.col("at") <= i, F.col("c")).otherwise(0)).alias(f"b{i}") for i in range(len(BUCKETS) + 1)])
    bounds = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*BUCKETS, None])])
    return each.select(by, F.explode(bounds).alias("x")).select(by, "x.le", "x.n")


def interpolated(counts: Column, total: Column, share: float) -> Column:
    """The quantile of a histogram (cumulative counts by BUCKETS), interpolated in its bucket; the last bound for what lies beyond."""
    bounds, want = F.array(*(F.lit(b) for b in BUCKETS)), total * share
    at = F.size(F.filter(counts, lambda c: c < want))
    under, base = (F.coalesce(F.when(at > 0, F.get(x, at - 1)), F.lit(0)) for x in (counts, bounds))
    width, inside = F.get(bounds, at) - base, F.get(counts, at) - under
    return F.when(at >= len(BUCKETS), BUCKETS[-1]).otherwise(base + width * F.when(inside == 0, 0.0).otherwise((want - under) / inside))


def bucket_quantile(buckets: DataFrame, by: str, q: float) -> DataFrame:
    """The q-quantile, interpolated in its bucket; the last bound for what lies beyond."""
    line = F.array_sort(F.collect_list(F.when(F.col("le").isNotNull(), F.struct("le", "n")))).alias("line")
    each = buckets.groupBy(by).agg(line, (F.max("n") * q).alias("want"))
    at = F.size(F.filter("line", lambda x: x["n"] < F.col("want")))
    each = each.withColumn("at", at)
    high, low = F.get("line", F.col("at")), F.get("line", F.col("at") - 1)
    base, under = F.coalesce(F.when(F.col("at") > 0, low["le"]), F.lit(0.0)), F.coalesce(F.when(F.col("at") > 0, low["n"]), F.lit(0))
    inside = base + (high["le"] - base) * F.when(high["n"] == under, 0.0).otherwise((F.col("want") - under) / (high["n"] - under))
    return each.select(by, F.round(F.when(F.col("at") >= len(BUCKETS), BUCKETS[-1]).otherwise(inside), 6).alias("q"))


def nearest_ranks(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at place round(share * (n - 1)), half to even, by selection; no group is gathered or sorted in one task."""
    place = lambda p, n: F.bround(F.lit(p) * (n - 1), 0).cast("long")
    found = at_places(rows, [by], value, lambda n: F.array(*(place(p, n) for p in shares.values())))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("place") == place(p, F.col("n")), F.col("value"))).alias(name) for name, p in shares.items()])


def load_summary(rows: DataFrame, failed: Column, value: str, wall: float) -> DataFrame:
    n = F.count("*")
    shares = percentiles(rows, [], value, SHARES)
    shares = shares.agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 6).alias(f"p{int(p * 100)}") for p in SHARES])
    whole = rows.agg(
        n.alias("requests"),
        F.round(n / wall, 6).alias("qps"),
        F.round(F.count_if(failed) * 100.0 / n, 2).alias("error_pct"),
        F.round(F.avg(value), 6).alias("mean"),
    )
    return whole.withColumn("one", F.lit(1)).join(F.broadcast(shares.withColumn("one", F.lit(1))), "one").drop("one")
