"""Values at given places of each group's order, without sorting or gathering a group.

A value becomes a 64-bit number of the same order. Rows are counted by its leading 16 bits, running counts tell which bin has
a wanted place, and only rows of such bins are counted by their next 16 bits, until a bin has a single value: after four
passes at most, whatever the values are. A task holds counters of bins, never a group's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import size_checked, staged

BITS = 16


def ordered_bits(value: Column) -> Column:
    """A double's bits as a signed number of the same order: exponent and fraction, by exact arithmetic. Zeros are alike, NaN is largest."""
    x = F.abs(value)
    near = F.floor(F.log2(x)).cast("int")
    near = F.when(F.pow(F.lit(2.0), near) > x, near - 1).when(F.pow(F.lit(2.0), near + 1) <= x, near + 1).otherwise(near)
    power = F.greatest(near, F.lit(-1022))
    # Below the least normal number the fraction has no leading one.
    fraction = x / F.pow(F.lit(2.0), power) - F.when(near >= -1022, 1.0).otherwise(0.0)
    bits = (power + F.when(near >= -1022, 1023).otherwise(1022)).cast("long") * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    size = F.when(x == 0, F.lit(0)).when(x == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -size).otherwise(size).cast("long")


def order_key(value: Column, kind: str) -> Column:
    return value.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else ordered_bits(value.cast("double"))


def at_places(rows: DataFrame, by: list[str], value: str, places: Callable[[Column], Column]) -> DataFrame:
    """(by, n, place, value): of each group's n values that aren't null, those at the places (from 0) that `places` gives for n.

    Groups are alike where nulls stand for each other. A group without a value has no row.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    data = rows.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("value"), order_key(F.col(value), dict(rows.dtypes)[value]).alias("key"))
    data = staged(data)
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
    before = lambda *keys: F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    shift = 64 - BITS
    bins = staged(count(data, "_g", F.shiftright("key", shift).alias("bin")))
    sizes = bins.groupBy("_g").agg(F.sum("c").alias("n"))
    wanted = sizes.select("_g", "n", F.explode(F.array_distinct(places(F.col("n")))).alias("place"))
    bins = bins.withColumn("before", F.coalesce(before("_g"), F.lit(0)))
    found = staged(wanted.join(bins, "_g").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))))
    done = found.where("low = high OR c = 1")
    while shift and not (found := found.where("low < high")).isEmpty():
        above, shift = shift, shift - BITS
        inside = size_checked(found.select("_g", "bin").distinct().withColumnRenamed("bin", "above"))
        bins = count(data.withColumn("above", F.shiftright("key", above)).join(inside, ["_g", "above"]), "_g", "above", F.shiftright("key", shift).alias("bin"))
        bins = bins.withColumn("within", F.coalesce(before("_g", "above"), F.lit(0)))
        open_ = found.select("_g", "n", "place", F.col("bin").alias("above"), "before")
        at = F.col("before") + F.col("within")
        found = staged(open_.join(bins, ["_g", "above"]).where((F.col("place") >= at) & (F.col("place") < at + F.col("c"))).select("_g", "n", "place", "bin", "c", "low", "high", at.alias("before")))
        done = done.select("_g", "n", "place", "low").unionByName(found.where("low = high OR c = 1").select("_g", "n", "place", "low"))
    return done.select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", "place", F.col("low").alias("value"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, share, value): the value at share * (n - 1), between two places the one between theirs."""
    at = lambda n: [F.lit(p) * (n - 1) for p in shares]
    found = at_places(rows, by, value, lambda n: F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at(n)))))
    each = found.select(*by, "n", "place", F.col("value").cast("double").alias("value"), F.explode(F.array(*(F.struct(F.lit(p).alias("share"), x.alias("at")) for p, x in zip(shares, at(F.col("n")))))).alias("s"))
    each = each.where(F.col("place").between(F.floor("s.at"), F.ceil("s.at")))
    low, high = F.min_by("value", "place"), F.max_by("value", "place")
    ends = each.groupBy(*by, F.col("s.share").alias("share"), F.col("s.at").alias("at")).agg(low.alias("low"), high.alias("high"))
    part = F.col("at") - F.floor("at")
    return ends.select(*by, "share", F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high")).alias("value"))
