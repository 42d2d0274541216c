"""Selection by counted bits against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.operators import reports, selection

AWKWARD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3, 2.0**52, 2.0**53 + 2, 1e-310, 8.0, 7.999999999999999, 1023.9999999999999, 1024.0]


def test_ordered_bits_are_the_numbers_bits(spark):
    r = random.Random(3)
    values = AWKWARD + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(2000)] + [2.0**k for k in range(-1074, 1024, 7)] + [np.nextafter(2.0**k, 0).item() for k in range(-1070, 1024, 7)]
    values = [v for v in values if not math.isnan(v)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("v", selection.ordered_bits(F.col("v")).alias("k")).collect()
    for row in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["k"] == (-bits if row["v"] < 0 else bits), row
    assert spark.createDataFrame([(float("nan"),)], "v double").select(selection.ordered_bits(F.col("v"))).first()[0] == 2**63 - 1


@pytest.mark.parametrize("kind", ["double", "bigint", "int"])
def test_places(spark, kind):
    r = random.Random(5)
    big = 2**62 if kind == "bigint" else 2**30
    make = {"double": lambda: r.choice([r.gauss(0, 1e3), r.choice(AWKWARD), float(r.randrange(3))])}.get(kind, lambda: r.choice([r.randrange(-big, big), r.randrange(4)]))
    rows = [(g, make()) for g in ("a", None, "b") for _ in range(r.randrange(1, 300))] + [("a", None), ("only null", None), ("one", make())]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(4)
    got = {(x["g"], x["place"]): (x["n"], x["value"]) for x in selection.at_places(df, ["g"], "v", lambda n: F.sequence(F.lit(0), n - 1)).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, i): (len(own), v) for i, v in enumerate(own)}
    assert got == want


def test_percentiles_as_numpy_has_them(spark):
    r = random.Random(8)
    rows = [(g, r.choice([r.expovariate(1e-3), float(r.randrange(5))])) for g in range(4) for _ in range(1 + 50 * g)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(x["g"], x["share"]): x["value"] for x in selection.percentiles(df, ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    for g in range(4):
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[g, p] == pytest.approx(np.percentile([v for k, v in rows if k == g], 100 * p), rel=1e-12)
    assert len(got) == 16
    table = {x["g"]: x for x in reports.latency_percentiles(df, "g", ["v"]).collect()}
    assert (table[9]["v_p50"], table[9]["v_p99"]) == (0.0, 0.0) and len(table) == 5


def test_ten_million_distinct_values(spark):
    """One group of 10^7 distinct values: the bins of a pass are all that is held."""
    n = 10_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n / 7.0).alias("v"))
    got = {x["share"]: x["value"] for x in selection.percentiles(rows, [], "v", (0.5, 0.95, 0.99)).collect()}
    assert got == {p: pytest.approx(p * (n - 1) / 7.0, rel=1e-12) for p in (0.5, 0.95, 0.99)}
