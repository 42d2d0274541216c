"""Evaluation of retrieval runs over cases (answerable, score, refused, file_hit, unlabelled)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of a sweep, in hundredths.
STEPS = tuple(range(0, 91, 5))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole == 0, None).otherwise(F.round(part * 100.0 / whole, digits))


def metrics(cases: DataFrame) -> DataFrame:
    a, r = F.col("answerable"), F.col("refused")
    judged = a & ~r & ~F.col("unlabelled")
    return cases.agg(
        percent(F.count_if(~a & r), F.count_if(~a), 2).alias("refusal_rate"),
        percent(F.count_if(a & r), F.count_if(a), 2).alias("miss_rate"),
        percent(F.count_if(judged & F.col("file_hit")), F.count_if(judged), 2).alias("hit_rate"),
    )


def gate_report(cases: DataFrame, by: str) -> DataFrame:
    n = F.count("*")
    return cases.groupBy(by).agg(n.alias("n"), percent(F.count_if(F.col("answerable") != F.col("refused")), n, 1).alias("accuracy"))


def sweep(cases: DataFrame) -> DataFrame:
    """Refusal accuracy, miss rate and F1 at each threshold: cases are counted by step first, so each is read once."""
    step = F.least(F.floor(F.col("score") * 100 / 5 + 1e-9).cast("int"), F.lit(len(STEPS) - 1))
    counts = cases.groupBy(step.alias("step")).agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    total = counts.agg(*[F.sum(F.when(F.col("step") >= i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(len(STEPS)) for c in "au"], F.sum("a").alias("a"), F.sum("u").alias("u"))
    rows = F.explode(F.array(*[F.struct(F.lit(s / 100).alias("threshold"), F.col(f"a{i}").alias("tp"), F.col(f"u{i}").alias("fp"), (F.col("a") - F.col(f"a{i}")).alias("fn"), (F.col("u") - F.col(f"u{i}")).alias("tn")) for i, s in enumerate(STEPS)])).alias("x")
    x = total.select(rows).select("x.*")
    share = lambda p, w: F.round(p / F.greatest(w, F.lit(1)), 6)
    return x.select(
        F.round("threshold", 2).alias("threshold"),
        share(F.col("tn"), F.col("tn") + F.col("fp")).alias("refusal_acc"),
        share(F.col("fn"), F.col("tp") + F.col("fn")).alias("miss_rate"),
        share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def precheck(cases: DataFrame, threshold: float) -> DataFrame:
    good = F.when(F.col("answerable"), (F.col("score") >= threshold) & F.col("file_hit")).otherwise(F.col("score") < threshold)
    return cases.groupBy("answerable").agg(F.count("*").alias("n"), F.count_if(good).alias("passed"))


def compared(base: DataFrame, now: DataFrame, higher: list[str], skipped: list[str], most: float) -> DataFrame:
    """Whether a metric got worse by more than `most`; `higher` names those where more is better."""
    both = base.join(now, "metric")
    loss = F.when(F.col("metric").isin(*higher), F.col("base") - F.col("now")).otherwise(F.col("now") - F.col("base"))
    return both.select("metric", "base", "now", ((loss > most) & ~F.col("metric").isin(*skipped)).alias("regressed"))


def drift(base: Column, now: Column) -> Column:
    return F.when(base.isNull() | now.isNull(), "not recorded").when(base == now, "same").otherwise("changed")
