"""Governance: freshness, weights, queues, quotas, memory and window fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ((90, 90), (180, 75), (365, 55), (730, 35))
STALE, FUTURE = 15, 10


def age_days(since: Column, now: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400_000_000))


def freshness(effective: Column, expires: Column, created: Column, now: Column) -> Column:
    since = F.coalesce(effective, created)
    age = age_days(since, now)
    tier = F.when(since.isNull(), STALE)
    for days, score in TIERS:
        tier = tier.when(age <= days, score)
    return F.when(expires.isNotNull() & (expires <= now), 0).when(effective.isNotNull() & (effective > now), FUTURE).otherwise(tier.otherwise(STALE))


def weight(fresh: Column, authority: Column, consistency: Column, completeness: Column) -> Column:
    """Weighted dimensions less 50, rounded half to even."""
    return F.bround(F.lit(0.35) * fresh + F.lit(0.30) * authority + F.lit(0.20) * consistency + F.lit(0.15) * completeness - 50, 0).cast("int")


def clamped(score: Column) -> Column:
    return F.least(F.greatest(F.coalesce(score.try_cast("int"), F.lit(0)), F.lit(0)), F.lit(100))


def quota_status(user_tokens: Column, user_messages: Column, tenant_day: Column, tenant_month: Column, estimate: Column, limits: dict[str, int], soft: float = 0.9) -> Column:
    return (
        F.when(user_tokens + estimate > limits["user_day"], "QUOTA_EXCEEDED_USER_DAILY_TOKEN")
        .when(user_messages + 1 > limits["user_messages"], "QUOTA_EXCEEDED_USER_DAILY_MSG")
        .when(tenant_day + estimate > limits["tenant_day"], "QUOTA_EXCEEDED_TENANT_DAILY_TOKEN")
        .when(tenant_month + estimate > limits["tenant_month"], "QUOTA_EXCEEDED_TENANT_MONTHLY_TOKEN")
        .when((user_tokens < limits["user_day"] * soft) & (tenant_day < limits["tenant_day"] * soft), "none")
        .otherwise("degrade")
    )


def degrade_level(without_memory: Column, short_history: Column, compressed: Column, used: Column, limit: int) -> Column:
    """The first level whose estimate fits."""
    return F.when(without_memory + used <= limit, "l1_memory").when(short_history + used <= limit, "l2_history").when(compressed + used <= limit, "l3_compress").otherwise("l4_chunks")


def window_fit(fixed: Column, history: Column, chunks: Column, limit: int = 28_000, step: int = 2) -> Column:
    """(history_kept, chunks_kept): 6, 4, 2, then no turns of history; then two chunks fewer at a time, down to two.

    `history` and `chunks` are arrays of token counts, the oldest and the best first.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    tail = lambda n: total(F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), n))
    everything = fixed + total(chunks)
    out = None
    for n in (6, 4, 2):
        fits = everything + tail(n) <= limit
        kept = F.struct(F.least(F.lit(n), F.size(history)).alias("history_kept"), F.size(chunks).alias("chunks_kept"))
        out = F.when(fits, kept) if out is None else out.when(fits, kept)
    sizes = F.filter(F.sequence(F.lit(0), F.floor(F.size(chunks) / step).cast("int")), lambda i: F.size(chunks) - i * step >= F.least(F.lit(2), F.size(chunks)))
    fitting = F.filter(F.transform(sizes, lambda i: F.size(chunks) - i * step), lambda k: fixed + total(F.slice(chunks, 1, k)) <= limit)
    least = F.array_min(F.transform(sizes, lambda i: F.size(chunks) - i * step))
    return out.otherwise(F.struct(F.lit(0).alias("history_kept"), F.coalesce(F.get(fitting, F.lit(0)), least).alias("chunks_kept")))
