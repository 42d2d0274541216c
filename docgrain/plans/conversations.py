"""The engine's own methods as plans, so that they are checked like the operators they are made of."""

from pyspark.sql import functions as F

from docgrain.engine import Engine
from docgrain.sources import substrate as S

from ._registry import plan


@plan("engine_latency_report", f"{S.cte('audit')} SELECT action, count(*) AS total, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS value_p50, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS value_p95, round(coalesce(quantile_cont(value, 0.99), 0), 6) AS value_p99 FROM audit GROUP BY action")
def _(spark, d):
    return Engine(spark).report_latency(S.events(spark, d), "action", "value")
