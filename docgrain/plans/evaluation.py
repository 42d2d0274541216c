"""Retrieval quality: metrics, gates, threshold sweeps, comparisons."""

from pyspark.sql import functions as F

from docgrain.operators import evaluation as E
from docgrain.sources import substrate as S

from ._registry import case, plan

# Cases: labelled documents; the score is a hash of the id, the verdicts follow from it.
_CASES = """cases AS (SELECT doc_id, quality = 1 AS answerable, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS score, doc_id % 10 = 0 AS refused, doc_id % 4 <> 1 AS file_hit, doc_id % 7 = 2 AS unlabelled FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1))"""


def cases(spark, d):
    i = F.col("doc_id")
    rows = S.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return rows.select("doc_id", (F.col("q") == 1).alias("answerable"), ((i * 37 % 1000) / 1000.0).alias("score"), (i % 10 == 0).alias("refused"), (i % 4 != 1).alias("file_hit"), (i % 7 == 2).alias("unlabelled"))


@plan("ag15_eval_metrics", f"""WITH {_CASES} SELECT round(count(*) FILTER (NOT answerable AND refused) * 100.0::DOUBLE / count(*) FILTER (NOT answerable), 2) AS refusal_rate, round(count(*) FILTER (answerable AND refused) * 100.0::DOUBLE / count(*) FILTER (answerable), 2) AS miss_rate,
round(count(*) FILTER (answerable AND NOT refused AND NOT unlabelled AND file_hit) * 100.0::DOUBLE / count(*) FILTER (answerable AND NOT refused AND NOT unlabelled), 2) AS hit_rate FROM cases""")
def _(spark, d):
    return E.metrics(cases(spark, d))


@plan("ag16_gate_report", f"WITH {_CASES} SELECT doc_id % 3 AS reason, count(*) AS n, round(count(*) FILTER (answerable <> refused) * 100.0::DOUBLE / count(*), 1) AS accuracy FROM cases GROUP BY 1")
def _(spark, d):
    return E.gate_report(cases(spark, d).withColumn("reason", F.col("doc_id") % 3), "reason")


_SWEEP = f"""WITH {_CASES}, t AS (SELECT i, i * 5 / 100.0::DOUBLE AS threshold FROM range(19) r(i)), s AS (SELECT i, threshold, count(*) FILTER (answerable AND score >= threshold) AS tp, count(*) FILTER (NOT answerable AND score >= threshold) AS fp, count(*) FILTER (answerable AND score < threshold) AS fn, count(*) FILTER (NOT answerable AND score < threshold) AS tn FROM cases, t GROUP BY 1, 2)"""


@plan("ag17_threshold_sweep", f"{_SWEEP} SELECT round(threshold, 2) AS threshold, round(tn / greatest(tn + fp, 1)::DOUBLE, 6) AS refusal_acc, round(fn / greatest(tp + fn, 1)::DOUBLE, 6) AS miss_rate, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM s")
def _(spark, d):
    return E.sweep(cases(spark, d))


@plan("ag17_best_threshold", f"{_SWEEP} SELECT round(threshold, 2) AS threshold, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM s ORDER BY f1 DESC, i LIMIT 1")
def _(spark, d):
    return E.sweep(cases(spark, d)).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


@plan("ag18_separation", f"WITH {_CASES} SELECT round(min(score) FILTER (answerable) - max(score) FILTER (NOT answerable), 6) AS separation FROM cases")
def _(spark, d):
    return cases(spark, d).agg(F.round(F.min(F.when(F.col("answerable"), F.col("score"))) - F.max(F.when(~F.col("answerable"), F.col("score"))), 6).alias("separation"))


@plan("xt7_precheck", f"WITH {_CASES} SELECT answerable, count(*) AS n, count(*) FILTER (CASE WHEN answerable THEN score >= 0.5 AND file_hit ELSE score < 0.5 END) AS passed FROM cases GROUP BY 1")
def _(spark, d):
    return E.precheck(cases(spark, d), 0.5)


@case("xt8_baseline_compare", """SELECT * FROM (VALUES ('refusal_rate', 99.0::DOUBLE, 97.5::DOUBLE, true), ('miss_rate', 1.0, 2.5, true), ('hit_rate', 97.0, 80.0, false), ('p95', 4.0, 4.2, false)) t(metric, base, now, regressed)""")
def _(spark, d):
    base = spark.createDataFrame([("refusal_rate", 99.0), ("miss_rate", 1.0), ("hit_rate", 97.0), ("p95", 4.0)], "metric string, base double")
    now = spark.createDataFrame([("refusal_rate", 97.5), ("miss_rate", 2.5), ("hit_rate", 80.0), ("p95", 4.2)], "metric string, now double")
    return E.compared(base, now, higher=["refusal_rate", "hit_rate"], skipped=["hit_rate"], most=1.0)


@case("xt9_caliber_drift", """SELECT * FROM (VALUES ('graph', 'changed'), ('rerank', 'not recorded'), ('model', 'same')) t(name, drift)""")
def _(spark, d):
    names = spark.createDataFrame([("graph",), ("rerank",), ("model",)], "name string")
    base, now = '{"graph": true, "model": "m1"}', '{"graph": false, "rerank": false, "model": "m1"}'
    field = lambda j: F.expr(f"get_json_object('{j}', concat('$.', name))")
    return names.select("name", E.drift(field(base), field(now)).alias("drift"))


@plan("xt10_run_validity", f"WITH {_CASES} SELECT doc_id % 5 AS run, count(*) FILTER (file_hit) >= 20 AND count(*) FILTER (score > 0.9) > 0 AS valid FROM cases GROUP BY 1")
def _(spark, d):
    return cases(spark, d).groupBy((F.col("doc_id") % 5).alias("run")).agg(((F.count_if("file_hit") >= 20) & (F.count_if(F.col("score") > 0.9) > 0)).alias("valid"))
