"""Streaming operators run to the end of what is there, through a file sink, and read back."""

from pyspark.sql import functions as F

from docgrain.operators.rows import fresh_path
from docgrain.sources import substrate as S
from docgrain.streaming import rates, stateful

from ._registry import plan


def _folder(spark):
    """Below the cluster's shared folder."""
    return fresh_path(spark, "stream")


def _events(spark, d):
    """The events table as a stream of files, with a last row that moves the watermark past all others."""
    schema = S.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "true").parquet(d)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"), "value")


def _drained(spark, stream, mode="append"):
    """All that the stream gives for the rows there are; windows still open at the end are flushed by a second input."""
    out = _folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


_CLOSED = "e AS (SELECT ts, user_id, event_type AS action, value FROM events), m AS (SELECT max(ts) - INTERVAL {late} AS mark FROM e)"


@plan("stream_windowed_rates", f"WITH {_CLOSED.format(late='10 MINUTE')}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, action, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, action, n, total FROM w, m WHERE s + INTERVAL 6 HOUR <= mark")
def _(spark, d):
    rows = _drained(spark, rates.windowed(_events(spark, d), "ts", "action", "value", "6 hours"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "action", "n", "total")


@plan("stream_daily_usage", f"WITH {_CLOSED.format(late='36 HOUR')}, w AS (SELECT date_trunc('day', ts) AS s, user_id, round(sum(value), 6) AS tokens, count(*) AS messages FROM e GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d') AS day, user_id, tokens, messages FROM w, m WHERE s + INTERVAL 1 DAY <= mark")
def _(spark, d):
    rows = _drained(spark, rates.usage_counters(_events(spark, d), "ts", "user_id", "value"))
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", F.round("tokens", 6).alias("tokens"), "messages")


@plan("stream_error_alerts", f"WITH {_CLOSED.format(late='10 MINUTE')}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS s, count(*) AS n, count(*) FILTER (action = 'error') AS failed FROM e GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, n, failed FROM w, m WHERE s + INTERVAL 1 HOUR <= mark AND n >= 5 AND failed > n * 0.2")
def _(spark, d):
    rows = _drained(spark, rates.alerts(_events(spark, d), "ts", F.col("action") == "error"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "failed")


@plan("stream_rate_limit", f"WITH {_CLOSED.format(late='10 MINUTE')}, w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts, TIMESTAMP '1970-01-01') AS s, user_id % 2 AS user_id, count(*) AS n FROM e GROUP BY 1, 2) SELECT strftime(s, '%Y-%m-%d %H:%M') AS minute, user_id, n FROM w, m WHERE s + INTERVAL 1 MINUTE <= mark AND n > 1")
def _(spark, d):
    rows = _drained(spark, rates.over_limit(_events(spark, d).withColumn("user_id", F.col("user_id") % 2), "user_id", "ts", limit=1))
    return rows.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "user_id", "n")


@plan("stream_login_locks", """WITH RECURSIVE e AS (SELECT user_id % 50 AS user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0 AS failures, TIMESTAMP '1970-01-01' AS until, false AS hit, NULL::TIMESTAMP AS ts FROM e UNION ALL
SELECT e.user_id, e.n, CASE WHEN e.ts < s.until THEN s.failures WHEN NOT e.bad OR s.failures = 1 THEN 0 ELSE s.failures + 1 END, CASE WHEN e.ts >= s.until AND e.bad AND s.failures = 1 THEN e.ts + INTERVAL 720 MINUTE ELSE s.until END, e.ts >= s.until AND e.bad AND s.failures = 1, e.ts FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS locked_at FROM s WHERE hit""")
def _(spark, d):
    tries = _events(spark, d).select((F.col("user_id") % 50).alias("user_id"), "ts", (F.col("action") == "error").alias("failed"))
    rows = _drained(spark, rates.lockouts(tries, "user_id", "ts", "failed", most=2, minutes=720))
    return rows.select("user_id", F.date_format("locked_at", "yyyy-MM-dd HH:mm:ss").alias("locked_at"))


@plan("stream_seen_once", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    return _drained(spark, rates.once(_events(spark, d), "user_id", "ts", "60 days").select("user_id"))


@plan("stream_ingested_rows", "SELECT user_id % 10 AS part, event_type AS action, event_type <> 'error' AND user_id % 5 < 3 AS done, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    out = _folder(spark)
    rows = _events(spark, d).withColumn("attempts", (F.col("user_id") % 5).cast("int"))
    rates.ingest(rows, lambda df: df.select("user_id", "action", "value"), F.col("action") != "error", f"{out}/rows", f"{out}/state").awaitTermination()
    read = lambda part, done: spark.read.option("basePath", f"{out}/rows/{part}").parquet(f"{out}/rows/{part}").select("user_id", "action", "value", F.lit(done).alias("done"))
    both = read("done", True).unionByName(read("dead", False))
    return both.groupBy((F.col("user_id") % 10).alias("part"), "action", "done").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _segments(spark, d, documents):
    """Events as segments of documents: eight each, of two pages."""
    rows = spark.readStream.schema(S.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "true").parquet(d)
    return rows.select((F.col("user_id") % documents).alias("document"), (F.col("event_id") % 8).cast("int").alias("segment"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("value") < 1, 3).otherwise(1).alias("attempts"), F.lit(2).alias("pages"), F.lit(8).alias("total"), F.lit(16).alias("all_pages"), F.col("ts").cast("timestamp").alias("ts"))


@plan("stream_serial_segments", """WITH e AS (SELECT user_id % 40 AS document_id, (event_id % 8)::INTEGER AS segment, min(event_id) AS first, bool_or(event_type <> 'error') AS ok FROM events GROUP BY 1, 2),
g AS (SELECT document_id, segment FROM e WHERE ok), r AS (SELECT document_id, segment, segment = row_number() OVER (PARTITION BY document_id ORDER BY segment) - 1 AS unbroken FROM g)
SELECT document_id, max(segment) + 1 AS done FROM r WHERE unbroken GROUP BY document_id""")
def _(spark, d):
    rows = _drained(spark, stateful.serial_segments(_segments(spark, d, 40).withColumn("attempts", F.lit(0))))
    return rows.where("event = 'released'").groupBy(F.col("document").alias("document_id")).agg((F.max("segment") + 1).alias("done"))


@plan("stream_closed_chains", f"""WITH RECURSIVE {_CLOSED.format(late='10 MINUTE')}, s AS (SELECT user_id % 1500 AS document, (event_id % 8)::INTEGER AS segment, event_type <> 'error' AS ok, value < 1 AS spent, ts FROM events),
bad AS (SELECT document, min((ts, segment)) AS pos FROM s WHERE NOT ok AND spent GROUP BY 1),
good AS (SELECT document, segment, min((ts, segment)) AS pos FROM s WHERE ok GROUP BY 1, 2),
whole AS (SELECT document, max(pos) AS pos FROM good GROUP BY 1 HAVING count(*) = 8),
news AS (SELECT document, max(ts) AS last FROM s GROUP BY 1)
SELECT document AS document_id, CASE WHEN whole.pos IS NOT NULL AND (bad.pos IS NULL OR whole.pos < bad.pos) THEN 'finalised' ELSE 'dead' END AS status FROM news LEFT JOIN bad USING (document) LEFT JOIN whole USING (document), m
WHERE whole.pos IS NOT NULL OR bad.pos IS NOT NULL OR last + INTERVAL 2 DAY < mark""")
def _(spark, d):
    rows = _drained(spark, stateful.serial_segments(_segments(spark, d, 1500)))
    return rows.where("event <> 'released'").select(F.col("document").alias("document_id"), F.col("event").alias("status"))


@plan("stream_slow_alerts", f"""WITH {_CLOSED.format(late='10 MINUTE')}, b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0])::DOUBLE AS le, generate_subscripts([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0], 1) AS i),
t AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS s, value / 20 AS v FROM e), n AS (SELECT s, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT n.s, n.n, i, le, (SELECT count(*) FROM t WHERE t.s = n.s AND t.v <= le) AS c FROM n, b), k AS (SELECT s, n, count(*) FILTER (c < n * 0.95::DOUBLE) AS pos FROM h GROUP BY 1, 2),
p AS (SELECT k.s, k.n, CASE WHEN pos >= 11 THEN 10.0 ELSE coalesce(lo.le, 0) + (hi.le - coalesce(lo.le, 0)) * CASE WHEN hi.c = coalesce(lo.c, 0) THEN 0 ELSE (k.n * 0.95::DOUBLE - coalesce(lo.c, 0)) / (hi.c - coalesce(lo.c, 0)) END END AS p FROM k LEFT JOIN h hi ON hi.s = k.s AND hi.i = pos + 1 LEFT JOIN h lo ON lo.s = k.s AND lo.i = pos)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, n, round(p, 6)::DOUBLE AS p FROM p, m WHERE s + INTERVAL 1 HOUR <= mark AND n >= 5 AND round(p, 6) > 4.0""")
def _(spark, d):
    rows = _drained(spark, rates.slow_alerts(_events(spark, d), "ts", F.col("value") / 20, "1 hour", most=4.0))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "p")


# Six times as slow a clock, so that the table's month makes six.
_SLOW = "make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) * 6)"


@plan("stream_monthly_usage", f"""WITH e AS (SELECT {_SLOW} AS ts, user_id % 100 AS user_id, value FROM events), m AS (SELECT max(ts) - INTERVAL 36 HOUR AS mark FROM e),
d AS (SELECT date_trunc('day', ts) AS day, user_id, sum(value) AS tokens, count(*) AS messages FROM e GROUP BY 1, 2)
SELECT user_id, strftime(date_trunc('month', day), '%Y%m') AS month, round(sum(tokens), 4) AS tokens, sum(messages)::BIGINT AS messages FROM d, m GROUP BY user_id, date_trunc('month', day), mark HAVING date_trunc('month', day) + INTERVAL 1 MONTH + INTERVAL 35 DAY < mark""")
def _(spark, d):
    micros = F.lit(1704067200000000) + (F.unix_micros("ts") - 1704067200000000) * 6
    rows = _drained(spark, stateful.monthly_counters(_events(spark, d).withColumn("ts", F.timestamp_micros(micros)).withColumn("user_id", F.col("user_id") % 100), "ts", "user_id", "value"))
    return rows.select(F.col("user").alias("user_id"), "month", F.round("tokens", 4).alias("tokens"), "messages")
