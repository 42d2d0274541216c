"""Reports: counts, percentiles, usage, readiness, histograms, load and evaluation summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import reports as R
from docgrain.sources import substrate as S

from ._registry import plan

_AUDIT = S.cte("audit")


@plan("ag1_filtered_counts", f"{_AUDIT} SELECT action, count(*) AS total, count(*) FILTER (k >= 50) AS refused FROM audit GROUP BY action")
def _(spark, d):
    return S.events(spark, d).groupBy("action").agg(F.count("*").alias("total"), F.count_if(F.col("k") >= 50).alias("refused"))


@plan("ag2_latency_percentiles", f"{_AUDIT} SELECT action, " + ", ".join(f"round(coalesce(quantile_cont({c}, {p}), 0), 6) AS {c}_p{int(p * 100)}" for c in ("value", "k") for p in (0.5, 0.95, 0.99)) + " FROM audit GROUP BY action")
def _(spark, d):
    return R.latency_percentiles(S.events(spark, d), "action", ["value", "k"])


@plan("ag3_averages", f"{_AUDIT} SELECT action, round(avg(value), 6) AS mean, round(avg(value) FILTER (k < 30), 6) AS mean_small, round(avg(k), 6) AS mean_k FROM audit GROUP BY action")
def _(spark, d):
    return S.events(spark, d).groupBy("action").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("k") < 30, F.col("value"))), 6).alias("mean_small"), F.round(F.avg("k"), 6).alias("mean_k"))


@plan("ag4_refusal_rate", f"{_AUDIT} SELECT user_id, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (k >= 50) * 100.0::DOUBLE / count(*), 1) END AS refusal_rate FROM audit GROUP BY user_id")
def _(spark, d):
    rows = S.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 50).alias("r"))
    return rows.select("user_id", R.rate(F.col("r"), F.col("n")).alias("refusal_rate"))


@plan("ag5_quota_usage", f"""{_AUDIT}, u AS (SELECT user_id, ts, CASE WHEN k % 10 = 0 THEN NULL ELSE k END + event_id % 50 AS tokens FROM audit WHERE action = 'view')
SELECT user_id, coalesce(sum(tokens) FILTER (ts >= DATE '2024-01-15' AND ts < DATE '2024-01-16'), 0)::BIGINT AS day_tokens, count(*) FILTER (ts >= DATE '2024-01-15' AND ts < DATE '2024-01-16') AS day_messages, coalesce(sum(tokens), 0)::BIGINT AS month_tokens FROM u GROUP BY user_id""")
def _(spark, d):
    rows = S.events(spark, d).where("action = 'view'").withColumn("tokens", F.when(F.col("k") % 10 != 0, F.col("k")) + F.col("event_id") % 50)
    return R.usage(rows, "user_id", F.lit("2024-01-15").cast("date"))


@plan("ag6_documents_per_kb", f"{S.cte('chunks')}, kb AS (SELECT 'src' || i AS kb_id FROM range(25) t(i)) SELECT kb.kb_id, count(chunk_id) AS n FROM kb LEFT JOIN chunks ON chunks.kb_id = kb.kb_id AND is_latest GROUP BY 1")
def _(spark, d):
    counts = S.chunks(spark, d).where("is_latest").groupBy("kb_id").agg(F.count("*").alias("c"))
    kbs = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("kb_id"))
    return kbs.join(counts, "kb_id", "left").select("kb_id", F.coalesce("c", F.lit(0)).alias("n"))


@plan("ag7_users_per_department", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return S.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@plan("ag8_next_version", "SELECT p_brand, coalesce(max(p_size), 0) + 1 AS next FROM part GROUP BY p_brand")
def _(spark, d):
    return S.table(spark, d, "part").groupBy("p_brand").agg((F.coalesce(F.max("p_size"), F.lit(0)) + 1).alias("next"))


@plan("ag9_last_message", "SELECT conv_id, max(turn) AS last FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def _(spark, d):
    return S.table(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.max("turn").alias("last"))


@plan("ag10_entity_frequency", "SELECT l_partkey, count(DISTINCT l_orderkey) AS doc_freq FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return S.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("doc_freq"))


_READY = {"total": "true", "latest": "is_latest", "weighted": "governance_weight IS NOT NULL", "paged": "page_no IS NOT NULL", "tables": "table_group_id IS NOT NULL", "denied": "{size}(deny_subjects) > 0", "secret": "level_rank = 40", "long": "token_count > 1000"}


@plan("ag11_readiness", f"{S.cte('chunks')} SELECT kb_id, " + ", ".join(f"count(*) FILTER ({c.format(size='len')}) AS {k}" for k, c in _READY.items()) + " FROM chunks GROUP BY kb_id")
def _(spark, d):
    return S.chunks(spark, d).groupBy("kb_id").agg(*[F.count_if(F.expr(c.format(size="size"))).alias(k) for k, c in _READY.items()])


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in R.BUCKETS)


@plan("ag12_histogram", f"{_AUDIT}, b AS (SELECT * FROM (VALUES {_BOUNDS}) t(le)) SELECT action, le, count(*) FILTER (value / 10 <= le) AS n FROM audit, b GROUP BY 1, 2")
def _(spark, d):
    return R.histogram(S.events(spark, d).withColumn("seconds", F.col("value") / 10), "action", "seconds").where("le IS NOT NULL")


@plan("ag12_bucket_quantile", f"""{_AUDIT}, b AS (SELECT * FROM (VALUES {_BOUNDS}) t(le)), h AS (SELECT action, le, count(*) FILTER (value / 10 <= le) AS n FROM audit, b GROUP BY 1, 2), t AS (SELECT action, count(*) * 0.9::DOUBLE AS want FROM audit GROUP BY 1),
c AS (SELECT action, le, n, lag(n, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS low FROM h WINDOW w AS (PARTITION BY action ORDER BY le)), f AS (SELECT c.*, want, row_number() OVER (PARTITION BY action ORDER BY le) AS r FROM c JOIN t USING (action) WHERE n >= want)
SELECT action, round(low + (le - low) * CASE WHEN n = below THEN 0 ELSE (want - below) / (n - below) END, 6) AS q FROM f WHERE r = 1 UNION ALL SELECT action, 10.0 FROM t WHERE action NOT IN (SELECT action FROM f)""")
def _(spark, d):
    return R.bucket_quantile(R.histogram(S.events(spark, d).withColumn("seconds", F.col("value") / 10), "action", "seconds"), "action", 0.9)


@plan("ag13_nearest_rank", f"{_AUDIT}, l AS (SELECT action, list_sort(array_agg(value)) AS v FROM audit GROUP BY 1) SELECT action, v[1 + round_even(0.5 * (len(v) - 1), 0)::BIGINT] AS p50, v[1 + round_even(0.95 * (len(v) - 1), 0)::BIGINT] AS p95 FROM l")
def _(spark, d):
    return R.nearest_ranks(S.events(spark, d), "action", "value", {"p50": 0.5, "p95": 0.95})


@plan("ag14_load_summary", f"""{_AUDIT} SELECT count(*) AS requests, round(count(*) / 60.0::DOUBLE, 6) AS qps, round(count(*) FILTER (action = 'error') * 100.0::DOUBLE / count(*), 2) AS error_pct, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM audit""")
def _(spark, d):
    return R.load_summary(S.events(spark, d), F.col("action") == "error", "value", 60.0)


@plan("ag19_relation_support", "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, count(*) AS support FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3")
def _(spark, d):
    from docgrain.operators.graph import relation_support

    return relation_support(S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation")))


@plan("ag20_case_fingerprint", "SELECT principal, substr(sha1(string_agg(line, chr(10) ORDER BY line)), 1, 12) AS fingerprint FROM (SELECT item_id % 3 AS principal, (CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END) || '|' || text || '|' || item_id AS line FROM benchmark) GROUP BY principal")
def _(spark, d):
    line = F.concat_ws("|", (F.col("item_id") % 2 == 0).cast("string"), "text", F.col("item_id").cast("string"))
    rows = S.table(spark, d, "benchmark").select((F.col("item_id") % 3).alias("principal"), line.alias("line"))
    return rows.groupBy("principal").agg(T.short_hash(F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("fingerprint"))


@plan("ag22_line_repeats", "SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    lines = S.documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("times")).where("times > 1")


@plan("ag23_error_rate", r"""WITH t AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS a, regexp_replace(replace(text, 'er', 'x'), '\s+', '', 'g') AS b FROM benchmark) SELECT item_id, round(levenshtein(a, b) / length(a)::DOUBLE, 6) AS cer FROM t""")
def _(spark, d):
    read = F.replace(F.col("text"), F.lit("er"), F.lit("x"))
    return S.table(spark, d, "benchmark").select("item_id", F.round(T.error_rate(F.col("text"), read), 6).alias("cer"))


@plan("sl1_audit_page", f"{_AUDIT} SELECT event_id, action FROM audit ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def _(spark, d):
    from docgrain.operators.rows import page

    return page(S.events(spark, d), [F.desc("ts"), F.col("event_id")], 3, 20).select("event_id", "action")


@plan("sl1_event_pages", "WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS i FROM events), p AS (SELECT unnest([1, (n + 998) // 999 // 2, (n + 998) // 999, (n + 998) // 999 + 1]) AS page FROM n) SELECT page, event_id FROM p JOIN r ON i // 999 = page - 1")
def _(spark, d):
    """The first page, the one in the middle, the last, and one beyond."""
    from docgrain.operators.rows import PageIndex

    index = PageIndex(S.table(spark, d, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")])
    pages, out = -(-index.total // 999), None
    for number in (1, pages // 2, pages, pages + 1):
        one = index.page(number, 999).select(F.lit(number).cast("long").alias("page"), "event_id")
        out = one if out is None else out.unionByName(one)
    return out


@plan("sl3_total_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_name, p_partkey) AS place FROM part QUALIFY place <= 100")
def _(spark, d):
    best = S.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey").limit(100)  # a top list: one task sees 100 rows
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_name", "p_partkey"))).select("p_partkey", F.col("place").cast("long").alias("place"))


@plan("sl5_longest_terms", """WITH t AS (SELECT item_id, unnest(x) AS term, generate_subscripts(x, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS x FROM benchmark))
SELECT item_id, string_agg(term, ',' ORDER BY length(term) DESC, i) AS terms FROM t GROUP BY item_id""")
def _(spark, d):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(T.longest_first(words, 1_000_000), ",").alias("terms"))


@plan("xt6_marker_counts", f"{S.cte('chunks')} SELECT document_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, sum(len(regexp_extract_all(content, 'tion')))::BIGINT AS marks FROM chunks GROUP BY document_id")
def _(spark, d):
    return S.chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.sum(F.regexp_count("content", F.lit("tion"))).alias("marks"))


@plan("xt22_retained", f"{_AUDIT} SELECT event_id FROM audit WHERE ts >= TIMESTAMP '2025-01-15 00:00:00' - INTERVAL 365 DAY")
def _(spark, d):
    return S.events(spark, d).where(F.col("ts") >= F.expr("TIMESTAMP '2025-01-15 00:00:00' - INTERVAL 365 DAYS")).select("event_id")
