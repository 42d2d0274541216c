"""Ranking windows, ordered budgets, set differences."""

from pyspark.sql import functions as F

from docgrain.operators import conversation as C
from docgrain.operators.rows import latest, top, within_budget
from docgrain.sources import substrate as S

from ._registry import plan


@plan("wn2_budgeted_rows", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, sum(o_totalprice) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE n <= 3 AND s <= 300000")
def _(spark, d):
    return within_budget(S.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3, 300000).select("o_custkey", "o_orderkey")


@plan("wn3_latest_version", "SELECT l_orderkey, max(l_linenumber) AS version FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return latest(S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").select("l_orderkey", F.col("l_linenumber").alias("version"))


@plan("wn4_recent_messages", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def _(spark, d):
    return C.recent(S.table(spark, d, "conversations").select("conv_id", "turn"), 6)


_EST = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END"


@plan("wn5_history_budget", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum({_EST}) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR s <= 600")
def _(spark, d):
    return C.history_within(S.table(spark, d, "conversations"), 600).select("conv_id", "turn")


@plan("wn6_first_matching_rule", """WITH r AS (SELECT * FROM (VALUES ('/', 10), ('/ASIA/', 50), ('/ASIA/CHINA/', 90), ('/EUROPE/', 30)) t(pattern, percent)), u AS (SELECT c_custkey, '/' || r_name || '/' || n_name || '/' AS dept FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT c_custkey, pattern, percent, row_number() OVER (PARTITION BY c_custkey ORDER BY pattern DESC) AS n FROM u JOIN r ON starts_with(dept, pattern)) SELECT c_custkey, pattern, percent, (('0x' || substr(sha1(c_custkey::VARCHAR), 1, 16))::UBIGINT % 100)::INTEGER < percent AS enabled FROM m WHERE n = 1""")
def _(spark, d):
    from docgrain.functions.text import rollout_bucket
    from docgrain.operators.rows import size_checked

    rules = spark.createDataFrame([("/", 10), ("/ASIA/", 50), ("/ASIA/CHINA/", 90), ("/EUROPE/", 30)], "pattern string, percent int")
    nations = S.table(spark, d, "nation").join(size_checked(S.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    users = S.table(spark, d, "customer").join(size_checked(nations), F.col("n_nationkey") == F.col("c_nationkey"))
    # A path meets the rules by equality with each of its prefixes.
    prefixes = F.explode(F.array(F.lit("/"), F.concat(F.lit("/"), "r_name", F.lit("/")), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/")))).alias("pattern")
    hit = top(users.select("c_custkey", prefixes).join(size_checked(rules), "pattern"), ["c_custkey"], [F.desc("pattern")], 1)
    return hit.select("c_custkey", "pattern", "percent", (rollout_bucket(F.col("c_custkey").cast("string")) < F.col("percent")).alias("enabled"))


_FACTS = "facts AS (SELECT conv_id % 20 AS user_id, conv_id * 100 + turn AS pos, text AS fact FROM conversations)"


@plan("wn7_merged_facts", f"WITH {_FACTS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, substr(fact, 1, 20) ORDER BY pos) AS k FROM facts), l AS (SELECT user_id, pos, fact, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS n FROM f WHERE k = 1) SELECT user_id, pos, fact FROM l WHERE n <= 20")
def _(spark, d):
    facts = S.table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("fact"))
    return C.merged_facts(facts)


@plan("wn8_latest_run", "SELECT o_orderpriority AS fingerprint, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    return S.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("fingerprint")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@plan("st2_pages_gone", "SELECT url FROM pages WHERE page_id % 3 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    pages = S.table(spark, d, "pages").select("page_id", "url")
    return pages.where("page_id % 3 = 0").select("url").distinct().join(pages.where("page_id % 2 = 0").select("url"), "url", "left_anti")


@plan("st5_cited_expected", "SELECT conv_id, count(*) FILTER (turn IN (1, 3)) > 0 AS hit FROM conversations GROUP BY conv_id")
def _(spark, d):
    cited = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("cited"))
    expected = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))
    return cited.select("conv_id", F.arrays_overlap("cited", expected).alias("hit"))


@plan("xt4_retry_source", """WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, (SELECT max(u.turn) FROM u WHERE u.conv_id = a.conv_id AND u.turn <= a.turn) AS source, a.turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id) AS is_last FROM a""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumn("source", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    return rows.where("role = 'assistant'").select("conv_id", "turn", "source", (F.col("turn") == F.col("last")).alias("is_last"))


@plan("xt13_prompt_activation", "SELECT p_brand, p_partkey, CASE WHEN p_partkey = max(p_partkey) FILTER (p_size > 25) OVER (PARTITION BY p_brand) THEN 'active' WHEN p_size > 25 OR p_size < 5 THEN 'archived' ELSE 'draft' END AS status FROM part")
def _(spark, d):
    from pyspark.sql import Window

    newest = F.max(F.when(F.col("p_size") > 25, F.col("p_partkey"))).over(Window.partitionBy("p_brand"))
    status = F.when(F.col("p_partkey") == newest, "active").when((F.col("p_size") > 25) | (F.col("p_size") < 5), "archived").otherwise("draft")
    return S.table(spark, d, "part").select("p_brand", "p_partkey", status.alias("status"))


@plan("wk3_leading_chunks", f"{S.cte('chunks')} SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER w AS n, sum(length(content) + length(heading_path) + 16) OVER w AS s FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR s <= 4000")
def _(spark, d):
    from docgrain.operators.lexicon import leading_chunks

    return leading_chunks(S.chunks(spark, d), 4000).select("chunk_id")


@plan("gv1_governance_queue", f"{S.cte('chunks')} SELECT chunk_id FROM chunks WHERE governance_weight IS NULL AND is_latest AND tenant_id = 'main' ORDER BY document_id, chunk_id LIMIT 50")
def _(spark, d):
    return S.chunks(spark, d).where("governance_weight IS NULL AND is_latest AND tenant_id = 'main'").orderBy("document_id", "chunk_id").limit(50).select("chunk_id")
