"""Scans and predicates: visibility gates, path rules, filters of audit records and messages."""

from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import acl
from docgrain.sources import substrate as S

from ._registry import plan

_VISIBLE = S.cte("chunks", "principals", "visible")
_CHUNKS = S.cte("chunks")
_AUDIT = S.cte("audit")
_SUBJECTS = ("public", "user:0", "group:1")


def _array():
    return F.array(*[F.lit(s) for s in _SUBJECTS])


_SQL_ARRAY = "['public', 'user:0', 'group:1']"


@plan("sc1_secured_scan", f"{_VISIBLE} SELECT principal_id, chunk_id, kb_id, heading_path, level_rank FROM visible")
def _(spark, d):
    return acl.secured(S.chunks(spark, d), S.principals(spark)).select("principal_id", "chunk_id", "kb_id", "heading_path", "level_rank")


@plan("fl1_clearance_gate", f"{_CHUNKS} SELECT chunk_id FROM chunks WHERE level_rank <= 20")
def _(spark, d):
    return S.chunks(spark, d).where(acl.clearance_gate(F.lit(20))).select("chunk_id")


@plan("fl2_kb_gate", f"{_CHUNKS} SELECT chunk_id, kb_id FROM chunks WHERE kb_id IN ('src1', 'src2', 'src7')")
def _(spark, d):
    return S.chunks(spark, d).where(F.col("kb_id").isin("src1", "src2", "src7")).select("chunk_id", "kb_id")


@plan("fl3_deny_gate", f"{_CHUNKS} SELECT chunk_id FROM chunks WHERE NOT list_has_any(deny_subjects, {_SQL_ARRAY})")
def _(spark, d):
    return S.chunks(spark, d).where(acl.deny_gate(_array())).select("chunk_id")


@plan("fl4_tag_gate", f"{_CHUNKS} SELECT chunk_id FROM chunks WHERE list_has_any(acl_tags, {_SQL_ARRAY})")
def _(spark, d):
    return S.chunks(spark, d).where(acl.tag_gate(_array())).select("chunk_id")


@plan("fl5_visibility", f"{_VISIBLE} SELECT principal_id, count(*) AS n, min(chunk_id) AS first, max(level_rank) AS top_level FROM visible GROUP BY principal_id")
def _(spark, d):
    seen = acl.secured(S.chunks(spark, d), S.principals(spark))
    return seen.groupBy("principal_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.max("level_rank").alias("top_level"))


_FULL = """{head}, v AS (SELECT p.principal_id, c.document_id, bool_and(p.clearance >= 40 OR (c.level_rank <= p.clearance AND NOT list_has_any(c.deny_subjects, p.subjects) AND list_has_any(c.acl_tags, p.subjects))) AS ok
FROM principals p, chunks c WHERE c.is_latest GROUP BY 1, 2) SELECT {cols} FROM v WHERE ok{more}"""


@plan("fl6_admin_bypass", _FULL.format(head=S.cte("chunks", "principals"), cols="document_id", more=" AND principal_id = 1"))
def _(spark, d):
    return acl.fully_visible_documents(S.chunks(spark, d), S.principals(spark).where("principal_id = 1")).select("document_id")


@plan("fl7_fully_visible_documents", _FULL.format(head=S.cte("chunks", "principals"), cols="principal_id, document_id", more=""))
def _(spark, d):
    return acl.fully_visible_documents(S.chunks(spark, d), S.principals(spark))


@plan("fl8_content_regex", f"{_CHUNKS} SELECT chunk_id FROM chunks WHERE regexp_matches(content, '(?i)tionha|schein') OR regexp_matches(heading_path, '(?i)tionha|schein')")
def _(spark, d):
    pattern = F.lit("(?i)tionha|schein")
    return S.chunks(spark, d).where(F.rlike("content", pattern) | F.rlike("heading_path", pattern)).select("chunk_id")


@plan("fl9_action_prefix", f"{_AUDIT} SELECT event_id, action FROM audit WHERE starts_with(action, 's')")
def _(spark, d):
    return S.events(spark, d).where(F.startswith("action", F.lit("s"))).select("event_id", "action")


@plan("fl10_date_range", f"{_AUDIT} SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM audit WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-08' + 1")
def _(spark, d):
    inside = (F.col("ts") >= F.lit("2024-01-05").cast("date")) & (F.col("ts") < F.date_add(F.lit("2024-01-08").cast("date"), 1))
    return S.events(spark, d).where(inside).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@plan("fl11_keyword_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('GeAr'))")
def _(spark, d):
    return S.table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("GeAr")))).select("p_partkey", "p_name")


@plan("fl12_one_profile", "SELECT vec_id FROM embeddings WHERE label % 2 = 0 AND embedding IS NOT NULL")
def _(spark, d):
    return S.vectors(spark, d).where("label % 2 = 0 AND embedding IS NOT NULL").select("vec_id")


@plan("fl13_json_predicate", f"{_AUDIT} SELECT event_id FROM audit WHERE (props->>'$.k')::INTEGER >= 90")
def _(spark, d):
    return S.events(spark, d).where(F.get_json_object("props", "$.k").cast("int") >= 90).select("event_id")


@plan("fl14_no_placeholders", "SELECT conv_id, turn FROM conversations WHERE (CASE WHEN turn % 4 = 3 THEN 'true' WHEN turn % 4 = 1 THEN 'false' END)::BOOLEAN IS DISTINCT FROM true")
def _(spark, d):
    meta = F.when(F.col("turn") % 4 == 3, '{"generating": true}').when(F.col("turn") % 4 == 1, '{"generating": false}')
    generating = F.get_json_object(meta, "$.generating").cast("boolean")
    return S.table(spark, d, "conversations").where(~generating.eqNullSafe(F.lit(True))).select("conv_id", "turn")


@plan("fl15_stale_profile", "SELECT vec_id FROM embeddings WHERE label % 3 <> 0 OR vec_id % 5 = 0")
def _(spark, d):
    rows = S.vectors(spark, d).select("vec_id", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"), F.when(F.col("vec_id") % 5 == 0, "v1").otherwise("v2").alias("version"))
    return rows.where((F.col("model") != "m0") | (F.col("version") != "v2")).select("vec_id")


@plan("fl16_path_rules", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE NOT (starts_with(path, '/fr/') OR starts_with(path, '/en/7')) AND (starts_with(path, '/en/') OR starts_with(path, '/de/'))""")
def _(spark, d):
    from docgrain.sources.web import in_scope

    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")
    return S.table(spark, d, "pages").select("page_id", path).where(in_scope(F.col("path"), ["/en/", "/de/"], ["/fr/", "/en/7"]))


@plan("fl17_acceptable_terms", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark UNION SELECT unnest(['什么', '令牌', '访问令牌', '税', 'a_b', '____', '12 34'])) 
SELECT term FROM t WHERE length(term) BETWEEN 1 AND 12 AND term NOT IN ('什么', '的', '如何') AND regexp_replace(term, '[_\- 0-9]', '', 'g') <> '' AND (length(term) >= CASE WHEN regexp_full_match(term, '[㐀-䶿一-鿿]+') THEN 2 ELSE 4 END OR (NOT regexp_full_match(term, '[㐀-䶿一-鿿]+') AND contains(term, '_')))""")
def _(spark, d):
    from docgrain.operators.lexicon import acceptable

    words = S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("term"))
    more = spark.createDataFrame([(w,) for w in ("什么", "令牌", "访问令牌", "税", "a_b", "____", "12 34")], "term string")
    return words.union(more).distinct().where(acceptable(F.col("term")))


@plan("fl18_memory_filter", """WITH t AS (SELECT conv_id, turn, trim(substr(text, 1, (conv_id % 9 * 10)::INTEGER)) AS fact FROM conversations)
SELECT conv_id, turn, CASE WHEN length(fact) < 4 THEN 'too_short' WHEN length(fact) > 60 THEN 'too_long_fragment' WHEN regexp_matches(fact, '\\[\\d+\\]|NO_RELEVANT_CONTENT|CONFIDENTIAL|SECRET|grant_kb|acl_tags|deny_subjects|level_rank') THEN 'blocked_pattern' END AS reason FROM t""")
def _(spark, d):
    fact = F.substring(F.col("text"), F.lit(1), (F.col("conv_id") % 9 * 10).cast("int"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.memory_block_reason(fact).alias("reason"))
