"""Hybrid retrieval in batches: three recalls, fusion, scores, gate, expansion, rounds, routing."""

from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import acl, expand, postings, recall
from docgrain.operators.rows import fresh_path, size_checked, staged, top
from docgrain.sources import substrate as S

from ._registry import plan

PATHS = ("vector", "fts", "likes")

# The stages as SQL, each on top of the ones before.
_HEAD = S.cte("chunks", "principals", "visible", "questions")
_SQL = {
    "vec": """pairs AS (SELECT q.query_id, v.chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], qe.embedding::DOUBLE[]) AS c FROM questions q JOIN embeddings qe ON qe.vec_id = q.query_id JOIN visible v USING (principal_id) JOIN embeddings e ON e.vec_id = v.chunk_id),
vec AS (SELECT * FROM (SELECT query_id, chunk_id, round(c, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, chunk_id)::INTEGER AS rank FROM pairs) WHERE rank <= 50)""",
    "fts": """toks AS (SELECT query_id, principal_id, unnest(list_slice(l, 1, 24)) AS token FROM (SELECT query_id, principal_id, list_distinct_ordered AS l FROM (SELECT query_id, principal_id, list_filter(x, lambda t, i: list_position(x, t) = i) AS list_distinct_ordered FROM (SELECT *, regexp_extract_all(lower(question), '[A-Za-z0-9_]{2,}') AS x FROM questions)))),
posts AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(content), '[A-Za-z0-9_]{2,}')) AS token FROM chunks),
fts AS (SELECT * FROM (SELECT query_id, chunk_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id)::INTEGER AS rank FROM toks JOIN posts USING (token) JOIN visible USING (principal_id, chunk_id) GROUP BY 1, 2) WHERE rank <= 50)""",
    "likes": """words AS (SELECT query_id, principal_id, token, row_number() OVER (PARTITION BY query_id ORDER BY length(token) DESC, pos) AS n FROM (SELECT query_id, principal_id, token, min(pos) AS pos FROM (SELECT query_id, principal_id, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(question), '[A-Za-z0-9_]{2,}') AS x FROM questions)) WHERE length(token) >= 4 OR contains(token, '_') GROUP BY 1, 2, 3)),
terms AS (SELECT query_id, principal_id, array_agg(token ORDER BY n) AS terms FROM words WHERE n <= 3 GROUP BY 1, 2),
likes AS (SELECT * FROM (SELECT query_id, chunk_id, place, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id)::INTEGER AS rank FROM (SELECT query_id, chunk_id, least(CASE WHEN strpos(lower(content), terms[1]) > 0 THEN strpos(lower(content), terms[1]) ELSE 2147483647 END, CASE WHEN strpos(lower(heading_path), terms[1]) > 0 THEN strpos(lower(heading_path), terms[1]) ELSE 2147483647 END)::INTEGER AS place
  FROM terms JOIN visible USING (principal_id) WHERE len(list_filter(terms, lambda t: contains(lower(content), t) OR contains(lower(heading_path), t))) > 0)) WHERE rank <= 50)""",
    "fused": """lists AS (SELECT query_id, chunk_id, rank, 0 AS path FROM vec UNION ALL SELECT query_id, chunk_id, rank, 1 FROM fts UNION ALL SELECT query_id, chunk_id, rank, 2 FROM likes),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(path) AS first_path, bool_or(path = 0) AS vector, bool_or(path = 1) AS fts, bool_or(path = 2) AS likes FROM lists GROUP BY 1, 2)""",
    "cands": "cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_path, chunk_id) AS n FROM fused) WHERE n <= 50)",
    "served": """served AS (SELECT * FROM (SELECT c.query_id, c.chunk_id, rrf, vector, fts, likes, final_score, row_number() OVER (PARTITION BY c.query_id ORDER BY final_score DESC, rrf DESC, c.chunk_id)::INTEGER AS rank FROM (
  SELECT cands.*, round(coalesce(vec.score, 0) + coalesce(governance_weight, 0) * 0.001::DOUBLE, 6) AS final_score FROM cands LEFT JOIN vec USING (query_id, chunk_id) JOIN chunks USING (chunk_id)) c) WHERE rank <= 8)""",
    "hits": "hits AS (SELECT query_id, q.principal_id, s.chunk_id, s.rank, s.final_score FROM served s JOIN questions q USING (query_id))",
}
_ORDER = list(_SQL)


def _with(last: str) -> str:
    return _HEAD + ",\n" + ",\n".join(_SQL[k] for k in _ORDER[: _ORDER.index(last) + 1])


def readable(spark, d, vectors=False):
    return acl.secured(S.chunks(spark, d, vectors), S.principals(spark))


def pairs(spark, d):
    """(principal_id, chunk_id) of all that may be read, staged once for the three recalls."""
    return staged(readable(spark, d).select("principal_id", "chunk_id"))


def vector(spark, d, seen=None):
    rows = readable(spark, d, True) if seen is None else S.chunk_vectors(spark, d).join(seen, "chunk_id")
    return recall.vector_recall(rows, S.with_query_vectors(S.questions(spark, d), spark, d), S.DIM)


def index(spark, d):
    """The stored inverted index of the chunks, which every search of a session reads."""
    return postings.stored(spark, f"{d}/documents.parquet", T.index_tokens(F.lower("content")), lambda: S.chunks(spark, d))


def fts(spark, d, seen=None):
    terms = staged(recall.match_terms(S.questions(spark, d), T.match_items(F.lower("question"))))
    return recall.text_recall(index(spark, d).asked(readable(spark, d) if seen is None else seen, terms), terms)


def substring(spark, d, seen=None):
    return recall.substring_recall(S.chunks(spark, d), readable(spark, d) if seen is None else seen, S.questions(spark, d), T.substring_terms(F.lower("question")))


def lists(spark, d):
    """The ranked lists, each staged once, as several steps read them."""
    seen = pairs(spark, d)
    return {"vector": staged(vector(spark, d, seen)), "fts": staged(fts(spark, d, seen)), "likes": staged(substring(spark, d, seen))}


def served(spark, d):
    found = lists(spark, d)
    return staged(recall.served(recall.candidates(recall.fused(found)), found["vector"], S.chunks(spark, d)))


def hits(spark, d):
    return served(spark, d).join(size_checked(S.questions(spark, d).select("query_id", "principal_id")), "query_id").select("query_id", "principal_id", "chunk_id", "rank", "final_score")


@plan("rt1_vector_recall", f"{_with('vec')} SELECT query_id, chunk_id, score, rank FROM vec")
def _(spark, d):
    return vector(spark, d)


@plan("rt2_text_recall", f"{_with('fts')} SELECT query_id, chunk_id, score, rank FROM fts")
def _(spark, d):
    return fts(spark, d)


@plan("rt2_updated_index", f"""{S.cte('chunks')}, t AS (SELECT DISTINCT document_id, chunk_id, unnest(regexp_extract_all(lower(content), '[A-Za-z0-9_]{{2,}}')) AS token FROM chunks WHERE document_id % 7 <> 0 AND document_id % 11 <> 0)
SELECT document_id, count(*) AS postings, count(DISTINCT token) AS tokens, sum(chunk_id)::BIGINT AS chunk_sum FROM t GROUP BY document_id""")
def _(spark, d):
    now, doc = S.chunks(spark, d), F.col("document_id")
    before = now.where(doc % 5 != 4).withColumn("content", F.when(doc % 3 == 0, F.reverse("content")).otherwise(F.col("content")))
    action = F.when(doc % 7 == 0, "retired").when(doc % 5 == 4, "new").when(doc % 3 == 0, "changed").otherwise("unchanged")
    made = postings.PostingIndex(spark, fresh_path(spark, "postings"), T.index_tokens(F.lower("content")))
    made.replace("first", before)
    for _ in range(2):  # a repeated job changes nothing
        made.synced("sync", now.select("document_id", action.alias("action")).distinct(), now)
    made.replace("purge", gone=now.where(doc % 11 == 0).select("document_id").distinct())
    return made.postings().groupBy("document_id").agg(F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"), F.sum("chunk_id").alias("chunk_sum"))


@plan("rt3_substring_recall", f"{_with('likes')} SELECT query_id, chunk_id, place, rank FROM likes")
def _(spark, d):
    return substring(spark, d)


@plan("rt4_rrf", f"{_with('fused')} SELECT query_id, chunk_id, rrf FROM fused")
def _(spark, d):
    return recall.fused(lists(spark, d)).select("query_id", "chunk_id", "rrf")


@plan("rt5_candidates", f"{_with('cands')} SELECT query_id, chunk_id, rrf FROM cands")
def _(spark, d):
    return recall.candidates(recall.fused(lists(spark, d))).select("query_id", "chunk_id", "rrf")


@plan("rt7_final_score", f"{_with('cands')} SELECT query_id, chunk_id, round(coalesce(vec.score, 0) + coalesce(governance_weight, 0) * 0.001::DOUBLE, 6) AS final_score FROM cands LEFT JOIN vec USING (query_id, chunk_id) JOIN chunks USING (chunk_id)")
def _(spark, d):
    found = lists(spark, d)
    return recall.served(recall.candidates(recall.fused(found)), found["vector"], S.chunks(spark, d), n=recall.RECALL).select("query_id", "chunk_id", "final_score")


@plan("rt8_top_served", f"{_with('served')} SELECT query_id, chunk_id, final_score, rank FROM served")
def _(spark, d):
    return served(spark, d).select("query_id", "chunk_id", "final_score", "rank")


_GATE = """SELECT q.query_id, CASE WHEN len(p.kbs) = 0 THEN NULL ELSE top1 END AS top1, CASE WHEN len(p.kbs) = 0 THEN 'NO_AUTHORIZED_KB' WHEN coalesce(top1, -1) < 0.5 THEN 'NO_RELEVANT_CONTENT' ELSE 'OK' END AS status
FROM questions q JOIN principals p USING (principal_id) LEFT JOIN (SELECT query_id, max(final_score) AS top1 FROM served GROUP BY 1) USING (query_id)"""


@plan("rt9_threshold_gate", f"{_with('served')} {_GATE}")
def _(spark, d):
    return recall.gate(S.questions(spark, d), served(spark, d), S.principals(spark))


@plan("rt10_empty_scope", f"{_HEAD} SELECT query_id FROM questions JOIN principals USING (principal_id) WHERE len(kbs) = 0")
def _(spark, d):
    empty = S.principals(spark).where(F.size("kbs") == 0).select("principal_id")
    return S.questions(spark, d).join(size_checked(empty), "principal_id").select("query_id")


@plan("search_hybrid", f"{_with('served')}, gate AS ({_GATE}) SELECT query_id, chunk_id, final_score, rrf, rank, status FROM gate LEFT JOIN (SELECT query_id, chunk_id, final_score, rrf, rank FROM served) USING (query_id)")
def search_hybrid(spark, d):
    rows = served(spark, d)
    verdict = recall.gate(S.questions(spark, d), rows, S.principals(spark)).select("query_id", "status")
    return verdict.join(rows.select("query_id", "chunk_id", "final_score", "rrf", "rank"), "query_id", "left")


# A knowledge base is one document of short chunks with one table and a section for each language, so that a question's hits share them.
_GROUPED = """grouped AS (SELECT * REPLACE (substr(kb_id, 4)::BIGINT AS document_id, split_part(heading_path, '/', 1) AS heading_path, CASE WHEN chunk_id % 2 = 0 THEN 'g' || kb_id END AS table_group_id, greatest(1, length(content) // 8)::INTEGER AS token_count, chunk_id AS chunk_index) FROM visible)"""


def grouped(spark, d):
    rows = readable(spark, d).withColumn("document_id", F.substring("kb_id", 4, 9).cast("long")).withColumn("heading_path", F.split_part("heading_path", F.lit("/"), F.lit(1)))
    rows = rows.withColumn("table_group_id", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("g"), "kb_id"))).withColumn("chunk_index", F.col("chunk_id"))
    return rows.withColumn("token_count", F.greatest(F.lit(1), F.floor(F.length("content") / 8)).cast("int"))


_REST = """{head}, {grouped}, g AS (SELECT DISTINCT h.query_id, h.principal_id, v.table_group_id FROM hits h JOIN grouped v USING (principal_id, chunk_id) WHERE v.table_group_id IS NOT NULL),
r AS (SELECT g.query_id, g.table_group_id, v.chunk_id, v.chunk_index, row_number() OVER w AS n, sum(v.token_count) OVER w AS s FROM g JOIN grouped v USING (principal_id, table_group_id) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = g.query_id AND h.chunk_id = v.chunk_id) WINDOW w AS (PARTITION BY g.query_id, g.table_group_id ORDER BY v.chunk_index, v.chunk_id ROWS UNBOUNDED PRECEDING))
SELECT query_id, table_group_id, chunk_id, chunk_index FROM r WHERE n <= 3 AND s <= 2048"""


@plan("rt11_table_rest", _REST.format(head=_with("hits"), grouped=_GROUPED))
def _(spark, d):
    return expand.table_rest(hits(spark, d), grouped(spark, d))


_SECTION = """{head}, {grouped}, sec AS (SELECT h.query_id, h.principal_id, v.document_id, v.heading_path, min(h.rank) AS section FROM hits h JOIN grouped v USING (principal_id, chunk_id) WHERE v.table_group_id IS NULL AND length(trim(v.heading_path)) >= 2 GROUP BY 1, 2, 3, 4),
c AS (SELECT * FROM (SELECT s.query_id, s.section, v.chunk_index, v.chunk_id, v.token_count, row_number() OVER (PARTITION BY s.query_id, s.section ORDER BY v.chunk_index, v.chunk_id) AS k FROM sec s JOIN grouped v USING (principal_id, document_id, heading_path) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = s.query_id AND h.chunk_id = v.chunk_id)) WHERE k <= 3),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, chunk_index, chunk_id) AS i FROM c),
f AS (SELECT query_id, 0::BIGINT AS i, 1200::BIGINT AS left_, -1::BIGINT AS section, false AS stopped, NULL::BIGINT AS chunk_id, false AS took FROM (SELECT DISTINCT query_id FROM l)
  UNION ALL SELECT l.query_id, l.i, CASE WHEN NOT (f.section = l.section AND f.stopped) AND l.token_count <= f.left_ THEN f.left_ - l.token_count ELSE f.left_ END, l.section, (f.section = l.section AND f.stopped) OR l.token_count > f.left_, l.chunk_id, NOT (f.section = l.section AND f.stopped) AND l.token_count <= f.left_ FROM f JOIN l ON l.query_id = f.query_id AND l.i = f.i + 1)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INTEGER AS place FROM f WHERE took"""


@plan("rt12_section_rest", _SECTION.format(head=_with("hits").replace("WITH ", "WITH RECURSIVE ", 1), grouped=_GROUPED))
def _(spark, d):
    return expand.section_rest(hits(spark, d), grouped(spark, d))


_STATS = ", ".join(f"count(*) FILTER ({p}) AS {p}_covered, count(*) FILTER ({p} AND NOT ({' OR '.join(q for q in PATHS if q != p)})) AS {p}_unique" for p in PATHS)


@plan("rt13_path_stats", f"{_with('served')} SELECT query_id, {_STATS} FROM served GROUP BY query_id")
def _(spark, d):
    return recall.path_stats(served(spark, d), list(PATHS))


@plan("rt14_subquestions", r"""WITH q AS (SELECT item_id, text AS original, ['', regexp_replace(text, '\s+', '  ', 'g'), substr(text, 1, 40), substr(text, 1, 40), substr(text, 20, 60), substr(text, 30, 60)] AS parts FROM benchmark),
e AS (SELECT item_id, unnest([original] || parts) AS s, generate_subscripts([original] || parts, 1) AS i FROM q), c AS (SELECT item_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s, i FROM e),
k AS (SELECT item_id, s, min(i) AS i FROM c WHERE i = 1 OR (s <> '' AND length(s) <= 120) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM k)
SELECT item_id, n::INTEGER AS n, s AS question FROM r WHERE n <= 3""")
def _(spark, d):
    q = F.col("text")
    parts = F.array(F.lit(""), F.regexp_replace(q, r"\s+", "  "), F.substring(q, 1, 40), F.substring(q, 1, 40), F.substring(q, 20, 60), F.substring(q, 30, 60))
    out = S.table(spark, d, "benchmark").select("item_id", F.posexplode(recall.clean_subquestions(parts, q)).alias("n", "question"))
    return out.select("item_id", (F.col("n") + 1).alias("n"), "question")


# Rounds: each path's first rows stand for a round's served rows.
_ROUNDS = "rounds AS (SELECT query_id, 0 AS round, rank, chunk_id, score AS final_score FROM vec WHERE rank <= 8 UNION ALL SELECT query_id, 1, rank, chunk_id, round(score / 40.0::DOUBLE, 6) FROM fts WHERE rank <= 8)"


def rounds(spark, d):
    one = vector(spark, d).where("rank <= 8").select("query_id", F.lit(0).alias("round"), "rank", "chunk_id", F.col("score").alias("final_score"))
    two = fts(spark, d).where("rank <= 8").select("query_id", F.lit(1).alias("round"), "rank", "chunk_id", F.round(F.col("score") / 40.0, 6).alias("final_score"))
    return one.unionByName(two)


@plan("rt15_merged_rounds", f"""{_with('fts')}, {_ROUNDS}, m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(final_score) AS final_score, min((round, rank)) AS first FROM rounds GROUP BY 1, 2)
SELECT query_id, chunk_id, rrf, final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, chunk_id)::INTEGER AS rank FROM m WHERE query_id IN (SELECT query_id FROM m GROUP BY 1 HAVING max(final_score) >= 0.5)) WHERE rank <= 8""")
def _(spark, d):
    return recall.merged_rounds(rounds(spark, d))


_SIDES = "sides AS (SELECT query_id, 0 AS class, rank AS pos, chunk_id FROM vec WHERE rank <= 8 UNION ALL SELECT query_id, 1, rank, chunk_id FROM fts WHERE rank <= 5 UNION ALL SELECT query_id, 2, rank, chunk_id FROM likes WHERE rank <= 5)"


def sides(spark, d):
    parts = [(vector, 8), (fts, 5), (substring, 5)]
    rows = [f(spark, d).where(F.col("rank") <= n).select("query_id", F.lit(i).alias("class"), F.col("rank").alias("pos"), "chunk_id") for i, (f, n) in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan("rt16_exclusive_lists", f"{_with('likes')}, {_SIDES} SELECT query_id, class, pos, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY class, pos) AS n FROM sides) WHERE n = 1")
def _(spark, d):
    return recall.exclusive(sides(spark, d))


@plan("rt17_context_order", f"{_with('likes')}, {_SIDES} SELECT query_id, class, pos, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY class, pos, chunk_id)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY class, pos) AS k FROM sides) WHERE k = 1")
def _(spark, d):
    return recall.numbered_context(recall.exclusive(sides(spark, d)))


@plan("st1_first_path_wins", f"{_with('likes')}, {_SIDES} SELECT query_id, chunk_id, min(class) AS path FROM sides GROUP BY 1, 2")
def _(spark, d):
    return recall.exclusive(sides(spark, d)).select("query_id", "chunk_id", F.col("class").alias("path"))


@plan("st3_shared_and_unique", f"{_with('fts')} SELECT query_id, count(*) FILTER (v AND f) AS shared, count(*) FILTER (v AND NOT f) AS only_vector FROM (SELECT query_id, chunk_id, bool_or(p = 0) AS v, bool_or(p = 1) AS f FROM (SELECT query_id, chunk_id, 0 AS p FROM vec UNION ALL SELECT query_id, chunk_id, 1 FROM fts) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    rows = recall.fused({"vector": vector(spark, d), "fts": fts(spark, d)})
    return rows.groupBy("query_id").agg(F.count_if(F.col("vector") & F.col("fts")).alias("shared"), F.count_if(F.col("vector") & ~F.col("fts")).alias("only_vector"))


@plan("wn1_rank_in_list", f"{_with('vec')} SELECT query_id, rank, chunk_id FROM vec WHERE rank <= 10")
def _(spark, d):
    return top(vector(spark, d).drop("rank"), ["query_id"], [F.desc("score"), F.col("chunk_id")], 10, "rank").select("query_id", "rank", "chunk_id")


@plan("rt18_route", """WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE (conv_id * 7 + turn * 13) % 101 END AS score, conv_id % 3 = 0 AS rewritten, turn > 1 AS has_history FROM conversations)
SELECT conv_id, turn, CASE WHEN score IS NOT NULL AND score < 70 AND NOT rewritten AND NOT has_history THEN 'clarify' WHEN score IS NOT NULL AND score < 90 THEN 'chain' ELSE 'direct' END AS route FROM s""")
def _(spark, d):
    score = F.when(F.col("turn") % 5 != 4, (F.col("conv_id") * 7 + F.col("turn") * 13) % 101)
    return S.table(spark, d, "conversations").select("conv_id", "turn", recall.route(score, F.col("conv_id") % 3 == 0, F.col("turn") > 1).alias("route"))


@plan("rt19_side_routes", f"{_with('served')} SELECT query_id, NOT (max(final_score) >= 0.7 AND count(*) >= 8) AS use_graph, count(*) FILTER (likes) < 3 AS use_wiki FROM served GROUP BY query_id")
def _(spark, d):
    rows = served(spark, d).groupBy("query_id").agg(F.max("final_score").alias("top1"), F.count("*").alias("n"), F.count_if("likes").alias("terms"))
    return rows.select("query_id", (~((F.col("top1") >= 0.7) & (F.col("n") >= 8))).alias("use_graph"), (F.col("terms") < 3).alias("use_wiki"))


@plan("xt17_retry_eligible", f"{_with('served')} SELECT query_id, count(*) >= 3 AND max(final_score) >= 0.7 AS eligible FROM served GROUP BY query_id")
def _(spark, d):
    return served(spark, d).groupBy("query_id").agg(((F.count("*") >= 3) & (F.max("final_score") >= 0.7)).alias("eligible"))


@plan("sl2_top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
