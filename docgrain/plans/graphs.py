"""Property graph, lexicon and wiki operators."""

from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import acl, graph, lexicon
from docgrain.operators.rows import top
from docgrain.sources import substrate as S

from ._registry import case, plan

_VISIBLE = S.cte("chunks", "principals", "visible")
# Parts supply suppliers: a directed graph; suppliers (100000 and up) lead back to few parts.
_REL = "rel AS (SELECT src, dst, count(*) AS support FROM (SELECT l_partkey AS src, 100000 + l_suppkey AS dst FROM lineitem UNION ALL SELECT 100000 + l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2)"
_SEEDS = "seeds AS (SELECT item_id AS query_id, (item_id % 3)::INTEGER AS principal_id, item_id * 3 + 1 AS entity_id FROM benchmark)"
_WALK = """walk AS (SELECT query_id, entity_id, 1 AS hop, 0::BIGINT AS weight, [entity_id] AS path FROM seeds UNION ALL SELECT w.query_id, r.dst, w.hop + 1, w.weight + r.support, list_append(w.path, r.dst) FROM walk w JOIN rel r ON r.src = w.entity_id WHERE w.hop < {hops} AND NOT list_contains(w.path, r.dst)),
agg AS (SELECT query_id, entity_id, min(hop)::INTEGER AS hop, sum(weight)::BIGINT AS weight FROM walk GROUP BY 1, 2)"""
_MENTIONS = "ment AS (SELECT DISTINCT 100000 + l_suppkey AS entity_id, l_orderkey AS chunk_id FROM lineitem UNION SELECT l_partkey, l_orderkey FROM lineitem)"


def relations(spark, d):
    line = S.table(spark, d, "lineitem")
    down = line.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"))
    back = line.where("l_returnflag = 'R'").select((F.col("l_suppkey") + 100000).alias("src"), F.col("l_partkey").alias("dst"))
    return down.union(back).groupBy("src", "dst").agg(F.count("*").alias("support"))


def seeds(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).cast("int").alias("principal_id"), (F.col("item_id") * 3 + 1).alias("entity_id"))


def mentions(spark, d):
    line = S.table(spark, d, "lineitem")
    return line.select((F.col("l_suppkey") + 100000).alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).union(line.select("l_partkey", "l_orderkey")).distinct()


def found(spark, d):
    reached = graph.expand(seeds(spark, d), relations(spark, d)).join(seeds(spark, d).select("query_id", "principal_id"), "query_id")
    return graph.neighbours(reached, mentions(spark, d), acl.secured(S.chunks(spark, d), S.principals(spark)))


@plan("st4_recursive_union", f"WITH RECURSIVE {_REL}, {_SEEDS}, {_WALK.format(hops=3)} SELECT query_id, entity_id, hop, weight FROM agg")
def _(spark, d):
    return graph.expand(seeds(spark, d), relations(spark, d), 3)


_NEAR = f"{_VISIBLE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_REL}, {_SEEDS}, {_WALK.format(hops=2)}, {_MENTIONS}, near AS (SELECT query_id, chunk_id, hop, weight, row_number() OVER (PARTITION BY query_id ORDER BY hop, weight DESC, chunk_id)::INTEGER AS rank FROM (SELECT s.query_id, v.chunk_id, min(a.hop) AS hop, sum(a.weight)::BIGINT AS weight FROM agg a JOIN seeds s ON s.query_id = a.query_id JOIN ment m ON m.entity_id = a.entity_id JOIN visible v ON v.chunk_id = m.chunk_id AND v.principal_id = s.principal_id GROUP BY 1, 2))"


@plan("gr6_neighbours", f"{_NEAR} SELECT * FROM near WHERE rank <= 10")
def _(spark, d):
    return found(spark, d)


@plan("sl4_neighbour_order", f"{_NEAR} SELECT query_id, rank, chunk_id FROM near WHERE rank <= 3")
def _(spark, d):
    return found(spark, d).where("rank <= 3").select("query_id", "rank", "chunk_id")


@plan("gr7_graph_budget", f"{_NEAR}, h AS (SELECT * FROM near WHERE rank <= 10 AND chunk_id % 5 <> 0), b AS (SELECT h.query_id, h.chunk_id, row_number() OVER w AS n, sum(token_count) OVER w AS s FROM h JOIN chunks USING (chunk_id) WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) SELECT query_id, chunk_id FROM b WHERE n <= 3 AND s <= 1200")
def _(spark, d):
    rows = found(spark, d)
    return graph.graph_chunks(rows, rows.where("chunk_id % 5 = 0"), S.chunks(spark, d)).select("query_id", "chunk_id")


@plan("gr8_graph_contribution", f"{_NEAR} SELECT query_id, count(*) FILTER (chunk_id % 5 = 0) AS graph_covered, count(*) FILTER (chunk_id % 5 <> 0) AS graph_unique FROM near WHERE rank <= 10 GROUP BY query_id")
def _(spark, d):
    return found(spark, d).groupBy("query_id").agg(F.count_if(F.col("chunk_id") % 5 == 0).alias("graph_covered"), F.count_if(F.col("chunk_id") % 5 != 0).alias("graph_unique"))


@plan("gr1_entity_upsert", "SELECT p_brand AS kb, p_size AS name_key, coalesce(max_by(p_name, p_partkey) FILTER (p_partkey % 2 = 1), max_by(p_name, p_partkey)) AS name FROM part GROUP BY 1, 2")
def _(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_brand").alias("kb"), F.col("p_size").alias("name_key"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    old = top(rows.where("seq % 2 = 0"), ["kb", "name_key"], [F.desc("seq")], 1).drop("seq")
    return graph.upsert(old, rows.where("seq % 2 = 1"), ["kb", "name_key"], "seq")


@plan("gr2_mention_insert", "SELECT l_orderkey AS chunk_id, l_partkey AS entity_id, min(CASE WHEN l_returnflag = 'A' THEN 'old' ELSE 'new' END) = 'new' AND count(*) FILTER (l_returnflag = 'A') = 0 AS is_new FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"), "l_returnflag")
    old = rows.where("l_returnflag = 'A'").select("chunk_id", "entity_id", F.lit(False).alias("is_new")).distinct()
    new = rows.where("l_returnflag <> 'A'").select("chunk_id", "entity_id", F.lit(True).alias("is_new"))
    return graph.insert_missing(old, new, ["chunk_id", "entity_id"])


@plan("gr3_relation_upsert", "WITH n AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS support FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey <> l_suppkey GROUP BY 1, 2), o AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS support FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, coalesce(n.support, o.support) AS support FROM o FULL JOIN n ON n.src = o.src AND n.dst = o.dst")
def _(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag", F.lit("r").alias("relation"))
    old = rows.where("l_returnflag = 'A'").groupBy("src", "dst").agg(F.count("*").alias("support"))
    new = graph.relation_support(rows.where("l_returnflag <> 'A'")).drop("relation").withColumn("seq", F.lit(1))
    return graph.upsert(old, new, ["src", "dst"], "seq")


@plan("gr4_delete_documents", "SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS doc_freq FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1")
def _(spark, d):
    line = S.table(spark, d, "lineitem")
    ments = line.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("document_id"))
    gone = S.table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("document_id"))
    entities = S.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.lit(0).alias("doc_freq"))
    left, _, _ = graph.without_documents(entities, ments, ments, gone)
    return left


_LINKS = "keys AS (SELECT DISTINCT item_id AS query_id, unnest([lower(p_name), split_part(lower(p_name), ' ', 1), split_part(lower(p_name), ' ', 2)]) AS key FROM benchmark JOIN part ON p_partkey = item_id + 1), ent AS (SELECT p_partkey AS entity_id, lower(p_name) AS name_key FROM part)"


@plan("gr5_seed_linking", f"""WITH {_LINKS}, s AS (SELECT query_id, entity_id, name_key, max(CASE WHEN name_key = key THEN 1.0 WHEN starts_with(name_key, key) THEN 0.6 ELSE 0.3 END::DOUBLE) AS score FROM keys JOIN ent ON contains(name_key, key) GROUP BY 1, 2, 3)
SELECT query_id, entity_id, name_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name_key, entity_id) AS n FROM s) WHERE n <= 8""")
def _(spark, d):
    asked = S.table(spark, d, "benchmark")
    names = S.table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.lower("p_name").alias("term"))
    asked = asked.join(names, asked.item_id + 1 == names.document_id)
    words = F.split("term", " ")
    keys = asked.select(F.col("item_id").alias("query_id"), F.explode(F.array("term", words[0], words[1])).alias("key")).distinct()
    hits = lexicon.nav_hits(names, keys.select(F.col("key").alias("needle")).distinct())
    layer = F.when(F.col("name_key") == F.col("key"), 1.0).otherwise(0.3)
    layers = hits.select(F.col("document_id").alias("entity_id"), F.col("term").alias("name_key"), F.col("needle").alias("key")).join(keys, "key").withColumn("layer", layer)
    return graph.linked(layers)


@plan("gr9_extraction_clean", """WITH e AS (SELECT item_id AS document_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark), k AS (SELECT document_id, lower(name) AS name_key FROM e WHERE length(name) <= 40)
SELECT document_id, name_key, count(*) AS surfaces FROM k GROUP BY 1, 2 HAVING length(name_key) >= 6""")
def _(spark, d):
    entity = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit("term").alias("type")))
    raw = S.table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"), F.concat(F.lit("answer: "), F.to_json(F.struct(entity.alias("entities")))).alias("raw"))
    body = F.substring(F.col("raw"), F.instr("raw", F.lit("{")), F.length("raw"))
    parsed = raw.select("document_id", F.explode(F.from_json(body, "entities array<struct<name:string,type:string>>")["entities"]).alias("e"))
    named = parsed.where(F.length("e.name") <= 40).select("document_id", T.name_key(F.col("e.name")).alias("name_key"))
    return named.groupBy("document_id", "name_key").agg(F.count("*").alias("surfaces")).where(F.length("name_key") >= 6)


@plan("gr10_profile_mismatch", "SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'm' || doc_id % 2 END IS DISTINCT FROM 'm1'")
def _(spark, d):
    profile = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")))
    return S.documents(spark, d).where(~profile.eqNullSafe(F.lit("m1"))).select("doc_id")


@plan("gr11_too_many_chunks", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _(spark, d):
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12").select("o_custkey")


_LEX = "lex AS (SELECT p_name AS term, [p_brand, p_type] AS aliases FROM part)"


@plan("lx2_alias_map", f"WITH {_LEX}, f AS (SELECT unnest(list_append(aliases, term)) AS key, list_append(aliases, term) AS forms FROM lex), k AS (SELECT DISTINCT p_brand AS key FROM part), o AS (SELECT DISTINCT key, unnest(forms) AS form FROM k JOIN f USING (key)) SELECT key, form FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY form) AS n FROM o WHERE form <> key) WHERE n <= 2")
def _(spark, d):
    part = S.table(spark, d, "part")
    lex = part.select(F.col("p_name").alias("term"), F.array("p_brand", "p_type").alias("aliases"))
    return lexicon.alias_map(lex, part.select(F.col("p_brand").alias("key")).distinct())


@plan("lx3_alias_tokens", "SELECT DISTINCT p_brand AS alias, array_to_string(regexp_extract_all(lower(p_brand), '[a-z0-9_]{2,}'), ' ') AS tokens FROM part")
def _(spark, d):
    return S.table(spark, d, "part").select(F.col("p_brand").alias("alias"), T.index_text(F.lower("p_brand")).alias("tokens")).distinct()


@case("ag21_term_frequency", r"""WITH c AS (SELECT kb_id, term, count(*) AS freq FROM (SELECT 'kb' AS kb_id, unnest(['xyz-1000', 'xyz-1000', 'ax-30']) AS term) GROUP BY 1, 2) SELECT kb_id, term, freq FROM c WHERE freq >= 2""")
def _(spark, d):
    texts = spark.createDataFrame([("kb", "See XYZ-1000, also xyz1000."), ("kb", "The ax 30 too")], "kb_id string, content string")
    return lexicon.mined_terms(texts, 2).select("kb_id", "term", "freq")


@plan("wk4_changed_pages", "SELECT document_id FROM (SELECT doc_id // 4 AS document_id, md5(string_agg(text, '|' ORDER BY doc_id)) AS h, md5(string_agg(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END, '|' ORDER BY doc_id)) AS old FROM documents GROUP BY 1) WHERE h <> old")
def _(spark, d):
    digest = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c.alias("t")))), lambda x: x["t"]), "|"))
    rows = S.documents(spark, d).groupBy(F.floor(F.col("doc_id") / 4).alias("document_id"))
    both = rows.agg(digest(F.col("text")).alias("h"), digest(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text"))).alias("old"))
    return both.where("h <> old").select("document_id")


@plan("wk5_clean_sections", "WITH s AS (SELECT doc_id // 4 AS document_id, doc_id % 5 AS place, lang AS heading, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 's' END AS summary, doc_id AS chunk_id FROM documents) SELECT document_id, place, heading, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids FROM s WHERE summary <> '' AND chunk_id % 3 <> 0 GROUP BY 1, 2, 3")
def _(spark, d):
    rows = S.documents(spark, d).select(F.floor(F.col("doc_id") / 4).alias("document_id"), (F.col("doc_id") % 5).alias("place"), F.col("lang").alias("heading"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("s").alias("summary"), F.col("doc_id").alias("chunk_id"))
    valid = rows.where("chunk_id % 3 <> 0").select("document_id", "chunk_id")
    return lexicon.clean_sections(rows, valid).select("document_id", "place", "heading", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@case("wk2_nav_terms", "SELECT * FROM (VALUES (1, 'router', 1), (1, '访问令牌', 2), (2, 'app router', 1)) t(query_id, term, place)")
def _(spark, d):
    rows = [(1, ["访问令牌", "Router", "令牌", "the_id", "12 34"], ["报销"], "报销 the_id", ["令牌"]), (2, ["App  Router", "app", "报销流程"], ["报销流程"], "报销流程", [])]
    return lexicon.nav_terms(spark.createDataFrame(rows, "query_id int, terms array<string>, query_terms array<string>, query string, aliases array<string>"))
