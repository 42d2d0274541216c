"""Outer, semi, anti, tuple and prefix joins of the administration tables."""

from pyspark.sql import functions as F

from docgrain.operators import acl
from docgrain.operators.lexicon import alias_lookup, nav_hits
from docgrain.operators.rows import size_checked, top
from docgrain.sources import substrate as S

from ._registry import plan

_AUDIT = S.cte("audit")
_DEPTS = """depts AS (SELECT '/' || r_name || '/' AS path, true AS shown FROM region UNION ALL SELECT '/' || r_name || '/' || n_name || '/', n_nationkey % 4 <> 0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT '/' || r_name || '/' || n_name || '/team' || (s_suppkey % 3) || '/', bool_and(s_suppkey % 5 <> 0) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""


def departments(spark, d):
    """Regions, their nations and teams of suppliers as a department tree."""
    region, nation, supplier = (S.table(spark, d, t) for t in ("region", "nation", "supplier"))
    root = F.concat(F.lit("/"), "r_name", F.lit("/"))
    both = nation.join(size_checked(region), nation.n_regionkey == region.r_regionkey)
    middle = F.concat(root, "n_name", F.lit("/"))
    teams = supplier.join(size_checked(both), supplier.s_nationkey == both.n_nationkey)
    teams = teams.groupBy(F.concat(middle, F.lit("team"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/")).alias("path")).agg(F.bool_and(F.col("s_suppkey") % 5 != 0).alias("visible_to_parent"))
    return region.select(root.alias("path"), F.lit(True).alias("visible_to_parent")).unionByName(both.select(middle.alias("path"), (F.col("n_nationkey") % 4 != 0).alias("visible_to_parent"))).unionByName(teams)


@plan("jn1_audit_labels", f"{_AUDIT} SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'system' WHEN c_custkey IS NULL THEN 'deleted' ELSE coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'user' || c_custkey) END AS label FROM audit LEFT JOIN customer ON c_custkey = user_id AND user_id % 10 <> 0 AND c_custkey % 7 <> 0")
def _(spark, d):
    users = S.table(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("display"))
    rows = S.events(spark, d).select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("actor"))
    label = F.when(F.col("actor").isNull(), "system").when(F.col("c_custkey").isNull(), "deleted").otherwise(F.coalesce("display", F.concat(F.lit("user"), F.col("c_custkey").cast("string"))))
    return rows.join(users, F.col("actor") == F.col("c_custkey"), "left").select("event_id", label.alias("label"))


@plan("jn2_users_departments", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0")
def _(spark, d):
    nation = S.table(spark, d, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    return S.table(spark, d, "customer").join(size_checked(nation), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")


@plan("jn3_group_sizes", "SELECT n_name, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_name")
def _(spark, d):
    members = S.table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("m"))
    nation = S.table(spark, d, "nation")
    return nation.join(members, nation.n_nationkey == members.c_nationkey, "left").groupBy("n_name").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("members"))


@plan("jn4_members", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0")
def _(spark, d):
    return S.table(spark, d, "customer").join(S.table(spark, d, "orders").where("o_orderkey % 3 = 0"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey")


@plan("jn5_conversation_list", """WITH c AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, last FROM c WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = conv_id AND event_type = 'click') ORDER BY last DESC, conv_id LIMIT 50""")
def _(spark, d):
    last = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    external = S.events(spark, d).where("action = 'click'").select(F.col("event_id").alias("conv_id"))
    return last.join(external, "conv_id", "left_anti").orderBy(F.desc("last"), "conv_id").limit(50)


@plan("jn6_readable_wiki_pages", f"{S.cte('chunks', 'principals', 'visible')} SELECT DISTINCT principal_id, document_id FROM visible WHERE document_id % 3 = 0")
def _(spark, d):
    pages = S.chunks(spark, d).where("document_id % 3 = 0").select("document_id").distinct()
    seen = acl.secured(S.chunks(spark, d), S.principals(spark)).select("principal_id", "document_id").distinct()
    return seen.join(pages, "document_id", "left_semi").select("principal_id", "document_id")


@plan("jn7_documents_without_mentions", f"{S.cte('chunks')} SELECT document_id, sum(length(content))::BIGINT AS chars FROM chunks WHERE document_id NOT IN (SELECT doc_id // 4 FROM labels) GROUP BY document_id HAVING sum(length(content)) >= 200")
def _(spark, d):
    mentioned = S.table(spark, d, "labels").select(F.floor(F.col("doc_id") / 4).alias("document_id")).distinct()
    sums = S.chunks(spark, d).groupBy("document_id").agg(F.sum(F.length("content")).alias("chars")).where("chars >= 200")
    return sums.join(mentioned, "document_id", "left_anti")


@plan("jn8_orphans", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def _(spark, d):
    used = S.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return S.table(spark, d, "part").where("p_partkey % 3 = 0").join(used, "p_partkey", "left_anti").select("p_partkey")


@plan("jn9_tuple_in", f"{S.cte('chunks')} SELECT chunk_id FROM chunks WHERE (document_id, heading_path) IN (SELECT document_id, heading_path FROM chunks WHERE chunk_id % 17 = 0)")
def _(spark, d):
    hits = S.chunks(spark, d).where("chunk_id % 17 = 0").select("document_id", "heading_path").distinct()
    return S.chunks(spark, d).join(hits, ["document_id", "heading_path"], "left_semi").select("chunk_id")


_NAV = """needles AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS needle FROM benchmark), terms AS (SELECT DISTINCT doc_id // 4 AS document_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS term FROM documents), held AS (SELECT term, needle FROM (SELECT DISTINCT term FROM terms) JOIN needles ON contains(lower(term), needle))"""


def _needles(spark, d):
    return S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("needle")).distinct()


def _page_terms(spark, d):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]{4,})"), F.lit(1))))
    return S.documents(spark, d).select(F.floor(F.col("doc_id") / 4).alias("document_id"), words.alias("term"))


@plan("jn10_term_needles", f"WITH {_NAV} SELECT document_id, term, needle FROM terms JOIN held USING (term)")
def _(spark, d):
    return nav_hits(_page_terms(spark, d), _needles(spark, d))


@plan("ag24_wiki_page_score", f"WITH {_NAV} SELECT document_id, max(length(needle)) AS best_len, count(DISTINCT needle) AS hit_terms FROM terms JOIN held USING (term) GROUP BY document_id")
def _(spark, d):
    return nav_hits(_page_terms(spark, d), _needles(spark, d)).groupBy("document_id").agg(F.max(F.length("needle")).cast("long").alias("best_len"), F.count_distinct("needle").alias("hit_terms"))


@plan("wk1_wiki_page_pick", f"WITH {_NAV} SELECT document_id FROM terms JOIN held USING (term) GROUP BY document_id ORDER BY max(length(needle)) DESC, count(DISTINCT needle) DESC, document_id LIMIT 1")
def _(spark, d):
    hits = nav_hits(_page_terms(spark, d), _needles(spark, d)).groupBy("document_id").agg(F.max(F.length("needle")).alias("best_len"), F.count_distinct("needle").alias("hit_terms"))
    return hits.orderBy(F.desc("best_len"), F.desc("hit_terms"), "document_id").limit(1).select("document_id")


@plan("jn11_mention_chunks", f"{S.cte('chunks', 'principals', 'visible')} SELECT principal_id, l_partkey AS entity_id, count(DISTINCT chunk_id) AS n FROM lineitem JOIN visible ON chunk_id = l_orderkey GROUP BY 1, 2")
def _(spark, d):
    mentions = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    seen = acl.secured(S.chunks(spark, d), S.principals(spark)).select("principal_id", "chunk_id")
    return mentions.join(seen, "chunk_id").groupBy("principal_id", "entity_id").agg(F.count_distinct("chunk_id").alias("n"))


@plan("jn12_filenames", f"{S.cte('chunks')} SELECT chunk_id, coalesce(f.name, '') AS filename FROM chunks LEFT JOIN (SELECT page_id, regexp_extract(url, '[^/]+$') AS name FROM pages WHERE page_id % 4 <> 0) f ON f.page_id = document_id")
def _(spark, d):
    files = S.table(spark, d, "pages").where("page_id % 4 <> 0").select(F.col("page_id").alias("document_id"), F.regexp_extract("url", "[^/]+$", 0).alias("name"))
    return S.chunks(spark, d).join(files, "document_id", "left").select("chunk_id", F.coalesce("name", F.lit("")).alias("filename"))


@plan("jn13_alias_lookup", """WITH l AS (SELECT p_name AS term, [p_brand, p_type] AS aliases FROM part), k AS (SELECT unnest(['Brand#12', 'Brand#33', 'part 7']) AS key UNION SELECT p_name FROM part WHERE p_partkey IN (3, 5, 9))
SELECT DISTINCT k.key, l.term FROM k JOIN l ON l.term = k.key OR list_contains(l.aliases, k.key)""")
def _(spark, d):
    part = S.table(spark, d, "part")
    lexicon = part.select(F.col("p_name").alias("term"), F.array("p_brand", "p_type").alias("aliases"))
    keys = spark.createDataFrame([("Brand#12",), ("Brand#33",), ("part 7",)], "key string").union(part.where(F.col("p_partkey").isin(3, 5, 9)).select("p_name")).distinct()
    return alias_lookup(lexicon, keys)


@plan("jn14_uploader_labels", "SELECT o_orderkey, coalesce(c_name, 'unknown') AS uploader, n_name AS dept FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    people = S.table(spark, d, "customer").join(size_checked(S.table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    return S.table(spark, d, "orders").join(people, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("uploader"), F.col("n_name").alias("dept"))


@plan("jn15_batch_pairs", f"{S.cte('chunks', 'principals', 'visible', 'questions')} SELECT query_id, count(*) AS readable FROM questions JOIN visible USING (principal_id) GROUP BY query_id")
def _(spark, d):
    from docgrain.operators.rows import spread_join

    seen = acl.secured(S.chunks(spark, d), S.principals(spark)).select("principal_id", "chunk_id")
    return spread_join(seen, S.questions(spark, d).select("query_id", "principal_id"), "principal_id", "chunk_id").groupBy("query_id").agg(F.count("*").alias("readable"))


@plan("jn16_visible_descendants", f"WITH {_DEPTS} SELECT a.path, b.path AS descendant FROM depts a JOIN depts b ON starts_with(b.path, a.path) AND b.path <> a.path WHERE NOT EXISTS (SELECT 1 FROM depts c WHERE starts_with(b.path, c.path) AND length(c.path) > length(a.path) AND NOT c.shown)")
def _(spark, d):
    tree = departments(spark, d)
    return acl.visible_descendants(tree.select("path"), tree)


@plan("tx41_user_subjects", f"""WITH {_DEPTS}, u AS (SELECT c_custkey AS user_id, '/' || r_name || '/' || n_name || '/' AS own, '/' || r_name || '/' AS root, c_custkey % 4 AS g, lower(c_mktsegment) AS role FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
below AS (SELECT a.path, b.path AS descendant FROM depts a JOIN depts b ON starts_with(b.path, a.path) AND b.path <> a.path WHERE NOT EXISTS (SELECT 1 FROM depts c WHERE starts_with(b.path, c.path) AND length(c.path) > length(a.path) AND NOT c.shown)),
s AS (SELECT user_id, 'user:' || user_id AS s FROM u UNION SELECT user_id, 'public' FROM u UNION SELECT user_id, 'group:' || g FROM u UNION SELECT user_id, 'role:' || role FROM u UNION SELECT user_id, 'dept:' || own FROM u UNION SELECT user_id, 'dept:' || root FROM u UNION SELECT user_id, 'dept:' || descendant FROM u JOIN below ON path = own)
SELECT user_id, count(*) AS n, md5(string_agg(s, ',' ORDER BY s)) AS digest FROM s GROUP BY user_id""")
def _(spark, d):
    people = S.table(spark, d, "customer").join(size_checked(S.table(spark, d, "nation").join(size_checked(S.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("n_nationkey") == F.col("c_nationkey"))
    users = people.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/")).alias("dept_path"), F.array((F.col("c_custkey") % 4).cast("string")).alias("groups"), F.array(F.lower("c_mktsegment")).alias("roles"), F.lit(None).cast("string").alias("region"))
    out = acl.user_subjects(users, departments(spark, d))
    return out.select("user_id", F.size("subjects").cast("long").alias("n"), F.md5(F.array_join("subjects", ",")).alias("digest"))


@plan("jn17_authorised_kbs", f"""{S.cte('principals')}, kb AS (SELECT DISTINCT source AS kb_id, source IN ('src3') AS is_public, CASE WHEN source < 'src15' THEN ['group:1', 'user:9'] ELSE ['dept:/2/'] END AS members FROM documents)
SELECT principal_id, kb_id FROM principals, kb WHERE is_public OR list_has_any(members, subjects)""")
def _(spark, d):
    kbs = S.documents(spark, d).select(F.col("source").alias("kb_id")).distinct()
    kbs = kbs.select("kb_id", F.lit("main").alias("tenant_id"), (F.col("kb_id") == "src3").alias("is_public"), F.when(F.col("kb_id") < "src15", F.array(F.lit("group:1"), F.lit("user:9"))).otherwise(F.array(F.lit("dept:/2/"))).alias("members"))
    return acl.authorised_kbs(S.principals(spark).withColumnRenamed("p_tenant", "tenant_id"), kbs)


@plan("xt11_department_tree", f"""WITH RECURSIVE {_DEPTS}, n AS (SELECT path, regexp_replace(path, '[^/]+/$', '') AS parent FROM depts WHERE NOT path LIKE '%/ASIA/' AND path <> '/ASIA/'),
w AS (SELECT path, 0 AS depth, path AS root, '/' || split_part(path, '/', len(string_split(path, '/')) - 1) || '/' AS walked FROM n WHERE parent NOT IN (SELECT path FROM n) UNION ALL SELECT n.path, depth + 1, root, walked || split_part(n.path, '/', len(string_split(n.path, '/')) - 1) || '/' FROM n JOIN w ON n.parent = w.path) SELECT path, depth, root, walked FROM w""")
def _(spark, d):
    from docgrain.operators.graph import tree

    nodes = departments(spark, d).where("path <> '/ASIA/'").select("path", F.regexp_replace("path", "[^/]+/$", "").alias("parent"), F.element_at(F.split("path", "/"), -2).alias("name"))
    return tree(nodes.withColumnRenamed("path", "node"), "node", "parent", "name").select(F.col("node").alias("path"), "depth", "root", F.col("path").alias("walked"))


@plan("xt12_move_guard", f"WITH {_DEPTS} SELECT a.path, b.path AS target, NOT starts_with(b.path, a.path) AS allowed FROM depts a JOIN depts b ON split_part(a.path, '/', 2) = split_part(b.path, '/', 2) WHERE a.path LIKE '%/team0/' OR length(a.path) < 9")
def _(spark, d):
    tree = departments(spark, d).select("path").withColumn("root", F.split_part("path", F.lit("/"), F.lit(2)))
    moved = tree.where(F.col("path").like("%/team0/") | (F.length("path") < 9))
    return moved.join(tree.select("root", F.col("path").alias("target")), "root").select("path", "target", (~F.startswith("target", F.col("path"))).alias("allowed"))


@plan("tx38_moved_paths", f"WITH {_DEPTS} SELECT path, CASE WHEN starts_with(path, '/ASIA/') THEN '/EUROPE/ASIA/' || substr(path, 7) ELSE path END AS moved, len(string_split(CASE WHEN starts_with(path, '/ASIA/') THEN '/EUROPE/ASIA/' || substr(path, 7) ELSE path END, '/')) - 2 AS depth FROM depts")
def _(spark, d):
    moved = acl.moved_path(F.col("path"), F.lit("/ASIA/"), F.lit("/EUROPE/ASIA/"))
    return departments(spark, d).select("path", moved.alias("moved"), F.size(acl.ancestors(moved)).cast("long").alias("depth"))


@plan("tx39_tag_validation", """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [' '] WHEN 1 THEN ['public', 'user:1'] WHEN 2 THEN ['level:3', 'a'] WHEN 3 THEN ['public'] ELSE ['dept:/a/', 'x'] END AS tags FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'public_not_alone' WHEN 2 THEN 'level_tag' END AS violation FROM t""")
def _(spark, d):
    lists = [F.array(*[F.lit(x) for x in tags]) for tags in ([" "], ["public", "user:1"], ["level:3", "a"], ["public"], ["dept:/a/", "x"])]
    return S.documents(spark, d).select("doc_id", acl.tag_violation(F.get(F.array(*lists), (F.col("doc_id") % 5).cast("int"))).alias("violation"))


@plan("tx40_document_tags", f"WITH {_DEPTS} SELECT path, array_to_string(list_sort(list_distinct(['dept:' || path, 'group:' || length(path) % 3])), ',') AS tags FROM depts UNION ALL SELECT '', 'public'")
def _(spark, d):
    tags = acl.document_tags(F.col("path"), F.when(F.col("path") != "", F.array(F.concat(F.lit("group:"), (F.length("path") % 3).cast("string")))))
    rows = departments(spark, d).select("path").union(spark.createDataFrame([("",)], "path string"))
    return rows.select("path", F.array_join(tags, ",").alias("tags"))


@plan("xt3_member_diff", """WITH o AS (SELECT DISTINCT n_regionkey AS kb, 'n' || n_nationkey AS m FROM nation WHERE n_nationkey % 3 <> 0), n AS (SELECT DISTINCT n_regionkey AS kb, 'n' || n_nationkey AS m FROM nation WHERE n_nationkey % 4 <> 0)
SELECT coalesce(o.kb, n.kb) AS kb, string_agg(CASE WHEN o.m IS NULL THEN n.m END, ',' ORDER BY n.m) AS added, string_agg(CASE WHEN n.m IS NULL THEN o.m END, ',' ORDER BY o.m) AS removed, count(n.m) AS final FROM o FULL JOIN n ON o.kb = n.kb AND o.m = n.m GROUP BY 1""")
def _(spark, d):
    rows = S.table(spark, d, "nation").select(F.col("n_regionkey").alias("kb"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("m"), "n_nationkey")
    old = rows.where("n_nationkey % 3 <> 0").select("kb", "m", F.lit(True).alias("was"))
    new = rows.where("n_nationkey % 4 <> 0").select("kb", "m", F.lit(True).alias("now"))
    both = old.join(new, ["kb", "m"], "full")
    listed = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("m")))), ","), F.lit(""))
    return both.groupBy("kb").agg(listed(F.col("was").isNull()).alias("added"), listed(F.col("now").isNull()).alias("removed"), F.count("now").alias("final"))
