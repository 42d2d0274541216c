"""Parsers and the chunker over documents made of the tables' words, whose blocks and chunks SQL can tell beforehand."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrain.engine import Engine
from docgrain.operators import chunking
from docgrain.operators.rows import fresh_path
from docgrain.sources import files, office, parsers
from docgrain.sources import substrate as S

from . import _made
from ._registry import plan

#: Documents with their words in one line, the first and the last of them.
_WORDS = "t AS (SELECT doc_id, source, lang, body, split_part(body, ' ', 1) AS a, split_part(body, ' ', -1) AS b FROM (SELECT doc_id, source, lang, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS body FROM documents) WHERE body <> '')"
_BLOCK = "block_no, md5(text) AS text, heading, is_table, verbatim"


def _words(spark, d):
    body = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    rows = S.documents(spark, d).select("doc_id", "source", "lang", body.alias("body")).where("body <> ''")
    return rows.select("*", F.split_part("body", F.lit(" "), F.lit(1)).alias("a"), F.split_part("body", F.lit(" "), F.lit(-1)).alias("b"))


def _text(*parts: str | Column) -> Column:
    """Column names between literal texts: a part that starts with @ is a column."""
    return F.concat(*(F.col(p[1:]) if isinstance(p, str) and p.startswith("@") else F.lit(p) if isinstance(p, str) else p for p in parts))


def _blocks(rows, parse):
    found = parsers.exploded(parsers.parsed(rows.select("doc_id", "made"), "made", parse))
    return found.select("doc_id", "block_no", F.md5("text").alias("text"), "heading", "is_table", "verbatim")


@plan("sc8_markdown_blocks", f"""WITH {_WORDS} SELECT doc_id, {_BLOCK} FROM (
SELECT doc_id, 0 AS block_no, body AS text, source AS heading, false AS is_table, false AS verbatim FROM t UNION ALL SELECT doc_id, 1, '[图片] pic ' || a, source || ' > ' || lang, false, false FROM t
UNION ALL SELECT doc_id, 2, 'k' || chr(9) || 'v' || chr(10) || a || chr(9) || b, source || ' > ' || lang, true, false FROM t UNION ALL SELECT doc_id, 3, '- ' || a || chr(10) || '- ' || b, source || ' > ' || lang, false, true FROM t
UNION ALL SELECT doc_id, 4, body, 'Last', false, true FROM t)""")
def _(spark, d):
    made = _text("# ", "@source", "\n", "@body", "\n\n## ", "@lang", "\n![pic](http://x/p(1).png) ", "@a", "\n| k | v |\n|---|:-:|\n| ", "@a", " | ", "@b", " |\n- ", "@a", "\n- ", "@b", "\n# Last\n```py\n", "@body", "\n```\n![](u)\n")
    return _blocks(_words(spark, d).withColumn("made", made), parsers.markdown_blocks)


@plan("sc9_html_blocks", f"""WITH {_WORDS} SELECT doc_id, {_BLOCK} FROM (
SELECT doc_id, 0 AS block_no, body AS text, source AS heading, false AS is_table, false AS verbatim FROM t UNION ALL SELECT doc_id, 1, a || ' & ' || b, source || '/' || lang, false, false FROM t UNION ALL SELECT doc_id, 2, b, source || '/' || lang, false, false FROM t
UNION ALL SELECT doc_id, 3, body, 'Last', false, true FROM t UNION ALL SELECT doc_id, 4, '[图片] pic', 'Last', false, false FROM t)""")
def _(spark, d):
    made = _text("<html><script>x</script><nav>menu</nav><h1>", "@source", "</h1><p>", "@body", "<h2> ", "@lang", "</h2><p><b>", "@a", "</b> &amp;\n ", "@b", "<p>", "@b", "<h1>Last</h1><pre>\n", "@body", "\n</pre><img alt='pic'><footer><p>end</p></footer></html>")
    return _blocks(_words(spark, d).withColumn("made", made), parsers.html_blocks)


@plan("tx7_table_grid", f"""WITH {_WORDS} SELECT doc_id, md5(concat_ws(chr(10), concat_ws(chr(9), 'k', 'v', 'v'), concat_ws(chr(9), source, a, b), concat_ws(chr(9), source, lang, lang))) AS grid FROM t""")
def _(spark, d):
    made = _text("<table><tr><th>k</th><th colspan=2>v</th></tr><tr><td rowspan='2'>", "@source", "</td><td>", "@a", "</td><td>", "@b", "</td></tr><tr><td colspan=2>", "@lang", "</td></tr></table><table><tr><td>one row</td></tr></table>")
    return _blocks(_words(spark, d).withColumn("made", made), parsers.html_blocks).select("doc_id", F.col("text").alias("grid"))


@plan("tx9_heading_levels", f"""WITH {_WORDS} SELECT doc_id, block_no, heading FROM (SELECT doc_id, 0 AS block_no, source || ' > ' || a || ' > ' || b AS heading FROM t UNION ALL SELECT doc_id, 1, source || ' > ' || lang FROM t UNION ALL SELECT doc_id, 2, b FROM t)""")
def _(spark, d):
    made = _text("# ", "@source", "\n## ", "@a", "\n#### ", "@b", "\nx\n## ", "@lang", "\ny\n# ", "@b", "\nz\n")
    return _blocks(_words(spark, d).withColumn("made", made), parsers.markdown_blocks).select("doc_id", "block_no", "heading")


@plan("tx10_heading_depths", f"""WITH {_WORDS} SELECT doc_id, block_no, heading FROM (SELECT doc_id, 0 AS block_no, source || '/' || a || '/' || b AS heading FROM t UNION ALL SELECT doc_id, 1, source || '/' || lang FROM t UNION ALL SELECT doc_id, 2, b FROM t)""")
def _(spark, d):
    made = _text("<h1>", "@source", "</h1><h2>", "@a", "</h2><h3>", "@b", "</h3><p>x<h2>", "@lang", "</h2><p>y<h1>", "@b", "</h1><p>z")
    return _blocks(_words(spark, d).withColumn("made", made), parsers.html_blocks).select("doc_id", "block_no", "heading")


@plan("tx12_image_text", f"WITH {_WORDS} SELECT doc_id, md5('in [图片] ' || a || ' mid [图片] ' || b || ' to [图片] ' || lang || '  end') AS shown FROM t")
def _(spark, d):
    made = _text("in ![", "@a", "](http://x/(1).png) mid <img src='u' alt=\"", "@b", "\"> to ![", "@lang", "][ref] ![](u) end")
    return _words(spark, d).select("doc_id", F.md5(parsers.image_text(made)).alias("shown"))


@plan("tx14_sentences", r"""SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([！？。!?])', '\1' || chr(10), 'g'), '(\.)\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)""")
def _(spark, d):
    found = S.documents(spark, d).where("text IS NOT NULL").select("doc_id", chunking.sentence_list(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _chunks(rows, blocks: Column):
    """Chunks of documents made of `blocks`: an array of (text, heading, is_table, verbatim)."""
    return chunking.chunk_documents(rows.select("doc_id", blocks.alias("blocks")))


def _block(text: Column, heading: str | Column = "", table: bool = False, verbatim: bool = False) -> Column:
    heading = F.lit(heading) if isinstance(heading, str) else heading
    return F.struct(text.alias("text"), heading.alias("heading"), F.lit(table).alias("is_table"), F.lit(verbatim).alias("verbatim"))


def _repeated(unit: Column, n: Column, between: str) -> Column:
    return F.array_join(F.array_repeat(unit, n.cast("int")), between)


@plan("ch1_table_units", f"WITH {_WORDS}, n AS (SELECT doc_id, doc_id % 700 + 1 AS n FROM t) SELECT doc_id, unnest(CASE WHEN 2 + 4 * n <= 800 THEN [2 + 4 * n] ELSE list_concat(list_transform(range(n // 199), lambda i: 2 + 4 * 199), CASE WHEN n % 199 > 0 THEN [2 + 4 * (n % 199)] ELSE []::BIGINT[] END) END)::INTEGER AS tokens FROM n")
def _(spark, d):
    rows = _words(spark, d)
    table = F.concat(F.lit("k\tv\n"), _repeated(_text("@a", " ", "@b", "\t", "@a", " ", "@b"), F.col("doc_id") % 700 + 1, "\n"))
    units = rows.select("doc_id", chunking.unit_sizes(table, F.lit(True), F.lit(False)).alias("u"))
    return units.select("doc_id", F.explode("u").alias("tokens"))


@plan("ch2_verbatim_units", f"WITH {_WORDS}, n AS (SELECT doc_id, doc_id % 300 + 1 AS n FROM t) SELECT doc_id, unnest(list_concat(list_transform(range(n // 80), lambda i: 800), CASE WHEN n % 80 > 0 THEN [10 * (n % 80)] ELSE []::BIGINT[] END))::INTEGER AS tokens FROM n")
def _(spark, d):
    line = _repeated(F.col("a"), F.lit(10), " ")
    units = _words(spark, d).select("doc_id", chunking.unit_sizes(_repeated(line, F.col("doc_id") % 300 + 1, "\n"), F.lit(False), F.lit(True)).alias("u"))
    return units.select("doc_id", F.explode("u").alias("tokens"))


@plan("ch3_text_units", f"""WITH {_WORDS}, n AS (SELECT doc_id, doc_id % 7 + 1 AS s, doc_id % 3 AS w FROM t) SELECT doc_id, unnest(list_concat(CASE WHEN 301 * s <= 800 THEN [301 * s] ELSE list_transform(range(s), lambda i: 301) END,
CASE w WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [800, 50] ELSE [800, 800, 100] END))::INTEGER AS tokens FROM n""")
def _(spark, d):
    sentence = F.concat(_repeated(F.col("a"), F.lit(300), " "), F.lit("."))
    text = F.concat(_repeated(sentence, F.col("doc_id") % 7 + 1, " "), F.lit("\n\n"), _repeated(F.col("b"), F.col("doc_id") % 3 * 850, " "))
    units = _words(spark, d).select("doc_id", chunking.unit_sizes(text, F.lit(False), F.lit(False)).alias("u"))
    return units.select("doc_id", F.explode("u").alias("tokens"))


#: Paragraphs of a hundred words: a chunk takes four, and starts with the last one of the chunk before.
_PARAGRAPHS = f"{_WORDS}, n AS (SELECT *, doc_id % 40 + 1 AS n FROM t), k AS (SELECT *, unnest(range(CASE WHEN n <= 4 THEN 1 ELSE 1 + (n - 2) // 3 END)) AS i FROM n), c AS (SELECT *, 3 * i + 1 AS first, least(n, 3 * i + 4) AS last FROM k)"


def _paragraphs():
    """The word is repeated beside the numbers, so it is looked up once a text. No function uses another one's variable: a Python
    step over such a column isn't planned (Spark 4.1)."""
    n = (F.col("doc_id") % 40 + 1).cast("int")
    numbers = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit(" ")))
    return F.array_join(F.zip_with(F.array_repeat(_repeated(F.col("a"), F.lit(99), " "), n), numbers, lambda words, number: F.concat(number, words)), "\n\n")


@plan("ch4_greedy_chunks", f"WITH {_PARAGRAPHS} SELECT doc_id, i::INTEGER AS chunk_index, (100 * (last - first + 1))::INTEGER AS token_count FROM c")
def _(spark, d):
    rows = _words(spark, d)
    return _chunks(rows, F.array(_block(_paragraphs()))).select("doc_id", "chunk_index", "token_count")


@plan("ch5_chunk_attributes", f"""WITH {_WORDS} SELECT doc_id, chunk_index, heading, grouped FROM (SELECT doc_id, 0 AS chunk_index, source AS heading, false AS grouped FROM t WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, lang, false FROM t WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, i + 1, 'table', true FROM t, range(2) r(i) WHERE doc_id % 2 = 0)""")
def _(spark, d):
    even = F.col("doc_id") % 2 == 0
    prose = _repeated(F.col("a"), F.lit(500), " ")
    table = F.concat(F.lit("k v\n"), _repeated(F.concat(_repeated(F.col("b"), F.lit(398), " "), F.lit(" x y")), F.lit(2), "\n"))
    blocks = F.when(even, F.array(_block(prose, F.col("source")), _block(F.concat(table), "table", True))).otherwise(F.array(_block(F.col("a")), _block(F.col("b"), F.col("lang"))))
    return _chunks(_words(spark, d), blocks).select("doc_id", "chunk_index", "heading", F.col("group_id").isNotNull().alias("grouped"))


@plan("engine_ingested_chunks", f"WITH {_PARAGRAPHS} SELECT doc_id, i::INTEGER AS chunk_index, md5(array_to_string(list_transform(range(first, last + 1), lambda x: 'p' || x || repeat(' ' || a, 99)), chr(10) || chr(10))) AS content, (100 * (last - first + 1))::INTEGER AS token_count, '' AS heading FROM c")
def _(spark, d):
    rows = _words(spark, d).select("doc_id", F.array_join(F.array(_paragraphs()), "").alias("text"))
    chunks = Engine(spark).ingest(rows, "markdown")
    return chunks.select("doc_id", "chunk_index", F.md5("content").alias("content"), "token_count", "heading")


@plan("sc2_folder_scan", "SELECT source, sum(strlen(line) + 1)::BIGINT AS size FROM (SELECT source, coalesce(replace(text, chr(10), ' '), '') AS line FROM documents) GROUP BY source")
def _(spark, d):
    root = fresh_path(spark, "folder")
    rows = S.documents(spark, d).select("source", F.coalesce(F.regexp_replace("text", "\n", " "), F.lit("")).alias("line"))
    rows.write.partitionBy("source").text(f"{root}/data")
    rows.select("line").write.text(f"{root}/data/.git/objects")
    found = files.scan_folder(spark, root, ["*.txt"])
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("size").alias("size"))


@plan("sc11_docx_blocks", f"""WITH {_WORDS} SELECT doc_id, {_BLOCK} FROM (SELECT doc_id, 0 AS block_no, source AS text, source AS heading, false AS is_table, false AS verbatim FROM t UNION ALL SELECT doc_id, 1, body, source, false, false FROM t
UNION ALL SELECT doc_id, 2, lang, source || '/' || lang, false, false FROM t UNION ALL SELECT doc_id, 3, a || ' ' || b, source || '/' || lang, false, false FROM t UNION ALL SELECT doc_id, 4, 'Last', 'Last', false, false FROM t UNION ALL SELECT doc_id, 5, b, 'Last', false, false FROM t
UNION ALL SELECT doc_id, 6, concat_ws(chr(10), concat_ws(chr(9), 'k', 'k', 'v'), concat_ws(chr(9), a, b, 'x'), concat_ws(chr(9), a, 'y', lang)), 'Last', true, false FROM t)""")
def _(spark, d):
    made = _made.made_docx(F.col("source"), F.col("body"), F.col("lang"), F.col("a"), F.col("b"))
    return _blocks(_words(spark, d).withColumn("made", made), office.docx_blocks)


@plan("sc22_xlsx_blocks", f"""WITH {_WORDS} SELECT doc_id, {_BLOCK} FROM (SELECT doc_id, 0 AS block_no, 'k' || chr(9) || 'v' || chr(10) || a || chr(9) || b || chr(10) || a || chr(9) || doc_id AS text, 'first' AS heading, true AS is_table, false AS verbatim FROM t UNION ALL SELECT doc_id, 1, lang || chr(9) || source || chr(10) || lang || chr(9) || body, 'second', true, false FROM t)""")
def _(spark, d):
    made = _made.made_xlsx(F.col("a"), F.col("b"), F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("body"))
    return _blocks(_words(spark, d).withColumn("made", made), office.xlsx_blocks)


@plan("sc21_pptx_blocks", f"""WITH {_WORDS} SELECT doc_id, {_BLOCK} FROM (SELECT doc_id, 0 AS block_no, source AS text, '第1页 / ' || source AS heading, false AS is_table, false AS verbatim FROM t UNION ALL SELECT doc_id, 1, body, '第1页 / ' || source, false, false FROM t
UNION ALL SELECT doc_id, 2, 'k' || chr(9) || 'v' || chr(10) || a || chr(9) || b, '第2页', true, false FROM t)""")
def _(spark, d):
    made = _made.made_pptx(F.col("source"), F.col("body"), F.col("a"), F.col("b"))
    return _blocks(_words(spark, d).withColumn("made", made), office.pptx_blocks)


@plan("sc17_object_keys", "SELECT doc_id, 'tenant/' || source || '/' || doc_id // 4 || '/v' || doc_id % 5 || '/' || lang || '.txt' AS key FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    return S.documents(spark, d).select("doc_id", files.object_key(F.lit("tenant"), F.col("source"), F.floor(i / 4).cast("string"), i % 5, F.concat("lang", F.lit(".txt"))).alias("key"))
