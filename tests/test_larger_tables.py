"""What larger or odder tables than the test tables show: repeated keys, long texts, many rows in a batch."""

import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from docgrain.operators import chunking, graph, lexicon, recall
from docgrain.operators.rows import BATCH_BYTES
from docgrain.plans import parsing, registry
from docgrain.sources import parsers
from docgrain.sources import substrate as S

PLANS, SQL = registry.queries(), registry.oracle_sql()


def test_cd2_several_pages_of_one_url(spark, tmp_path):
    """Revived pages that share a url with pages of other versions; and pages without one."""
    url = F.when(F.col("id") % 10 == 9, None).otherwise(F.concat(F.lit("u"), (F.col("id") % 8).cast("string")))
    spark.range(400).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("<p>x").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("cd2_version_chain", "cd3_sync_actions"):
        cursor = con.execute(SQL[name])
        df = PLANS[name](spark, str(tmp_path)).select(*(c[0] for c in cursor.description))
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_python_steps_get_bounded_batches(spark, tmp_path):
    """A batch's bytes are bounded for each kind of Python step, whatever the rows of a partition."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    blocks = docs.select("doc_id", F.array(F.struct("text", F.lit("").alias("heading"), F.lit(False).alias("is_table"), F.lit(False).alias("verbatim"))).alias("blocks"))
    vectors = docs.select(F.lit(0).cast("long").alias("principal_id"), F.col("doc_id").alias("id"), F.array(F.lit(1.0)).alias("vector"))
    steps = [lambda: S.documents(spark, str(tmp_path)), lambda: parsers.parsed(docs, "text", parsers.markdown_blocks), lambda: chunking.chunk_documents(blocks), lambda: recall.vector_blocks(vectors, 4, 1)]
    for step in steps:
        spark.conf.unset(key)
        step()
        assert int(spark.conf.get(key)) == BATCH_BYTES
    sizes = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    long = spark.range(0, 400, 1, 1).select(sizes(F.repeat(F.lit("x"), 100_000)).alias("n"))
    assert max(r["n"] for r in long.collect()) <= BATCH_BYTES // 100_000 + 1


def test_counter_is_the_pattern(spark):
    for text in ("", "a b", "a_b-c, d.", "x\x1cy\x00\x7f z", "1\t2\n3", "né 中文 a!", "  a\x85b"):
        assert chunking.count_tokens(text) == len(chunking._TOKEN.findall(text)), repr(text)


def test_ch4_looks_up_its_word_once(spark, sf):
    """The regular expression over the whole text isn't part of what runs for each paragraph."""
    plan = PLANS["ch4_greedy_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    each = plan[plan.index("transform(sequence(") :].split("AS blocks")[0]
    assert "regexp_replace" not in each


def test_ingested_chunks_are_planned_again(spark, sf):
    """The Python step is planned apart each time; the first plan of a session has column numbers that can hide that it isn't."""
    cursor = duckdb.connect().execute(SQL["engine_ingested_chunks"].replace("FROM documents", f"FROM '{sf}/documents.parquet'"))
    columns, want = [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))
    for _ in range(2):
        assert sorted(map(repr, map(tuple, PLANS["engine_ingested_chunks"](spark, sf).select(*columns).collect()))) == want


def test_sc2_writes_as_many_tasks_as_it_reads(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.lit("x\ny").alias("text"), F.lit("s").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(parsing, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert [tuple(r) for r in PLANS["sc2_folder_scan"](spark, str(tmp_path)).collect()] == [("s", 1600)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list(tmp_path.glob("folder/data/source=s/*.txt"))) >= 4 and len(list(tmp_path.glob("folder/data/.git/objects/*.txt"))) >= 4


def test_terms_are_read_in_one_pass(spark):
    """One scan each; repeated rows, runs too long for a name, and a budget that the first choice takes."""
    said = [("k", "2（词语） 12ab(词语) xab_1 （词语） " + "y" * 40 + "（词语）"), ("k", "一二三四五六七八九十一二三四（ab） ab12 AB-12"), ("k", None), (None, "词语(ab1) 词语(ab1)")]
    mined = lexicon.mined_terms(spark.createDataFrame(said, "kb_id string, content string"), 1)
    assert mined._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    want = []
    for kb, text in said:
        for pattern, t in ((lexicon.CJK_FIRST, 1), (lexicon.ASCII_FIRST, 2)):
            want += [(kb, m[t], m[3 - t]) for m in re.finditer(pattern, text or "", re.A)]
    got = {(r["kb_id"], r["term"]): (r["freq"], r["aliases"]) for r in mined.collect()}
    assert got.pop(("k", "ab-12")) == (2, ["ab 12", "ab12"])
    assert got == {k: (sum(x[:2] == k for x in want), sorted({x[2] for x in want if x[:2] == k})) for k in {x[:2] for x in want}} and len(got) >= 3
    rows = [(1, ["一二三四五六七", "一二三四五", "alpha", "beta"], ["zz"], "q", [])] * 3 + [(2, ["gamma"], ["zz"], "q", ["gamma"]), (3, ["一二三四五六", "alphas", "beta"], ["zz"], "q", [])]
    found = lexicon.nav_terms(spark.createDataFrame(rows, "query_id int, terms array<string>, query_terms array<string>, query string, aliases array<string>"))
    assert sorted(map(tuple, found.collect())) == [(1, "一二三四五六七", 1), (3, "alphas", 1), (3, "一二三四五六", 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_gr4_deals_mentions_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    mentions = spark.range(2000).select((F.col("id") % 7).alias("entity_id"), F.when(F.col("id") % 50 != 0, F.col("id") % 300).alias("document_id"))
    mentions = mentions.unionByName(mentions)
    gone, entities = spark.range(0, 300, 4).toDF("document_id"), spark.range(9).select(F.col("id").alias("entity_id"), F.lit(0).alias("doc_freq"))
    left, kept, _ = graph.without_documents(entities, mentions, mentions, gone)
    plain = mentions.join(gone, "document_id", "left_anti").groupBy("entity_id").agg(F.count_distinct("document_id").alias("n"))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, plain.collect()))
    assert kept.rdd.getNumPartitions() == 40
