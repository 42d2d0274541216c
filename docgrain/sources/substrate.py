"""Retrieval tables derived from the driver's tables by column arithmetic, as DataFrames and as SQL for the oracle.

Chunks are rows of `documents` (four to a document, the source as knowledge base), with the vectors of `embeddings`
where there is one; questions are rows of `benchmark`; `events` stand for audit records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.operators.rows import bounded_batches, size_checked

DIM = 64
PRINCIPALS = (
    (0, "main", 20, ("public", "user:0", "group:1"), tuple(f"src{i}" for i in range(5))),
    (1, "main", 40, ("public", "user:1", "group:4", "dept:/2/"), tuple(f"src{i}" for i in range(10))),
    (2, "main", 10, ("public", "user:2"), ()),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Python functions over its columns get batches that are bounded by bytes."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def chunks(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    i = F.col("doc_id")
    out = documents(spark, sf_dir).select(
        i.alias("chunk_id"),
        F.floor(i / 4).alias("document_id"),
        (i % 4).cast("int").alias("chunk_index"),
        F.col("source").alias("kb_id"),
        F.when(i % 50 == 49, "other").otherwise("main").alias("tenant_id"),
        F.col("text").alias("content"),
        F.concat("lang", F.lit("/"), (i % 5).cast("string")).alias("heading_path"),
        F.when(i % 6 == 0, None).otherwise(i % 9).cast("int").alias("page_no"),
        (10 * (1 + i % 4)).cast("int").alias("level_rank"),
        F.when(i % 3 == 0, F.array(F.lit("public"))).when(i % 3 == 1, F.array(F.concat(F.lit("group:"), (i % 5).cast("string")))).otherwise(F.array(F.concat(F.lit("dept:/"), (i % 5).cast("string"), F.lit("/")))).alias("acl_tags"),
        F.when(i % 7 == 0, F.array(F.concat(F.lit("user:"), (i % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("deny_subjects"),
        (i % 11 != 0).alias("is_latest"),
        F.when(i % 6 == 0, None).otherwise(i % 21 - 10).cast("int").alias("governance_weight"),
        F.greatest(F.lit(1), F.floor(F.length("text") / 2)).cast("int").alias("token_count"),
        F.when(i % 5 == 0, F.concat(F.lit("g"), F.floor(i / 20).cast("string"))).alias("table_group_id"),
    )
    return out.join(chunk_vectors(spark, sf_dir), "chunk_id", "left") if with_vectors else out


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("label") % 2 == 0, "m1").otherwise("m2")
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding", model.alias("embedding_model"))


def principals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, list(d), list(e)) for a, b, c, d, e in PRINCIPALS], "principal_id int, p_tenant string, clearance int, subjects array<string>, kbs array<string>")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), (F.col("item_id") % 3).cast("int").alias("principal_id"))


def with_query_vectors(asked: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked.join(size_checked(vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_embedding"))), "query_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records: the JSON key as a number, and an instant."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


# The same tables for the oracle.
_LISTS = ", ".join(f"({a}, '{b}', {c}, [{', '.join(repr(x) for x in d)}]::VARCHAR[], [{', '.join(repr(x) for x in e)}]::VARCHAR[])" for a, b, c, d, e in PRINCIPALS)
CTE = {
    "chunks": """chunks AS (
  SELECT doc_id AS chunk_id, doc_id // 4 AS document_id, (doc_id % 4)::INTEGER AS chunk_index, source AS kb_id, CASE WHEN doc_id % 50 = 49 THEN 'other' ELSE 'main' END AS tenant_id,
    text AS content, lang || '/' || (doc_id % 5) AS heading_path, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 9 END::INTEGER AS page_no, (10 * (1 + doc_id % 4))::INTEGER AS level_rank,
    CASE doc_id % 3 WHEN 0 THEN ['public'] WHEN 1 THEN ['group:' || (doc_id % 5)] ELSE ['dept:/' || (doc_id % 5) || '/'] END AS acl_tags,
    CASE WHEN doc_id % 7 = 0 THEN ['user:' || (doc_id % 3)] ELSE []::VARCHAR[] END AS deny_subjects, doc_id % 11 <> 0 AS is_latest,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 21 - 10 END::INTEGER AS governance_weight, greatest(1, length(text) // 2)::INTEGER AS token_count,
    CASE WHEN doc_id % 5 = 0 THEN 'g' || (doc_id // 20) END AS table_group_id FROM documents)""",
    "principals": f"principals AS (SELECT * FROM (VALUES {_LISTS}) v(principal_id, p_tenant, clearance, subjects, kbs))",
    "visible": """visible AS (SELECT p.principal_id, c.* FROM principals p JOIN chunks c ON list_contains(p.kbs, c.kb_id) AND c.tenant_id = p.p_tenant AND c.is_latest AND c.level_rank <= p.clearance
    AND NOT list_has_any(c.deny_subjects, p.subjects) AND list_has_any(c.acl_tags, p.subjects))""",
    "questions": "questions AS (SELECT item_id AS query_id, text AS question, (item_id % 3)::INTEGER AS principal_id FROM benchmark)",
    "audit": "audit AS (SELECT event_id, ts, user_id, event_type AS action, value, (props->>'$.k')::INTEGER AS k, props FROM events)",
}


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
