"""The engine's front: ingest documents, search, expand, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import acl, chunking, graph, postings, recall, reports, rows
from .sources import parsers


class Engine:
    """Methods take and return DataFrames. Models (embedding, rerank) are functions on columns that the caller passes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def ingest(self, documents: DataFrame, kind: str) -> DataFrame:
        """Chunks with index text from documents (doc_id, text) of one kind: text, markdown or html."""
        if kind == "text":
            block = lambda t: F.struct(t.alias("text"), F.lit("").alias("heading"), F.lit(False).alias("is_table"), F.lit(False).alias("verbatim"))
            blocks = documents.select("doc_id", F.transform(parsers.text_blocks(F.col("text")), block).alias("blocks"))
        else:
            blocks = parsers.parsed(documents.select("doc_id", "text"), "text", {"markdown": parsers.markdown_blocks, "html": parsers.html_blocks}[kind])
        chunks = chunking.chunk_documents(blocks)
        return chunks.withColumn("fts_text", T.index_text(T.normalized(F.col("content")), T.normalized(F.col("heading"))))

    def index(self, path: str) -> postings.PostingIndex:
        """The stored inverted index of chunks at `path`, which ingestion keeps up with `replace` and `synced`."""
        return postings.PostingIndex(self.spark, path, T.index_tokens(F.lower("content")))

    def search(self, chunks: DataFrame, principals: DataFrame, questions: DataFrame, dim: int, rerank: Callable[[F.Column, F.Column], F.Column] | None = None, index: postings.PostingIndex | None = None) -> DataFrame:
        """Served rows of each question (query_id, principal_id, question, q_embedding); `rerank` scores (question, content); where it gives null for a
        row of a question, that question keeps the vector scores. Full text is searched in `index` where there is one."""
        seen = acl.secured(chunks, principals)
        asked = questions.withColumn("q", F.lower("question"))
        terms = recall.match_terms(asked, T.match_items(F.col("q")))
        lists = {
            "vector": recall.vector_recall(seen, asked, dim),
            "fts": recall.text_recall(index.asked(seen, terms) if index else recall.asked_postings(chunks, seen, T.index_tokens(F.lower("content")), terms), terms),
            "ilike": recall.substring_recall(chunks, seen, asked, T.substring_terms(F.col("q"))),
        }
        cands = recall.candidates(recall.fused(lists))
        scores = lists["vector"]
        if rerank:
            both = cands.join(asked.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
            scores = recall.reranked(both.select("query_id", "chunk_id", rerank(F.col("question"), F.col("content")).alias("score")), scores)
        return recall.served(cands, scores, chunks)

    def expand_graph(self, seeds: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame, principals: DataFrame) -> DataFrame:
        reached = graph.expand(seeds, relations).join(seeds.select("query_id", "principal_id").distinct(), "query_id")
        return graph.neighbours(reached, mentions, acl.secured(chunks, principals))

    def report_latency(self, audit: DataFrame, by: str, value: str) -> DataFrame:
        total = audit.groupBy(by).agg(F.count("*").alias("total"))
        return total.join(reports.latency_percentiles(audit, by, [value]), by)

    def release(self) -> int:
        """Delete what searches and reports have staged, once their results are written."""
        return rows.release(self.spark)
