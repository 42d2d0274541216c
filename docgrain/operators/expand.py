"""Context expansion: the rest of a table, the rest of a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import within_budget

TABLE_ROWS, TABLE_TOKENS, SECTION_ROWS, SECTION_TOKENS, HEADING_CHARS = 3, 2048, 3, 1200, 2


def table_rest(hits: DataFrame, seen: DataFrame, rows: int = TABLE_ROWS, budget: int = TABLE_TOKENS) -> DataFrame:
    """(query_id, table_group_id, chunk_id, chunk_index) of the groups of the hits, without the hits.

    `hits`: (query_id, principal_id, chunk_id); `seen`: readable chunks with principal_id.
    """
    group = seen.select("principal_id", "chunk_id", "table_group_id").where("table_group_id IS NOT NULL")
    wanted = hits.join(group, ["principal_id", "chunk_id"]).select("query_id", "principal_id", "table_group_id").distinct()
    rest = seen.where("table_group_id IS NOT NULL").select("principal_id", "table_group_id", "chunk_id", "chunk_index", "token_count")
    found = wanted.join(rest, ["principal_id", "table_group_id"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    kept = within_budget(found, ["query_id", "table_group_id"], ["chunk_index", "chunk_id"], "token_count", rows, budget)
    return kept.select("query_id", "table_group_id", "chunk_id", "chunk_index")


def section_rest(hits: DataFrame, seen: DataFrame, rows: int = SECTION_ROWS, budget: int = SECTION_TOKENS) -> DataFrame:
    """(query_id, chunk_id, place) of the hits' sections in hit order: at most `rows` of a section, which ends at the first
    chunk that the query's remaining budget doesn't cover; the budget carries over to the next section.

    `hits` has (query_id, principal_id, chunk_id, rank). Only a section's first `rows` chunks can count, so the fold over
    a query's rows is short.
    """
    about = seen.select("principal_id", "chunk_id", "document_id", F.trim(F.coalesce("heading_path", F.lit(""))).alias("heading"), "table_group_id", "chunk_index", "token_count")
    wanted = hits.join(about.where(f"table_group_id IS NULL AND length(heading) >= {HEADING_CHARS}"), ["principal_id", "chunk_id"])
    wanted = wanted.groupBy("query_id", "principal_id", "document_id", "heading").agg(F.min("rank").alias("section"))
    others = wanted.join(about.select("principal_id", "document_id", "heading", "chunk_id", "chunk_index", "token_count"), ["principal_id", "document_id", "heading"])
    others = others.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id", "section").orderBy("chunk_index", "chunk_id")
    first = others.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    line = F.array_sort(F.collect_list(F.struct("section", "chunk_index", "chunk_id", "token_count"))).alias("line")

    def step(acc, x):
        stopped = (acc["section"] == x["section"]) & acc["stopped"]
        fits = ~stopped & (x["token_count"] <= acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - x["token_count"]).otherwise(acc["left"]).alias("left"),
            x["section"].alias("section"),
            (stopped | ~fits).alias("stopped"),
            F.when(fits, F.array_append(acc["out"], x["chunk_id"])).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(budget).alias("left"), F.lit(-1).alias("section"), F.lit(False).alias("stopped"), F.array().cast("array<bigint>").alias("out"))
    return first.groupBy("query_id").agg(line).select("query_id", F.posexplode(F.aggregate("line", start, step)["out"]).alias("place", "chunk_id"))
