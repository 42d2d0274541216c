"""Incremental ingestion: fingerprints, version chains, retirement, replacement, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import size_checked


def unchanged(etag: Column, old_etag: Column, modified: Column, old_modified: Column, content: Column, old_content: Column) -> Column:
    """Any level that both sides have and that is equal."""
    same = lambda a, b: F.coalesce((a != "") & (a == b), F.lit(False))
    return same(etag, old_etag) | same(modified, old_modified) | same(content, old_content)


def web_changes(synced: DataFrame, found: DataFrame, complete: Column) -> DataFrame:
    """(url, action, version) from the synced state (url, etag, modified, content_hash, version, live) and the pages found
    (url, etag, modified, content_hash): new, changed, revived, unchanged, retired or kept.

    A page that wasn't found is retired only if discovery was complete.
    """
    old = synced.select("url", *(F.col(c).alias(f"o_{c}") for c in ("etag", "modified", "content_hash", "version", "live")))
    both = old.join(found.withColumn("here", F.lit(True)), "url", "full")
    same = unchanged(F.col("etag"), F.col("o_etag"), F.col("modified"), F.col("o_modified"), F.col("content_hash"), F.col("o_content_hash"))
    action = (
        F.when(F.col("o_version").isNull(), "new")
        .when(F.col("here").isNull(), F.when(F.col("o_live") & complete, "retired").otherwise("kept"))
        .when(same, F.when(F.col("o_live"), "unchanged").otherwise("revived"))
        .otherwise("changed")
    )
    version = F.when(action == "new", 1).when(action == "changed", F.col("o_version") + 1).otherwise(F.col("o_version"))
    return both.select("url", action.alias("action"), version.cast("int").alias("version"))


def version_chain(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """(url, version, is_latest) after changes: a changed url gains a version and its older ones stop being the latest.

    `documents`: (url, version, top, is_latest), `top` the last version of a row's own chain. A url may have several chains; each
    change of it counts for all of them, and a revived chain's latest version is its own last one, not that of the page that came back.
    """
    moved = changes.select("url", "action")
    old = documents.join(moved, "url", "left")
    still = F.when(F.col("action").isin("changed", "retired"), False).when(F.col("action") == "revived", F.col("version") == F.col("top")).otherwise(F.col("is_latest"))
    added = changes.where("action IN ('new', 'changed')").select("url", "version", F.lit(True).alias("is_latest"))
    return old.select("url", "version", still.alias("is_latest")).unionByName(added)


def file_changes(synced: DataFrame, found: DataFrame) -> DataFrame:
    """(path, action) of local files by modification time and size; files that vanished are left alone."""
    both = found.join(synced.select("path", F.col("mtime").alias("o_mtime"), F.col("size").alias("o_size")), "path", "left")
    action = F.when(F.col("o_mtime").isNull(), "new").when((F.col("mtime") == F.col("o_mtime")) & (F.col("size") == F.col("o_size")), "unchanged").otherwise("changed")
    return both.select("path", action.alias("action"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with all rows of the keys in `new` replaced."""
    return old.join(size_checked(new.select(key).distinct()), key, "left_anti").unionByName(new)


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the documents in `gone`; entities without mentions go too."""
    out = {name: df.join(size_checked(gone), "document_id", "left_anti") if "document_id" in df.columns else df for name, df in tables.items()}
    if "entities" in out and "mentions" in out:
        out["entities"] = out["entities"].join(out["mentions"].select("entity_id").distinct(), "entity_id", "left_semi")
    return out


def write_documents(chunks: DataFrame, path: str) -> None:
    """Replace the partitions (document buckets) that `chunks` has rows of; others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
