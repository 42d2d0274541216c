"""Folders of files as tables, and routing by file kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES, TEXTS = ("png", "jpg", "jpeg", "bmp", "webp", "gif", "tiff"), ("txt", "md", "markdown", "html", "htm", "pdf", "docx", "pptx", "xlsx", "xls")
PREVIEW_CHARS, NOTICE = 200_000, "\n\n…（预览已截断）"


def scan_folder(spark: SparkSession, root: str, patterns: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, mtime, size[, content]) of all files below `root` that match a pattern, version folders left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if patterns:
        reader = reader.option("pathGlobFilter", "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0])
    files = reader.load(root).where(~F.contains("path", F.lit("/.git/")))
    return files.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parser_of(ext: Column) -> Column:
    """The parser for a file kind; an unknown kind raises when its row is read."""
    known = F.when(ext == "txt", "text").when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").when(ext.isin("pdf", "docx", "pptx", "xlsx", "xls"), ext).when(ext.isin(*IMAGES), "image")
    return known.otherwise(F.raise_error(F.concat(F.lit("unsupported file kind: "), ext)))


def modality(ext: Column, has_images: Column, source_type: Column) -> Column:
    return F.when(source_type == "web", "web").when(has_images, "mixed").when(ext.isin(*IMAGES), "image").when(ext.isin(*TEXTS), "text").otherwise("unsupported")


def preview(text: Column, most: int = PREVIEW_CHARS) -> Column:
    """The start of a long text with a notice."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(NOTICE))).otherwise(text)


def single_kind(files: DataFrame, by: str, ext: str) -> DataFrame:
    """Batches (by, kinds, accepted): a batch must hold one kind of file."""
    return files.groupBy(by).agg(F.count_distinct(ext).alias("kinds")).withColumn("accepted", F.col("kinds") == 1)


def object_key(tenant: Column, kb: Column, group: Column, version: Column, name: Column) -> Column:
    """Where an object store keeps a document's version."""
    return F.concat_ws("/", tenant, kb, group, F.concat(F.lit("v"), version.cast("string")), name)
