"""Links of stored pages: extraction, resolution, scope rules, reachability, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.operators.rows import fresh_path, size_checked, staged


def in_scope(path: Column, allow: list[str], deny: list[str]) -> Column:
    """Path prefixes: a denied one never; without allowed ones any other."""
    starts = lambda prefixes: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(path, p)) if prefixes else F.lit(False)
    return ~starts(deny) & (starts(allow) if allow else F.lit(True))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): the pages' hrefs made absolute, without fragments; mail and script links are left out."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]*)"""), F.lit(1))).alias("href")
    each = pages.select("page_id", "url", href).where("href <> '' AND NOT lower(href) RLIKE '^(mailto|javascript|tel|data):'")
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    absolute = (
        F.when(F.rlike("href", F.lit("(?i)^https?://")), F.col("href"))
        .when(F.startswith("href", F.lit("//")), F.concat(F.regexp_extract("url", "^(https?:)", 1), "href"))
        .when(F.startswith("href", F.lit("/")), F.concat(origin, "href"))
        .otherwise(F.concat(folder, "href"))
    )
    return each.select("page_id", "url", absolute.alias("link"))


def reachable(edges: DataFrame, entries: DataFrame, cap: int | None = None) -> DataFrame:
    """(node, depth) reachable from entries (node) along edges (src, dst), breadth first, over as many levels as there are.

    With `cap` the walk ends at that many nodes; of the level that passes it the smallest are taken. Each level is written to
    the shared folder, so that a level's plan reads the ones before instead of repeating them.
    """
    spark = edges.sparkSession
    edges = staged(edges.select("src", "dst").distinct())
    path = fresh_path(spark, "levels")
    entries.select("node").distinct().withColumn("depth", F.lit(0)).write.parquet(f"{path}/0")
    levels = [spark.read.parquet(f"{path}/0")]
    total = levels[0].count()
    while cap is None or total < cap:
        seen = spark.read.schema(levels[0].schema).parquet(*(f"{path}/{i}" for i in range(len(levels))))
        new = edges.join(size_checked(levels[-1].select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(len(levels)))
        new = new if cap is None else new.orderBy("node").limit(cap - total)
        new.write.parquet(f"{path}/{len(levels)}")
        level = spark.read.schema(levels[0].schema).parquet(f"{path}/{len(levels)}")
        found = level.count()
        if not found:
            break
        levels.append(level)
        total += found
    return spark.read.schema(levels[0].schema).parquet(*(f"{path}/{i}" for i in range(len(levels))))
