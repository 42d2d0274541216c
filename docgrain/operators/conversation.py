"""Messages, memory and answers: histories, facts, grounding, watermark lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T

from .rows import top

PHRASES = ("内部资料", "机密文件", "严禁外传", "confidential", "internal use only", "do not distribute")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    return top(messages, ["conv_id"], [F.desc("turn")], n)


def history_within(messages: DataFrame, budget: int) -> DataFrame:
    """Turns from the newest back while their estimated tokens fit; the newest always."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    seen = messages.withColumn("_sum", F.sum(T.token_estimate(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(w))
    return seen.where((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_sum", "_n")


def merged_facts(facts: DataFrame, keep: int = 20, prefix: int = 20) -> DataFrame:
    """Facts (user_id, pos, fact): of one prefix the first stays; then the last `keep`."""
    first = top(facts.withColumn("_p", F.substring("fact", 1, prefix)), ["user_id", "_p"], ["pos"], 1).drop("_p")
    return top(first, ["user_id"], [F.desc("pos")], keep)


def grounded(answers: DataFrame, key: str, text: str, valid: Column) -> DataFrame:
    """(key, text, dropped, status): lines that cite a number not in `valid` go; nothing left is UNGROUNDED."""
    lines = F.split(text, "\n")
    bad = lambda s: F.exists(T.cited(s), lambda n: ~F.array_contains(valid, n))
    kept = F.filter(lines, lambda s: ~bad(s))
    out = answers.select(key, F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped"))
    return out.withColumn("status", F.when(F.trim("text") == "", "UNGROUNDED").otherwise("OK"))


def citation_check(text: Column, retrieved: Column, least: int = 1, most: int = 8) -> Column:
    """(valid, hallucinated, insufficient) of the cited numbers."""
    numbers = T.cited(text)
    valid = F.slice(F.filter(numbers, lambda n: (n >= 1) & (n <= retrieved)), 1, most)
    return F.struct(valid.alias("valid"), F.filter(numbers, lambda n: (n < 1) | (n > retrieved)).alias("hallucinated"), (F.size(valid) < least).alias("insufficient"))


def demoted(rows: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Rows with an injection hit moved behind all others of their key; none is dropped. Adds `labels` and `n`."""
    flagged = rows.withColumn("labels", T.injection_labels(F.col(text)))
    return flagged.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.size("labels") > 0, place)))


def clean_watermarks(pages: DataFrame, key: str, text: str, longest: int = 60) -> DataFrame:
    """(key, text, removed, reverted): short lines that are no sentence and hold a phrase or repeat are removed, unless that
    would take more than 30 % without any phrase, or more than 90 %."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("norm", T.line_norm(F.col("line")))
    lines = lines.withColumn("times", F.count("*").over(Window.partitionBy(key, "norm")))
    phrase = F.exists(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(F.col("norm"), F.regexp_replace(p, " ", "")))
    mark = (F.col("norm") != "") & (F.length("norm") <= longest) & ~F.rlike("line", F.lit(T.SENTENCE_END)) & (phrase | (F.col("times") >= 2))
    lines = lines.withColumn("mark", mark).withColumn("phrase", phrase)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    size = F.length("norm")
    out = lines.groupBy(key).agg(kept.alias("kept"), whole.alias("whole"), F.count_if("mark").alias("removed"), F.count_if(F.col("mark") & F.col("phrase")).alias("hits"), (F.sum(F.when(F.col("mark"), size).otherwise(0)) / F.greatest(F.sum(size), F.lit(1))).alias("ratio"))
    reverted = (F.col("ratio") > 0.3) & ((F.col("hits") == 0) | (F.col("ratio") > 0.9))
    return out.select(key, F.when(reverted, F.col("whole")).otherwise(F.col("kept")).alias("text"), F.when(reverted, 0).otherwise(F.col("removed")).cast("long").alias("removed"), reverted.alias("reverted"))


def clean_page_lines(pages: DataFrame, doc: str, page: str, text: str, longest: int = 60, share: float = 0.3) -> DataFrame:
    """(doc, page, text) without the short lines that repeat on many pages of a document and are no sentence."""
    counts = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    lines = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("norm", T.line_norm(F.col("line")))
    often = lines.where((F.col("norm") != "") & (F.length("norm") <= longest)).select(doc, page, "norm").distinct().groupBy(doc, "norm").agg(F.count("*").alias("on"))
    often = often.join(counts, doc).where((F.col("pages") >= 2) & (F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share)))).select(doc, "norm", F.lit(True).alias("often"))
    marked = lines.join(often, [doc, "norm"], "left").withColumn("gone", F.coalesce("often", F.lit(False)) & ~F.rlike("line", F.lit(T.SENTENCE_END)))
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy(doc, page).agg(kept.alias("text"), F.count_if("gone").alias("removed"))
