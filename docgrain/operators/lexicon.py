"""Term lexicon and wiki navigation: alias lookup, term mining, page hits, term choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as T

from .automaton import finds
from .rows import top

# Fixed values that results depend on: budgets of navigation terms, and names with a name in the other script in brackets.
NAV_TERMS, NAV_TOKENS, TERM_CHARS = 2, 6, 12
CJK_FIRST = r"([一-鿿]{2,12})\s*[（(]\s*([A-Za-z][A-Za-z0-9_\-]{1,30})\s*[)）]"
ASCII_FIRST = r"([A-Za-z][A-Za-z0-9_\-]{1,30})\s*[（(]\s*([一-鿿]{2,12})\s*[)）]"
#: The same pairs from the first character of a run on: each run is tried once, not from each of its characters. The names are then
#: taken from what these match, which holds one pair at most.
CJK_WHOLE = r"(?<![一-鿿])[一-鿿]{2,}+\s*+[（(]\s*+[A-Za-z][A-Za-z0-9_\-]{1,30}+\s*+[)）]"
ASCII_WHOLE = r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{2,}+\s*+[（(]\s*+[一-鿿]{2,12}+\s*+[)）]"


def alias_lookup(lexicon: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, term) of entries (term, aliases) whose term or one of whose aliases is a key: two equality joins as one."""
    forms = lexicon.select("term", F.explode(F.array_append("aliases", F.col("term"))).alias("key"))
    return keys.join(forms, "key").distinct().select("key", "term")


def alias_map(lexicon: DataFrame, keys: DataFrame, most: int = 2) -> DataFrame:
    """(key, form): other forms of each key, at most `most`, in order of the form."""
    forms = lexicon.select("term", F.array_append("aliases", F.col("term")).alias("forms"))
    hits = keys.join(forms.select(F.explode("forms").alias("key"), "forms"), "key")
    others = hits.select("key", F.explode("forms").alias("form")).where("form <> key").distinct()
    return top(others, ["key"], ["form"], most)


def mined_terms(texts: DataFrame, least: int) -> DataFrame:
    """(kb_id, term, aliases, freq) from texts (kb_id, content): name pairs in brackets, and model codes with their other
    spellings; forms counted together, aliases collected, rare terms dropped."""

    def pairs(whole: str, pattern: str, term: int) -> Column:
        named = lambda m: F.struct(F.regexp_extract(m, pattern, term).alias("term"), F.array(F.regexp_extract(m, pattern, 3 - term)).alias("aliases"))
        return F.filter(F.transform(F.regexp_extract_all("content", F.lit(whole), F.lit(0)), named), lambda x: x["term"] != "")

    spelt = lambda c: F.struct(c.alias("term"), F.array(F.regexp_replace(c, "-", ""), F.regexp_replace(c, "-", " ")).alias("aliases"))
    codes = F.transform(F.regexp_extract_all(F.lower("content"), F.lit(T.MODEL_CODE), F.lit(0)), lambda c: spelt(F.regexp_replace(c, r"^([a-z]+)[-_ ]?(\d+)$", "$1-$2")))
    rows = texts.where("content IS NOT NULL").select("kb_id", F.explode(F.concat(pairs(CJK_WHOLE, CJK_FIRST, 1), pairs(ASCII_WHOLE, ASCII_FIRST, 2), codes)).alias("x")).select("kb_id", "x.*")
    counts = rows.groupBy("kb_id", "term").agg(F.count("*").alias("freq"), F.collect_set("aliases").alias("aliases"))
    return counts.where(F.col("freq") >= least).select("kb_id", "term", "freq", F.array_sort(F.array_distinct(F.flatten("aliases"))).alias("aliases"))


def rebuilt(lexicon: DataFrame, mined: DataFrame, kbs: DataFrame) -> DataFrame:
    """`lexicon` with all rows of the rebuilt knowledge bases (kb_id) replaced by what was mined for them, each term once."""
    kept = lexicon.join(kbs.select("kb_id").distinct(), "kb_id", "left_anti")
    return kept.unionByName(mined.join(kbs.select("kb_id").distinct(), "kb_id", "left_semi").dropDuplicates(["kb_id", "term"]))


def acceptable(term: Column) -> Column:
    """Long enough, not a stop word, not only digits and marks."""
    cjk = F.rlike(term, F.lit(f"^{T.CJK}+$"))
    long_enough = (F.length(term) >= F.when(cjk, 2).otherwise(4)) | (~cjk & F.contains(term, F.lit("_")))
    return (term != "") & (F.length(term) <= TERM_CHARS) & ~term.isin(*T.STOPWORDS) & (F.regexp_replace(term, r"[_\- 0-9]", "") != "") & long_enough


def nav_hits(page_terms: DataFrame, needles: DataFrame) -> DataFrame:
    """(document_id, term, needle), each once, where a page's term contains a needle, case aside: one automaton of all needles passes
    the terms, which may be repeated."""
    pages = page_terms.select("document_id", "term", F.lower("term").alias("text")).withColumnRenamed("term", "own")
    found = finds(pages, "text", needles.select(F.col("needle").alias("term")))
    return found.select("document_id", F.col("own").alias("term"), F.col("term").alias("needle")).distinct()


def nav_terms(pages: DataFrame) -> DataFrame:
    """(query_id, term, place) for rows (query_id, terms, query_terms, query, aliases): the page's terms that add to the
    question, longest first; at most two, whose index tokens fit six in all (a term that doesn't fit is passed over).

    The terms are read once; of each question and cost its two longest go on.
    """
    plain = F.transform(F.array_distinct("terms"), lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))))
    short = F.filter(F.array_distinct(plain), lambda t: (t != "") & (F.length(t) <= TERM_CHARS))
    each = pages.select("query_id", "query_terms", "query", "aliases", F.explode(short).alias("term"))
    known = F.array_contains("aliases", F.col("term")) | F.contains("query", F.col("term")) | F.exists("query_terms", lambda q: F.contains(q, F.col("term")) | F.contains(F.col("term"), q))
    good = each.where(acceptable(F.col("term")) & ~known)
    good = good.select("query_id", "term", F.size(T.index_tokens(F.col("term"))).alias("cost")).where(F.col("cost") <= NAV_TOKENS)
    # The longest, and the next that fits what is left of the budget: each is among the two longest of its cost.
    order = Window.partitionBy("query_id", "cost").orderBy(-F.length("term"), "term")
    few = good.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= NAV_TERMS)
    each = few.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("l"), "term", "cost"))).alias("x"))
    first = F.get("x", F.lit(0))
    second = F.slice(F.filter("x", lambda y, i: (i > 0) & (y["cost"] + first["cost"] <= NAV_TOKENS)), 1, NAV_TERMS - 1)
    chosen = each.select("query_id", F.posexplode(F.concat(F.array(first), second)).alias("at", "y"))
    return chosen.select("query_id", F.col("y.term").alias("term"), (F.col("at") + 1).alias("place"))


def leading_chunks(chunks: DataFrame, most: int, overhead: int = 16) -> DataFrame:
    """Whole chunks of each document in order while their characters fit `most`; the first always."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    size = F.length("content") + F.length("heading_path") + overhead
    seen = chunks.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(w))
    return seen.where((F.col("_n") == 1) | (F.col("_sum") <= most)).drop("_n", "_sum")


def clean_sections(sections: DataFrame, valid: DataFrame, most: int = 12) -> DataFrame:
    """Sections (document_id, place, heading, summary, chunk_id) with a heading, a summary and a chunk of the document; the
    first `most` of each document, with their valid chunk ids in order."""
    good = sections.where("trim(heading) <> '' AND trim(summary) <> ''").join(valid.select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_semi")
    whole = good.groupBy("document_id", "place", "heading").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return top(whole, ["document_id"], ["place"], most)
