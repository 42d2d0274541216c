"""Answer texts: refusals and event streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a refusal, and how many characters may stand between them.
NO_ANSWER, BASE = "知识库中未找到相关内容", "知识库"
APOLOGIES = ("抱歉", "对不起", "不好意思")
DENIALS = ("未", "没有", "无法", "没能", "尚未", "暂未")
FOUND = ("找到", "检索到", "收录", "包含", "涵盖", "提及", "说明", "规定", "提供")
THINGS = ("内容", "正文", "说明", "记录", "条目", "资料")
PARTLY = ("未找到", "没有", "未提及", "未说明", "未收录", "未出现", "无法确认")
TOPICS = ("关于", "对于", "就", "针对")
MISSING = ("未找到", "未收录", "未提及", "未说明", "未出现", "未涉及", "无法确认", "查无")
QUALIFIER, BEFORE_VERB, BEFORE_THING, BEFORE_REST, TOPIC_CHARS = 12, 20, 30, 30, 40


def _any(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


def _gap(most: int, least: int = 0) -> str:
    """Characters of one sentence."""
    return f"[^。！？]{{{least},{most}}}?"


def denies(sentence: Column) -> Column:
    """The knowledge base has, says or lists nothing of the kind; a number or an apology may come first. A denial alone isn't enough."""
    start = rf"^(?:\d+[.、,)）])?(?:{_any(APOLOGIES)}[，,]?)?{BASE}{_gap(QUALIFIER)}{_any(DENIALS)}"
    return F.rlike(sentence, F.lit(f"{start}{_gap(BEFORE_VERB)}{_any(FOUND)}")) | F.rlike(sentence, F.lit(f"{start}关于{_gap(BEFORE_THING)}的(?:任何)?{_any(THINGS)}"))


def confirms_in_part(sentence: Column) -> Column:
    """The knowledge base only tells one thing, and the rest is missing."""
    return F.rlike(sentence, F.lit(f"{BASE}[中里内]?[仅只]{_gap(BEFORE_REST)}{_any(PARTLY)}"))


def denies_a_topic(sentence: Column) -> Column:
    """The topic comes first, then that the knowledge base doesn't have it. That it has "no" such thing may be an answer."""
    return F.rlike(sentence, F.lit(f"^{_any(TOPICS)}{_gap(TOPIC_CHARS, 1)}[，,]{BASE}[中里内]?{_gap(QUALIFIER)}{_any(MISSING)}"))


def is_no_answer(text: Column) -> Column:
    """Whether the first sentence refuses; headings at the start, markup, citations and white space aside. A null or empty text doesn't."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^(?:(?:[ \t]*#{1,6}[^\n]*|[\s　&&[^\n]]*)(?:\n|$))+", "")
    plain = F.regexp_replace(body, r"[*_`#>~|]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<![A-Za-z0-9_.\]])\[\d+\]", ""), r"[​-‏﻿\s　]", "")
    first = F.regexp_extract(plain, "^([^。！？；]*)", 1)
    return F.startswith(plain, F.lit(NO_ANSWER)) | denies(first) | confirms_in_part(first) | denies_a_topic(first)


def stream_records(text: Column) -> Column:
    """Blocks of an event stream as (event, data)."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), lambda b: F.trim(b) != "")
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event:\s*(\w+)", 1).alias("event"), F.regexp_extract(b, r"(?m)^data:\s*(.*)$", 1).alias("data")))
