"""Chunks of about 400 tokens, at most 800, with the tail of the last chunk carried over."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .rows import bounded_batches

TARGET, MOST, OVERLAP = 400, 800, 60
CHUNKS = "chunk_index int, content string, token_count int, heading string, group_id string"
_TOKEN = re.compile(r"[㐀-䶿一-鿿぀-ヿ가-힯]|[^\W㐀-䶿一-鿿぀-ヿ가-힯]+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[。！？!?])|(?<=[.!?])\s+|\n")
#: ASCII marks (a token each), and a table that puts spaces for them and for what the pattern takes as white space.
_MARKS = bytes(c for c in range(128) if re.fullmatch(r"[^\w\s]", chr(c)))
_SPACED = bytes(c if re.fullmatch(r"\w", chr(c)) else 32 for c in range(128)) + bytes(range(128, 256))


def count_tokens(text: str) -> int:
    """The engine's counter: each CJK character, word and mark is one. Any other may be passed instead."""
    if text.isascii():
        raw = text.encode()
        return len(raw) - len(raw.translate(None, _MARKS)) + len(raw.translate(_SPACED).split())
    return len(_TOKEN.findall(text))


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]


def cut(text: str, most: int) -> list[str]:
    """Pieces of at most `most` tokens by the engine's counter."""
    ends = [m.end() for m in _TOKEN.finditer(text)]
    if not ends:
        return [text] if text.strip() else []
    marks = [0, *ends[most - 1 : -1 : most], len(text)]
    return [p for a, b in zip(marks, marks[1:]) if (p := text[a:b].strip())]


def packed_lines(lines: list[str], most: int, count: Callable[[str], int], head: str = "") -> list[str]:
    """Lines joined up to `most` tokens, each group under `head` if that fits; longer lines are cut first."""
    cost = count(head) if head else 0
    room = most - cost if cost < most else most
    head = head if cost < most else ""
    out, held, total = [], [], 0
    for line in (p for x in lines for p in ([x] if count(x) <= room else cut(x, room))):
        n = count(line)
        if held and total + n > room:
            out.append("\n".join([head, *held] if head else held))
            held, total = [], 0
        held.append(line)
        total += n
    return [*out, "\n".join([head, *held] if head else held)] if held else out


def units(text: str, is_table: bool, verbatim: bool, count: Callable[[str], int], most: int) -> list[str]:
    """Parts of a block, none over `most` tokens: a table whole or by rows under its header, verbatim text by lines, prose by
    paragraphs, sentences, then anywhere."""
    if is_table:
        header, *rows = text.split("\n")
        return [text] if count(text) <= most else packed_lines(rows, most, count, header) or cut(header, most)
    if verbatim:
        return packed_lines(text.strip("\n").split("\n"), most, count)
    out = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        for part in [para] if count(para) <= most else sentences(para):
            out += [part] if count(part) <= most else cut(part, most)
    return [u for u in out if u]


@F.pandas_udf(ArrayType(StringType()))
def sentence_list(text: pd.Series) -> pd.Series:
    """The sentences of each text."""
    return text.map(lambda t: sentences(t or ""))


@F.pandas_udf(ArrayType(IntegerType()))
def unit_sizes(text: pd.Series, is_table: pd.Series, verbatim: pd.Series) -> pd.Series:
    """Tokens of each of a block's units."""
    return pd.Series([[count_tokens(u) for u in units(t or "", x, v, count_tokens, MOST)] for t, x, v in zip(text, is_table, verbatim)])


def chunked(blocks: list[dict], key: str = "", count: Callable[[str], int] = count_tokens, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[tuple]:
    """(content, tokens, heading, group) of a document's blocks. No unit is ever lost; units of one table that was split
    share a group id, made from the document and the block."""
    line = []
    for i, b in enumerate(blocks):
        parts = units(b["text"], b["is_table"], b["verbatim"], count, most)
        group = f"{key}:{i}" if b["is_table"] and len(parts) > 1 else None
        line += [(p, count(p), b["heading"], group) for p in parts]
    out, carried, at = [], [], 0
    while at < len(line):
        held, total = list(carried), sum(u[1] for u in carried)
        if held and total + line[at][1] > most:
            held, total = [], 0
        while at < len(line) and (not held or total + line[at][1] <= most):
            held.append(line[at])
            total += line[at][1]
            at += 1
            if total >= target:
                break
        groups = {u[3] for u in held}
        content = "\n\n".join(u[0] for u in held)
        # No token spans an empty line, so the engine's own counts add up.
        out.append((content, total if count is count_tokens else count(content), held[0][2] or held[-1][2], groups.pop() if len(groups) == 1 else None))
        carried, tail = [], 0
        for u in reversed(held):
            if tail >= overlap:
                break
            carried.insert(0, u)
            tail += u[1]
    return out


def chunk_documents(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of `documents` (key, blocks); each document is chunked where it lies, nothing is shuffled."""
    bounded_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *c[:3], c[3]) for k, blocks in zip(pdf[key], pdf["blocks"]) for i, c in enumerate(chunked(list(blocks), str(k)))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content", "token_count", "heading", "group_id"])

    return documents.select(key, "blocks").mapInPandas(run, f"{key} {kind}, {CHUNKS}")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words that share `overlap` words; the last may be shorter. An array of texts."""
    words = F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - overlap, F.lit(1)), F.lit(step))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))
