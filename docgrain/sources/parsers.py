"""Documents to blocks: plain text as Columns; markdown and HTML by small row functions.

A block is (text, heading, is_table, verbatim). Texts, not bytes, are parsed; NUL characters are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docgrain.operators.rows import bounded_batches

BLOCKS = "array<struct<text:string,heading:string,is_table:boolean,verbatim:boolean>>"
# Elements that are no content.
NOISE = frozenset({"script", "style", "nav", "footer", "header", "noscript", "iframe", "form"})
PROSE = frozenset({"p", "li", "blockquote", "figcaption"})
IMAGE = "[图片] "


def text_blocks(text: Column) -> Column:
    """Paragraphs parted by an empty line, trimmed; empty ones dropped."""
    parts = F.split(F.translate(text, "\0", ""), "\n\n")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def note(alt: str | None) -> str:
    words = " ".join((alt or "").split())
    return IMAGE + words if words else ""


_IMAGES = (
    (re.compile(r"\[!\[([^\]\n]*)\]\([^)\n]*\)\]\([^)\n]*\)"), lambda m: note(m[1])),
    (re.compile(r"!\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)"), lambda m: note(m[1])),
    (re.compile(r"!\[([^\]\n]*)\]\[[^\]\n]*\]"), lambda m: note(m[1])),
    (re.compile(r"<img\b[^>\n]*>", re.I), lambda m: note(next((a or b for a, b in re.findall(r"""alt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[0], re.I)), ""))),
)


def plain_images(text: str) -> str:
    """Image markup as its alternative text; without one it goes."""
    for pattern, shown in _IMAGES:
        text = pattern.sub(shown, text)
    return text


@F.pandas_udf(StringType())
def image_text(text: pd.Series) -> pd.Series:
    """`plain_images` of a column; null stays null."""
    return text.map(lambda t: None if t is None else plain_images(t))


def cell(text: str) -> str:
    return re.sub(r"[\t\r\n]", " ", plain_images(text)).strip()


def markdown_blocks(text: str) -> list[tuple[str, str, bool, bool]]:
    """Headings make a path; fences, formulas and lists stay as they are; pipe tables become tab-separated rows."""
    lines = text.replace("\0", "").split("\n")
    out: list[tuple[str, str, bool, bool]] = []
    path: list[tuple[int, str]] = []
    prose: list[str] = []

    def emit(body: str, table: bool = False, verbatim: bool = False) -> None:
        if body.strip():
            out.append((body, " > ".join(t for _, t in path), table, verbatim))

    def flush() -> None:
        emit(plain_images("\n".join(prose)).strip())
        prose.clear()

    def closing(start: int, test: Callable[[str], bool]) -> int | None:
        return next((j for j in range(start, len(lines)) if test(lines[j])), None)

    at = 0
    while at < len(lines):
        line = lines[at]
        if m := re.match(r"^(#{1,6})\s+(.*)$", line):
            flush()
            level = len(m[1])
            path[:] = [p for p in path if p[0] < level] + [(level, m[2].strip())]
            at += 1
            continue
        fence = re.match(r"^\s*(`{3,}|~{3,})", line)
        if fence or re.match(r"^\s*\$\$\s*$", line):
            same = re.compile(rf"^\s*{re.escape(fence[1][0])}{{{len(fence[1])},}}") if fence else re.compile(r"^\s*\$\$\s*$")
            end = closing(at + 1, lambda s: bool(same.match(s)))
            if end is None:  # never closed: all of it is prose
                prose.extend(lines[at:])
                break
            flush()
            emit("\n".join(lines[at + 1 : end]).strip("\n"), verbatim=True)
            at = end + 1
            continue
        if re.match(r"^\s*([-*+]|\d+[.)])\s+", line):
            end = closing(at + 1, lambda s: not re.match(r"^\s*([-*+]|\d+[.)])\s+|^\s+\S", s)) or len(lines)
            flush()
            emit("\n".join(lines[at:end]), verbatim=True)
            at = end
            continue
        if re.match(r"^\s*\|.*\|\s*$", line) and at + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]*-[\s:|-]*\|\s*$", lines[at + 1]):
            end = closing(at + 2, lambda s: not re.match(r"^\s*\|.*\|\s*$", s)) or len(lines)
            rows = [[cell(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", r.strip().removeprefix("|").removesuffix("|"))] for r in [line, *lines[at + 2 : end]]]
            if len(rows) > 1 and any(rows[0]):
                flush()
                emit("\n".join("\t".join(r) for r in rows), table=True)
            else:
                prose.extend(lines[at:end])
            at = end
            continue
        prose.append(line)
        at += 1
    flush()
    return out


class _Page(HTMLParser):
    """Streams a page into blocks; a table is gathered as a grid with its spans filled."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, bool, bool]] = []
        self.path: list[str] = []
        self.noise = self.tables = 0
        self.open: list[tuple[str, list[str]]] = []
        self.rows: list[list[tuple[str, int, int]]] = []

    def heading(self) -> str:
        return "/".join(self.path)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = dict(attrs)
        if tag in NOISE:
            self.noise += 1
        if self.noise:
            return
        if tag == "img":
            text = note(at.get("alt"))
            if self.open:
                self.open[-1][1].append(text)
            elif text:
                self.out.append((text, self.heading(), False, False))
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif tag == "tr" and self.tables == 1:
            self.close({"td", "th"})
            self.rows.append([])
        elif tag in ("td", "th") and self.tables == 1:
            self.close({"td", "th"})
            self.spans = tuple(int(at.get(k) or 1) if (at.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))
            self.open.append((tag, []))
        elif not self.tables and (tag in PROSE or tag == "pre" or re.fullmatch("h[1-6]", tag)):
            self.close({"p"} if tag != "li" else {"p", "li"})
            self.open.append((tag, []))

    def close(self, tags: set[str]) -> None:
        while self.open and self.open[-1][0] in tags:
            tag, parts = self.open.pop()
            raw = "".join(parts)
            text = raw.strip("\n") if tag == "pre" else " ".join(raw.split())
            if tag in ("td", "th"):
                if self.rows:
                    self.rows[-1].append((text, *self.spans))
            elif re.fullmatch("h[1-6]", tag):
                del self.path[int(tag[1]) - 1 :]
                self.path += [text] if text else []
            elif text.strip():
                self.out.append((text, self.heading(), False, tag == "pre"))

    def handle_endtag(self, tag: str) -> None:
        if tag in NOISE:
            self.noise = max(0, self.noise - 1)
        elif self.noise:
            return
        elif tag == "table" and self.tables:
            if self.tables == 1:
                self.close({"td", "th"})
                grid = filled(self.rows)
                if len(grid) > 1 and any(grid[0]):
                    self.out.append(("\n".join("\t".join(cell(c) for c in r) for r in grid), self.heading(), True, False))
            self.tables -= 1
        elif any(t == tag for t, _ in self.open):
            while self.open and self.open[-1][0] != tag:
                self.close({self.open[-1][0]})
            self.close({tag})

    def handle_data(self, data: str) -> None:
        if not self.noise and self.open:
            self.open[-1][1].append(data)


def filled(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A grid of (text, rowspan, colspan) cells with every covered place filled."""
    grid: list[list[str]] = []
    hanging: dict[int, tuple[str, int]] = {}
    for row in rows:
        line: list[str] = []
        cells = iter(row)
        while True:
            if (c := len(line)) in hanging:
                text, left = hanging.pop(c)
                line.append(text)
                if left > 1:
                    hanging[c] = (text, left - 1)
                continue
            item = next(cells, None)
            if item is None:
                break
            text, down, across = item
            for _ in range(across):
                if down > 1:
                    hanging[len(line)] = (text, down - 1)
                line.append(text)
        if line:
            grid.append(line)
    return grid


def html_blocks(html: str) -> list[tuple[str, str, bool, bool]]:
    page = _Page()
    page.feed(html.replace("\0", ""))
    HTMLParser.close(page)
    while page.open:
        page.close({page.open[-1][0]})
    return page.out


def parsed(documents: DataFrame, text: str, parse: Callable[[str], list]) -> DataFrame:
    """`documents` with `blocks` in place of the text column."""
    bounded_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c != text]

    @F.pandas_udf(BLOCKS)
    def blocks(column: pd.Series) -> pd.Series:
        names = ("text", "heading", "is_table", "verbatim")
        return column.map(lambda t: [dict(zip(names, b)) for b in parse(t or "")])

    return documents.select(*kept, blocks(F.col(text)).alias("blocks"))


def exploded(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != "blocks"]
    return rows.select(*kept, F.posexplode("blocks").alias("block_no", "b")).select(*kept, "block_no", "b.*")
