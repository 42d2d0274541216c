"""Office files to blocks by the standard library: each is a zip of XML parts.

A block is (text, heading, is_table, verbatim), as in `parsers`. An empty file has no blocks; what is no zip raises.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .parsers import cell

Block = tuple[str, str, bool, bool]
#: Placeholders that are a slide's title, and those that are no content.
TITLES, DECOR = ("title", "ctrTitle"), ("dt", "ftr", "hdr", "sldNum")


def bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attribute(node: ElementTree.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if bare(k) == name), None)


def below(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    """The first child along a path of names."""
    for name in path:
        node = None if node is None else next((c for c in node if bare(c.tag) == name), None)
    return node


def children(node: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if node is None else [c for c in node if bare(c.tag) == name]


class Parts:
    """The XML parts of a file, and what a part's relations lead to."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError(f"not an office file: {e}") from e
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def related(self, name: str) -> dict[str, str]:
        folder, file = posixpath.split(name)
        rels = self.xml(f"{folder}/_rels/{file}.rels")
        at = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): at(r.get("Target")) for r in (rels if rels is not None else [])}


def words(node: ElementTree.Element, line: str) -> str:
    """The text of a paragraph's runs; tabs and breaks as characters."""
    shown = {"t": lambda n: n.text or "", "tab": lambda n: "\t", "br": lambda n: line, "cr": lambda n: line}
    return "".join(shown[bare(n.tag)](n) for n in node.iter() if bare(n.tag) in shown and not (bare(n.tag) == "tab" and n.attrib))


def table_block(rows: list[list[str]], heading: str) -> list[Block]:
    text = "\n".join("\t".join(r) for r in rows)
    return [(text, heading, True, False)] if text else []


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs, headings among them, each a block under the path of headings; then the tables, under the last path.

    A cell over several columns is repeated in each, an empty one that goes on from above has what is above it.
    """
    if not data:
        return []
    parts = Parts(data)
    styles = {attribute(s, "styleId"): (attribute(below(s, "name"), "val") or "").lower() for s in children(parts.xml("word/styles.xml"), "style")}
    body = below(parts.xml("word/document.xml"), "body")
    out: list[Block] = []
    path: list[str] = []
    for p in children(body, "p"):
        text = words(p, "\n").strip()
        if not text:
            continue
        style = attribute(below(p, "pPr", "pStyle"), "val") or ""
        name = styles.get(style, re.sub(r"(?<=[a-z])(?=\d)", " ", style.lower()))
        if name.startswith("heading"):
            level = name.removeprefix("heading").strip()
            path[(int(level) if level.isdecimal() else 1) - 1 :] = [text]
        out.append((text, "/".join(path), False, False))
    for t in children(body, "tbl"):
        grid: list[list[str]] = []
        for row in children(t, "tr"):
            line: list[str] = []
            for c in children(row, "tc"):
                text = cell("\n".join(words(p, "\n") for p in children(c, "p")))
                merge = below(c, "tcPr", "vMerge")
                goes_on = merge is not None and attribute(merge, "val") in (None, "continue")
                for _ in range(int(attribute(below(c, "tcPr", "gridSpan"), "val") or 1)):
                    above = grid[-1][len(line)] if grid and len(line) < len(grid[-1]) else ""
                    line.append(above if goes_on and not text else text)
            grid.append(line)
        out += table_block(grid, "/".join(path))
    return out


def place(reference: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B3."""
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return int(row) - 1, column - 1


def xlsx_blocks(data: bytes) -> list[Block]:
    """A table for each sheet that has cells, under its title; a merged range has its first cell's value throughout.

    Values are as they are stored: a date is its number.
    """
    if not data:
        return []
    parts = Parts(data)
    strings = ["".join(t.text or "" for t in s.iter() if bare(t.tag) == "t") for s in children(parts.xml("xl/sharedStrings.xml"), "si")]
    related = parts.related("xl/workbook.xml")

    def value(c: ElementTree.Element) -> str:
        kind, v = c.get("t"), below(c, "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if bare(t.tag) == "t")
        raw = "" if v is None else v.text or ""
        return strings[int(raw)] if kind == "s" and raw else {"1": "True", "0": "False"}.get(raw, raw) if kind == "b" else raw

    out: list[Block] = []
    for sheet in children(below(parts.xml("xl/workbook.xml"), "sheets"), "sheet"):
        page = parts.xml(related[attribute(sheet, "id")])
        found = {place(c.get("r")): value(c) for r in children(below(page, "sheetData"), "row") for c in children(r, "c")}
        if not found:
            continue
        high, wide = (max(p[i] for p in found) + 1 for i in (0, 1))
        for m in children(below(page, "mergeCells"), "mergeCell"):
            (top, left), (bottom, right) = (place(x) for x in m.get("ref").split(":"))
            if found.get((top, left)):
                found |= {(r, c): found[top, left] for r in range(top, min(bottom + 1, high)) for c in range(left, min(right + 1, wide))}
        out += table_block([[cell(found.get((r, c), "")) for c in range(wide)] for r in range(high)], sheet.get("name"))
    return out


def leaves(shapes: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for shape in shapes:
        if bare(shape.tag) == "grpSp":
            yield from leaves(shape)
        elif bare(shape.tag) in ("sp", "graphicFrame"):
            yield shape


def pptx_blocks(data: bytes) -> list[Block]:
    """Each slide's title, then its paragraphs and tables, under 第N页 and the title; groups are opened, page numbers and
    the like left out."""
    if not data:
        return []
    parts = Parts(data)
    related = parts.related("ppt/presentation.xml")
    out: list[Block] = []
    for number, slide in enumerate(children(below(parts.xml("ppt/presentation.xml"), "sldIdLst"), "sldId"), 1):
        # Two attributes are named id; the relation's is the qualified one.
        key = next(v for k, v in slide.attrib.items() if k.startswith("{") and bare(k) == "id")
        shapes = list(leaves(below(parts.xml(related[key]), "cSld", "spTree")))
        kind = lambda s: attribute(below(s, "nvSpPr", "nvPr", "ph"), "type")
        lines = lambda s: [words(p, "\v") for p in children(below(s, "txBody"), "p")]
        title = next(("\n".join(lines(s)) for s in shapes if kind(s) in TITLES), "")
        heading = f"第{number}页 / {' '.join(title.split())}" if title.split() else f"第{number}页"
        if title.strip():
            out.append((title.strip(), heading, False, False))
        for s in shapes:
            if kind(s) in TITLES or kind(s) in DECOR:
                continue
            table = below(s, "graphic", "graphicData", "tbl")
            if table is not None:
                out += table_block([[cell("\n".join(words(p, "\n") for p in children(below(c, "txBody"), "p"))) for c in children(r, "tc")] for r in children(table, "tr")], heading)
            out += [(p.strip(), heading, False, False) for p in lines(s) if p.strip()]
    return out
