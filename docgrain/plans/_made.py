"""Small office files made of words, for plans that parse them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

_REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx_of(source: str, body: str, lang: str, a: str, b: str) -> bytes:
    p = lambda text, style="": f'<w:p><w:pPr>{style and f"""<w:pStyle w:val="{style}"/>"""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    c = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(text)}</w:tc>"
    table = f'<w:tbl><w:tr>{c("k", """<w:gridSpan w:val="2"/>""")}{c("v")}</w:tr><w:tr>{c(a, """<w:vMerge w:val="restart"/>""")}{c(b)}{c("x")}</w:tr><w:tr>{c("", "<w:vMerge/>")}{c("y")}{c(lang)}</w:tr></w:tbl>'
    text = p(source, "H1") + p(body) + p(lang, "Heading2") + p(f"{a}</w:t><w:t> {b}") + table + p("") + p("Last", "H1") + p(b)
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return zipped({"word/document.xml": f"<w:document {ns}><w:body>{text}</w:body></w:document>", "word/styles.xml": styles})


def xlsx_of(a: str, b: str, number: str, lang: str, source: str, body: str) -> bytes:
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    first = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2">{text("A2", a)}{text("B2", b)}</row><row r="3"><c r="B3"><v>{number}</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>'
    second = f'<worksheet {main}><sheetData><row r="1">{text("A1", lang)}{text("B1", source)}</row><row r="2">{text("B2", body)}</row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
    book = f'<workbook {main} {_R}><sheets><sheet name="first" sheetId="1" r:id="r1"/><sheet name="second" sheetId="2" r:id="r2"/><sheet name="blank" sheetId="3" r:id="r3"/></sheets></workbook>'
    rels = f'<Relationships {_REL}>' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + "</Relationships>"
    sheets = {f"xl/worksheets/sheet{i}.xml": s for i, s in enumerate((first, second, f"<worksheet {main}><sheetData/></worksheet>"), 1)}
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst {main}><si><t>k</t></si><si><r><t>v</t></r></si></sst>", **sheets})


def pptx_of(source: str, body: str, a: str, b: str) -> bytes:
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" {_R}'
    lines = lambda *texts: "<p:txBody>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + "</p:txBody>"
    shape = lambda body, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind and f"""<p:ph type="{kind}"/>"""}</p:nvPr></p:nvSpPr>{body}</p:sp>'
    c = lambda t: f"<a:tc>{lines(t)}</a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{c('k')}{c('v')}</a:tr><a:tr>{c(a)}{c(b)}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda shapes: f"<p:sld {ns}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    show = f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>'
    rels = f'<Relationships {_REL}>' + "".join(f'<Relationship Id="r{i}" Target="slides/slide{i}.xml"/>' for i in (1, 2)) + "</Relationships>"
    first = shape(lines("7"), "sldNum") + f"<p:grpSp>{shape(lines(body, ' '))}</p:grpSp>" + shape(lines(source), "title")
    return zipped({"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": slide(first), "ppt/slides/slide2.xml": slide(table)})


@pandas_udf(BinaryType())
def made_docx(source: pd.Series, body: pd.Series, lang: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([docx_of(*x) for x in zip(source, body, lang, a, b)], dtype=object)


@pandas_udf(BinaryType())
def made_xlsx(a: pd.Series, b: pd.Series, number: pd.Series, lang: pd.Series, source: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([xlsx_of(*x) for x in zip(a, b, number, lang, source, body)], dtype=object)


@pandas_udf(BinaryType())
def made_pptx(source: pd.Series, body: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pptx_of(*x) for x in zip(source, body, a, b)], dtype=object)
