"""Web archives in ZIP packages: round trips, directories of all kinds, damaged files."""

import base64
import gzip
import hashlib
import io
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrain.llm import warc_zip

SCHEMA = "page_id long, url string, html string, path string, origin string, same string"


def plain(rows, least):
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        ids = [p for p, h in rows if (h or "").encode() == raw and p is not None]
        origin = max(ids) if len(raw) >= least and ids else None
        revisit = origin is not None and page != origin
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", origin if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(warc_zip.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc_zip.page_of(F.col("refers_to"))).collect()), key=repr)


ROWS = [(1, "<p>a</p>"), (2, "<p>a</p>"), (9, "<p>a</p>"), (9, "<p>a</p>"), (3, None), (4, ""), (5, "é\r\n\r\n\x00 \U0001f600"), (6, "x" * 300_000), (7, "x" * 300_000), (8, "PK\x05\x06 WARC/1.1\r\n\r\n"), (None, "<p>a</p>"), (None, "alone"), (-4, "minus"), (3, "other")]


@pytest.mark.parametrize("least", [0, 1, 9])
@pytest.mark.parametrize("size, number, window, index", [(256 << 20, 100_000, 16 << 20, 4 << 20), (600, 3, 500, 70), (1, 1, 1, 1), (1 << 20, 5, 200, 211)])
def test_round_trip(spark, tmp_path, monkeypatch, least, size, number, window, index):
    for name, value in (("PACKAGE_BYTES", size), ("PACKAGE_RECORDS", number), ("WINDOW_BYTES", window), ("INDEX_BYTES", index), ("READ_BYTES", window)):
        monkeypatch.setattr(warc_zip, name, value)
    pages = spark.createDataFrame([(p, f"http://h/{p} é\n", h, "a", "b", "c") for p, h in ROWS], SCHEMA).repartition(2)
    packages = warc_zip.write(pages, f"file://{tmp_path}/out", least)
    records = warc_zip.read(packages)
    assert got(records) == plain(ROWS, least)
    assert {r["payload"].decode() for r in records.where("record_type = 'response'").collect()} == {h or "" for _, h in ROWS}
    # Any reader of ZIP and gzip files finds the same records.
    seen = 0
    for row in packages.collect():
        with zipfile.ZipFile(row["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
            seen += gzip.decompress(z.read("archive/data.warc.gz")).count(b"WARC-Record-ID")
            assert len(z.read("indexes/index.cdxj").splitlines()) == row["records"]
    assert seen == len(ROWS)


def test_empty(spark, tmp_path):
    packages = warc_zip.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/out")
    assert packages.collect() == [] and warc_zip.read(packages).collect() == []


def made(wide, before=b"", note=b"", extra=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc.gz", b"one two three")
        info = zipfile.ZipInfo("indexes/index.cdxj")
        info.extra = extra
        with z.open(info, "w", force_zip64=wide) as m:
            m.write(b"lines")
        z.writestr(zipfile.ZipInfo("naïve/ü.txt"), b"packed " * 50, zipfile.ZIP_DEFLATED)
        z.comment = note
    return before + out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before, note", [(b"", b""), (b"#!launcher\n" * 9, b""), (b"", b"note PK\x05\x06 with an end mark and more bytes behind"), (b"x" * 70_000, b"n" * 65_535)])
def test_directories(monkeypatch, wide, before, note):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = made(wide, before, note, b"\x99\x99\x04\x00abcd")
    found = list(warc_zip.members_in(pa.PythonFile(io.BytesIO(raw), "r")))
    with zipfile.ZipFile(io.BytesIO(made(wide))) as z:  # Python's reader doesn't take an end mark inside a note
        assert [(m["name"], m["method"], m["size"], m["length"], m["crc"]) for m in found] == [(i.filename, i.compress_type, i.compress_size, i.file_size, i.CRC) for i in z.infolist()]
    assert raw[found[0]["at"] :][: found[0]["size"]] == b"one two three" and raw[found[1]["at"] :][: found[1]["size"]] == b"lines"


def test_damage(spark, tmp_path):
    for raw in (b"", b"PK\x05\x06", b"no package", made(False)[:-3]):
        with pytest.raises(ValueError):
            list(warc_zip.members_in(pa.PythonFile(io.BytesIO(raw), "r")))
    with pytest.raises(ValueError):
        warc_zip.parsed(warc_zip.record(1, "u", b"payload", None, "d").replace(b"payload", b"payl0ad"))
    bad = os.path.join(tmp_path, "bad.wacz")
    for names in (["archive/data.warc.gz"], ["indexes/index.cdxj"]):
        with zipfile.ZipFile(bad, "w") as z:
            for name in names:
                z.writestr(name, b'1 2 {"filename": "data.warc.gz", "offset": "0", "length": "5"}\n')
        with pytest.raises(Exception, match="stored member"):
            warc_zip.read(spark.createDataFrame([(f"file://{bad}",)], "path string")).collect()
