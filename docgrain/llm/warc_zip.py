"""Web archives in ZIP packages: written by partition, read by ranges without extraction.

A package is a ZIP file of stored members: `archive/data.warc.gz` with a gzip member for each WARC record, and
`indexes/index.cdxj` with a line for each record that names its archive, offset and length. A reader first takes each package's
end record (its ZIP64 form where there is one), central directory and local headers, which give the place of every stored
member in the file. Index members are read in ranges, a line belonging to the range it starts in; records are then read
by ranges of the package, in windows that are dealt to all tasks, so the size of a package doesn't bound the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, broadcast_checked, release, remove, salted_join, shared_dir, staged, table

#: A package is closed at so many bytes of records, or so many records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 100_000
#: Bytes of an index that are one range, of a package that are one window of records, and of one read.
INDEX_BYTES, WINDOW_BYTES, READ_BYTES = 4 << 20, 16 << 20, 4 << 20
#: Rows of one payload beyond which a join deals them to several tasks.
HOT_ROWS = 200_000
#: Fixed by the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ARCHIVE, INDEX = "archive/", "indexes/"
MEMBERS = "path string, name string, method int, at long, size long, length long, crc long"
ENTRIES = "path string, name string, start long, length long"
RECORDS = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI (of those that Arrow opens), and the path there."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


# Writing


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of `refers_to` that has the payload's length and digest alone."""
    name = "<urn:docgrain:page:{}>".format
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name('' if page is None else page)}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


#: Marks that stay as they are in a URI; white space, controls and what isn't ASCII are percent-encoded.
SAFE = "".join(chr(c) for c in range(33, 127))


class Stream:
    """What a ZIP writer needs of an output that can't seek."""

    def __init__(self, out: pa.NativeFile):
        self.write, self.flush = out.write, out.flush


class Package:
    """One ZIP file in the making: records first, their index at the end."""

    def __init__(self, path: str, date: str):
        fs, place = opened(path)
        self.path, self.date, self.lines, self.bytes = path, date, [], 0
        self.out = fs.open_output_stream(place, compression=None, buffer_size=1 << 20)
        self.zip = zipfile.ZipFile(Stream(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(f"{ARCHIVE}data.warc.gz"), "w", force_zip64=True)

    def add(self, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = press.compress(record(page, url, payload, refers_to, self.date)) + press.flush()
        self.member.write(data)
        entry = {"filename": "data.warc.gz", "offset": str(self.bytes), "length": str(len(data)), "url": quote(url or "", safe=SAFE), "digest": f"sha1:{digest_of(payload)}"}
        self.lines.append(f"{'' if page is None else page} {self.date} {json.dumps(entry)}\n")
        self.bytes += len(data)

    def full(self) -> bool:
        return self.bytes >= PACKAGE_BYTES or len(self.lines) >= PACKAGE_RECORDS

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(f"{INDEX}index.cdxj"), "w", force_zip64=True) as index:
            for i in range(0, len(self.lines), 1000):
                index.write("".join(self.lines[i : i + 1000]).encode())
        self.zip.close()
        self.out.close()


def with_origin(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, origin): origin is the largest page_id of the rows with the same payload of at least `least` bytes."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    groups = own.where(F.octet_length("payload") >= least).groupBy("same").agg(F.max("page_id").alias("origin"), F.count("*").alias("n"))
    groups = staged(groups.where("n > 1").select("same", "origin"))
    return salted_join(own, groups, "same", "page_id", HOT_ROWS, "left").select("page_id", "url", "payload", "origin")


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record for each row of `pages` (page_id, url, html) into packages in `folder`, a URI that Arrow opens;
    (path, records) of the packages, staged. Files of lost tasks aren't among them.

    Of rows with the same payload of at least `least` bytes, that with the largest page_id is a response and the others
    revisit it; smaller payloads are responses. A null html is an empty payload, a null id can't be revisited. A repeated row is a
    record again, and a response again if its like is one, as a record can't revisit its own id. Other columns don't matter; an
    empty table gives no packages.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, package = TaskContext.get().partitionId(), uuid.uuid4().hex, None
        done: list[tuple[str, int]] = []

        def close() -> None:
            package.close()
            done.append((package.path, len(package.lines)))

        for batch in batches:
            for page, url, payload, origin in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "origin"))):
                if package is None:
                    fs, at = opened(folder)
                    fs.create_dir(at, recursive=True)
                    package = Package(f"{folder}/part-{task:06d}-{place}-{len(done)}.wacz", date)
                package.add(page, url, payload, None if origin == page else origin)
                if package.full():
                    close()
                    package = None
        if package is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done])], names=["path", "records"])

    return staged(with_origin(pages, least).mapInArrow(run, "path string, records long"))


# Reading


def central_directory(file: pa.NativeFile) -> tuple[int, int, int]:
    """(start, size, shift) of a package's central directory; offsets it names count from `shift`, where the package begins."""
    size = file.size()
    tail = min(size, 22 + FULL16)
    file.seek(size - tail)
    data = file.read(tail)
    at = data.rfind(END)
    while at >= 0 and (len(data) < at + 22 or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record of a ZIP package")
    end = size - tail + at
    length, offset = struct.unpack_from("<II", data, at + 12)
    file.seek(max(end - 20, 0))
    locator = file.read(20)
    if end >= 76 and locator[:4] == LOCATOR64:
        # The ZIP64 end record stands before its locator; its named place is off by what precedes the package.
        for place in (struct.unpack_from("<Q", locator, 8)[0], end - 76):
            file.seek(min(place, size))
            record64 = file.read(56)
            if record64[:4] == END64:
                length, offset = struct.unpack_from("<QQ", record64, 40)
                end = place
                break
        else:
            raise ValueError("no ZIP64 end record where its locator points")
    elif FULL32 in (length, offset):
        raise ValueError("no locator of a ZIP64 end record")
    return end - length, length, end - length - offset


def members_in(file: pa.NativeFile) -> Iterator[dict]:
    """Name, method, place of the data, size in the package, length, checksum of each member, in the directory's order."""
    start, size, shift = central_directory(file)
    held, at, read = b"", 0, 0
    while True:
        if len(held) - at < 46 + 3 * FULL16 and read < size:
            file.seek(start + read)
            more = file.read(min(1 << 20, size - read))
            held, at, read = held[at:] + more, 0, read + len(more)
        if at >= len(held):
            return
        if held[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        flags, method, crc, packed, length, names, extras, notes, place = struct.unpack_from("<4xHH4xIIIHHH8xI", held, at + 4)
        name, extra = held[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437"), held[at + 46 + names : at + 46 + names + extras]
        wide = iter(zip64_fields(extra))
        length, packed, place = (next(wide, v) if v == FULL32 else v for v in (length, packed, place))
        file.seek(place + shift)
        local = file.read(30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        own_names, own_extras = struct.unpack_from("<HH", local, 26)
        yield {"name": name, "method": -1 if flags & 1 else method, "at": place + shift + 30 + own_names + own_extras, "size": packed, "length": length, "crc": crc}
        at += 46 + names + extras + notes


def zip64_fields(extra: bytes) -> tuple[int, ...]:
    """The 64-bit numbers of a ZIP64 extra field: those that are full in the 32-bit one, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
        at += 4 + size
    return ()


def members(packages: DataFrame) -> DataFrame:
    """The members of each package (path); those with method 0 are stored, -1 stands for encrypted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = opened(path)
                with fs.open_input_file(place) as file:
                    found: list[dict] = []
                    for m in members_in(file):
                        found.append({"path": path, **m})
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_pylist(found, MEMBER_SCHEMA)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_pylist(found, MEMBER_SCHEMA)

    return packages.select("path").mapInArrow(run, MEMBERS)


MEMBER_SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def entries(found: DataFrame) -> DataFrame:
    """(path, name, start, length) of each record that a stored index of `found` (members) names: its archive and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size, part in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "part"))):
                fs, place = opened(path)
                with fs.open_input_file(place) as file:
                    first, last = part * INDEX_BYTES, min((part + 1) * INDEX_BYTES, size)
                    file.seek(at + max(first - 1, 0))
                    data = file.read(last - max(first - 1, 0))
                    while not data.endswith(b"\n") and last < size:  # the last line's end lies in the next range
                        more = file.read(min(1 << 16, size - last))
                        stop = more.find(b"\n")
                        data, last = data + (more[: stop + 1] if stop >= 0 else more), last + len(more)
                        if stop >= 0:
                            break
                if first:  # the line before began in the range before
                    data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
                lines = [json.loads(x[x.index(b"{") :]) for x in data.split(b"\n") if x.strip()]
                if lines:
                    columns = [[path] * len(lines), [ARCHIVE + x["filename"] for x in lines], [int(x["offset"]) for x in lines], [int(x["length"]) for x in lines]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "name", "start", "length"])

    index = found.where(F.col("name").startswith(INDEX) & F.col("name").endswith(".cdxj") & (F.col("method") == 0) & (F.col("size") > 0))
    ranges = index.select("path", "at", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {INDEX_BYTES}"))).alias("part"))
    return ranges.repartition("path", "part").mapInArrow(run, ENTRIES)


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parsed(data: bytes) -> dict:
    """A record's fields and payload. A response whose payload doesn't match its digest is damaged, which is an error."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    own = fields(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = own.get("warc-payload-digest", "").removeprefix("sha1:")
    if own["warc-type"] == "revisit":
        size, payload = int(fields(http).get("content-length", 0)), None
    else:
        size, digest = len(payload), digest or digest_of(payload)
        if digest != digest_of(payload):
            raise ValueError(f"the payload of {own.get('warc-record-id')} doesn't match its digest")
    return {"record_id": own.get("warc-record-id"), "record_type": own["warc-type"], "uri": own.get("warc-target-uri"), "refers_to": own.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload}


RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def runs_of(places: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of ordered places (start, length) that follow one another closely, up to `most` bytes; a longer one is a run."""
    first = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i][0] - sum(places[i - 1]) > 4096 or places[i][0] + places[i][1] - places[first][0] > most:
            yield first, i
            first = i


def read(packages: DataFrame) -> DataFrame:
    """The records of `packages` (path): record_id, record_type, uri, refers_to, payload_bytes, payload_digest, payload (null in revisits).

    An archive that an index names but that isn't stored is an error, as is a package without a stored index; a package without
    records gives none.
    """
    found = members(packages)

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, at in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "at"))):
                if at is None:
                    raise ValueError(f"{name} isn't a stored member of {path}")
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "place", "length"))))
            for own in dict.fromkeys(r[0] for r in rows):
                if own != path:
                    fs, place = opened(own)
                    path, file = own, fs.open_input_file(place)
                places = sorted((p, n) for x, p, n in rows if x == own)
                for a, b in runs_of(places, READ_BYTES):
                    start = places[a][0]
                    file.seek(start)
                    data = file.read(sum(places[b - 1]) - start)
                    yield pa.RecordBatch.from_pylist([parsed(data[p - start : p - start + n]) for p, n in places[a:b]], RECORD_SCHEMA)

    archives = found.where(F.col("name").startswith(ARCHIVE) & (F.col("method") == 0)).select("path", "name", "at")
    lists = found.groupBy("path").agg(F.bool_or(F.col("name").startswith(INDEX) & F.col("name").endswith(".cdxj") & (F.col("method") == 0)).alias("listed"))
    unlisted = lists.where("NOT listed").select("path", F.lit("an index").alias("name"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    placed = entries(found).union(unlisted).join(broadcast_checked(archives), ["path", "name"], "left").select("path", "name", "start", "length", "at")
    placed = placed.mapInArrow(sound, "path string, name string, start long, length long, at long")
    placed = placed.select("path", (F.col("at") + F.col("start")).alias("place"), "length")
    window = F.expr(f"place div {WINDOW_BYTES}")
    return placed.withColumn("window", window).repartition("path", "window").sortWithinPartitions("path", "place").mapInArrow(run, RECORDS)


def page_of(name: Column) -> Column:
    """The page_id in a record's id; null where there is none."""
    found = F.regexp_extract(name, r"^<urn:docgrain:page:(-?\d+)>$", 1)
    return F.when(found != "", found.cast("long"))


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    packages = write(table(spark, sf_dir, "pages"), folder)
    out = read(packages).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    out = staged(out)
    remove(spark, folder)
    release(packages)
    return out


QUERIES = {"op12_warc_packages": op12_warc_packages}
SQL = {
    "op12_warc_packages": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages),
     g AS (SELECT h, max(page_id) AS origin FROM p GROUP BY h),
     v AS (SELECT h, origin, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS parts FROM g),
     d AS (SELECT h, origin, array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest FROM v)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to FROM p JOIN d USING (h)
"""
}
