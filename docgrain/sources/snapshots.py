"""Tables of documents' rows that are replaced atomically: immutable segments under numbered manifests.

A commit writes a segment (the new rows, and the keys of the documents that they replace) and then publishes a manifest that
names all segments which count. Nothing is seen before its manifest is: a reader takes the newest one and has the old or the new
rows of a document, never both and never a part. A writer that fails leaves a segment that no manifest names. Two writers
that publish at once get different numbers: the second finds its number taken and publishes on top of the first. A job that is repeated
finds its name in the manifest and changes nothing.

A row counts unless a later segment replaces its key. Segments are merged once there are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.operators.rows import BROADCAST_ROWS

#: Segments above which a commit merges them, and jobs that a manifest remembers.
MOST_SEGMENTS, MOST_JOBS = 16, 10_000


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int
    rows: bool
    keys: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    jobs: tuple[str, ...] = ()
    notes: dict = field(default_factory=dict)


class Files:
    """The few calls on the shared file system that commits need; on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.context = self.fs.FileContext.getFileContext(self.fs.Path(root).toUri(), conf) if "://" in root or root.startswith("file:") else self.fs.FileContext.getLocalFSFileContext(conf)
        self.system = self.fs.Path(root).getFileSystem(conf)

    def names(self, folder: str) -> list[str]:
        path = self.fs.Path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(path)) if self.system.exists(path) else []

    def text(self, path: str) -> str:
        stream = self.system.open(self.fs.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that wasn't there, whole or not at all; False if the name is taken. A rename without overwriting decides."""
        spare, target = self.fs.Path(f"{path}.{uuid.uuid4().hex}"), self.fs.Path(path)
        stream = self.system.create(spare, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(spare, target, self.gateway.new_array(self.fs.Options.Rename, 0))
            return True
        except Exception as error:
            self.system.delete(spare, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, path: str) -> None:
        self.system.delete(self.fs.Path(path), True)


class SnapshotTable:
    """Rows of documents at `path`, replaced by `key`. With `part`, a segment's files are parted by that column and sorted by `order`.

    `schema` is that of the files. `pack` makes their rows from a commit's, and `unpack` makes those again, with the key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, part: str | None = None, order: tuple[str, ...] = (), pack: Callable[[DataFrame], DataFrame] = lambda df: df, unpack: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.path, self.schema, self.key, self.part, self.order, self.pack, self.unpack = spark, path, schema, key, part, order, pack, unpack
        self.files = Files(spark, path)

    # Manifests

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of an earlier version; an empty one before the first commit."""
        names = [n for n in self.files.names(f"{self.path}/manifests") if n.isdigit()]
        if version is None:
            version = int(names[-1]) if names else 0
        if not version:
            return Manifest()
        found = json.loads(self.files.text(f"{self.path}/manifests/{version:012d}"))
        return Manifest(found["version"], tuple(Segment(**s) for s in found["segments"]), tuple(found["jobs"]), found["notes"])

    def _publish(self, new: Manifest) -> bool:
        body = {"version": new.version, "segments": [vars(s) for s in new.segments], "jobs": list(new.jobs[-MOST_JOBS:]), "notes": new.notes}
        return self.files.publish(f"{self.path}/manifests/{new.version:012d}", json.dumps(body))

    def _commit(self, change) -> Manifest:
        """Publish what `change` makes of the newest manifest, and of a newer one if another writer comes first."""
        while True:
            old = self.manifest()
            new = change(old)
            if new is old or self._publish(new):
                return new

    # Writing

    def _segment(self, rows: DataFrame | None, keys: DataFrame | None) -> Segment:
        name = uuid.uuid4().hex
        if rows is not None:
            rows = self.pack(rows)
            if self.part:
                rows = rows.repartition(self.part).sortWithinPartitions(self.part, *self.order)
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(self.part) if self.part else writer).parquet(f"{self.path}/segments/{name}/rows")
        count = 0
        if keys is not None:
            keys.select(self.key).distinct().write.parquet(f"{self.path}/segments/{name}/keys")
            count = self.spark.read.parquet(f"{self.path}/segments/{name}/keys").count()
        return Segment(name, 0, rows is not None, count)

    def commit(self, job: str, rows: DataFrame | None = None, gone: DataFrame | None = None, notes: dict | None = None) -> int:
        """Replace the documents that `rows` has rows of, and those in `gone` (key), by `rows`, as one step; the version.

        A document whose rows are gone altogether has to be in `gone`. Of commits to one document the later one counts. A
        `job` that was committed before changes nothing.
        """
        old = self.manifest()
        if job in old.jobs:
            return old.version
        keys = [x.select(self.key) for x in (rows, gone) if x is not None]
        segment = self._segment(rows, (keys[0].union(keys[1]) if len(keys) > 1 else keys[0]) if old.segments else None)

        def change(found: Manifest) -> Manifest:
            if job in found.jobs:
                return found
            if found.segments and not segment.keys and not old.segments:
                raise ConcurrentFirstCommit(self.path)
            seq = max((s.seq for s in found.segments), default=0) + 1
            return Manifest(found.version + 1, (*found.segments, replace(segment, seq=seq)), (*found.jobs, job), {**found.notes, **(notes or {})})

        try:
            done = self._commit(change)
        except ConcurrentFirstCommit:  # another writer made the table meanwhile: this one's keys count now
            self.files.delete(f"{self.path}/segments/{segment.name}")
            return self.commit(job, rows, gone, notes)
        if len(done.segments) > MOST_SEGMENTS:
            self.merge()
        return done.version

    def merge(self) -> int:
        """One segment in place of all that there are; commits that come meanwhile stay on top of it."""
        base = self.manifest()
        if len(base.segments) < 2:
            return base.version
        last = base.segments[-1].seq
        whole = replace(self._segment(self.rows(base), None), seq=last)

        def change(found: Manifest) -> Manifest:
            if {s.name for s in base.segments} <= {s.name for s in found.segments}:
                return Manifest(found.version + 1, (whole, *(s for s in found.segments if s.seq > last)), found.jobs, found.notes)
            return found  # another writer merged them first

        return self._commit(change).version

    def clean(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest `keep`, and segments that none of those names; readers and writers at work must be
        younger than that. The deleted segments' names."""
        versions = [int(n) for n in self.files.names(f"{self.path}/manifests") if n.isdigit()]
        used = {s.name for v in versions[-keep:] for s in self.manifest(v).segments}
        gone = [n for n in self.files.names(f"{self.path}/segments") if n not in used]
        for v in versions[:-keep]:
            self.files.delete(f"{self.path}/manifests/{v:012d}")
        for name in gone:
            self.files.delete(f"{self.path}/segments/{name}")
        return gone

    # Reading

    def rows(self, at: Manifest | None = None, where: Column | None = None) -> DataFrame:
        """The rows that count under a manifest (the newest one by default). `where`, on columns of the files, goes to the scan
        of each segment, so a condition on `part` prunes its files."""
        at = at or self.manifest()
        read = self.spark.read.schema(self.schema)
        out = None
        for s in at.segments:
            if s.rows:
                one = read.parquet(f"{self.path}/segments/{s.name}/rows")
                one = self.unpack(one if where is None else one.where(where)).withColumn("_seq", F.lit(s.seq))
                out = one if out is None else out.unionByName(one)
        if out is None:
            return self.unpack(self.spark.createDataFrame([], self.schema))
        later = self.replaced(at)
        if later is not None:
            out = out.join(later, out[self.key].eqNullSafe(later["_key"]), "left").where("_last IS NULL OR _seq >= _last").drop("_key", "_last")
        return out.drop("_seq")

    def replaced(self, at: Manifest) -> DataFrame | None:
        """(_key, _last): the last segment that replaces each key; those of the first segment replace nothing."""
        some = [s for s in at.segments if s.keys]
        if not some:
            return None
        out = None
        for s in some:
            one = self.spark.read.parquet(f"{self.path}/segments/{s.name}/keys").select(F.col(self.key).alias("_key"), F.lit(s.seq).alias("_last"))
            out = one if out is None else out.union(one)
        out = out.groupBy("_key").agg(F.max("_last").alias("_last"))
        return F.broadcast(out) if sum(s.keys for s in some) <= BROADCAST_ROWS else out


class ConcurrentFirstCommit(Exception):
    """Two writers made a table's first segment at once."""
