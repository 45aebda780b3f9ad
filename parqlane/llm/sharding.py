"""Sharding with size-tiered compaction and an atomically committed, versioned manifest.

A store is a folder: ``data/`` holds immutable Parquet files, the shards; ``manifest/`` holds one
small JSON file per version that lists the shards in force. An arrival is appended as the small
files its tasks write. Compaction takes runs of similarly sized shards (one tier spans a factor of
``fanout`` in bytes) and merges each run into files of about the target size; a merged file is one
task that reads its run's files and writes one file, so no row is shuffled. A version is committed
by renaming its file to the next number, which fails if another writer was first; such a writer
starts again from the newer version. Readers keep the version they opened; files go with vacuum(),
which leaves alone what is younger than its age bound, so that it can't take files that an append has
written and not yet committed; a commit makes sure that its new files are there.

The main path is DataFrame operations and file-system calls only. The driver holds one entry per
shard, never a row. A lost executor repeats its own task; an attempt that fails before the rename
leaves files no version names.

Defined cases: rows are kept as they are, repeated rows, nulls and long texts included; an empty
arrival adds no shard and keeps the schema, so an empty store reads as an empty table; a second
arrival must have the first one's columns and types (ValueError otherwise); a shard as large as the target is left alone.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.llm.common import file_system, hadoop_path

TARGET_BYTES, FANOUT, LEAST_BYTES, JOBS, BROADCAST_SHARDS = 128 << 20, 4, 1 << 20, 64, 10_000
#: Age, in seconds, from which vacuum() takes files that no kept version names.
VACUUM_AGE = 24 * 3600
LISTED = 100


def kinds_of(schema: dict) -> list:
    """Names and types of a schema's fields, without nullability and metadata."""
    if isinstance(schema, dict):
        return {k: kinds_of(v) for k, v in schema.items() if k not in ("nullable", "metadata", "containsNull", "valueContainsNull")}
    return [kinds_of(x) for x in schema] if isinstance(schema, list) else schema


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    schema: str | None  # JSON


def tier(size: int, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
    return 0 if size < least else 1 + int(math.log(size / least, fanout))


def runs(shards, target=TARGET_BYTES, fanout=FANOUT, least=LEAST_BYTES, final=False) -> list[list[Shard]]:
    """Runs of two or more shards of one tier to merge, each of about the target size at most.

    A tier is merged once it holds ``fanout`` shards; final merges all that are below the target.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.path):
        if s.bytes < target:
            tiers.setdefault(0 if final else tier(s.bytes, fanout, least), []).append(s)
    out = []
    for _, some in sorted(tiers.items()):
        if not final and len(some) < fanout:
            continue
        run, size = [], 0
        for s in some:
            if run and size + s.bytes > target * 1.1:
                out.append(run)
                run, size = [], 0
            run.append(s)
            size += s.bytes
        out.append(run)
    return [r for r in out if len(r) > 1]


def _below():
    """The path, below the store, of the file a row was read from."""
    return F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/data/", -1))


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, _ = file_system(spark, self.path)
        self._jvm = spark.sparkContext._jvm

    def _p(self, below: str):
        return hadoop_path(self.spark, f"{self.path}/{below}")

    # Manifests

    def versions(self) -> list[int]:
        found = self.fs.globStatus(self._p("manifest/v*.json")) or ()
        return sorted(int(f.getPath().getName()[1:-5]) for f in found)

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            there = self.versions()
            if not there:
                return Manifest(0, (), None)
            version = there[-1]
        stream = self.fs.open(self._p(f"manifest/v{version:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(said["version"], tuple(Shard(**s) for s in said["shards"]), said["schema"])

    def commit(self, base: Manifest, shards, schema: str | None) -> Manifest:
        """The version after ``base``; Conflict if there is one already."""
        new = Manifest(base.version + 1, tuple(sorted(shards, key=lambda s: s.path)), schema)
        said = json.dumps({"version": new.version, "schema": schema, "shards": [asdict(s) for s in new.shards]})
        draft, final = self._p(f"manifest/.{uuid.uuid4().hex}"), self._p(f"manifest/v{new.version:020d}.json")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        try:  # without the overwrite option a rename onto an existing file fails
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as why:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(f"version {new.version} is there already") from why
            raise
        return new

    def _settle(self, change) -> Manifest:
        """Commit change(manifest), again on the newer version whenever another writer was first."""
        while True:
            base = self.manifest()
            try:
                return self.commit(base, *change(base))
            except Conflict:
                continue

    def _below(self, path) -> str:
        """A file's path below the store."""
        return "data/" + path.toString().rpartition("/data/")[2]

    def _there(self, shards) -> None:
        """FileNotFoundError unless all of the shards' files are there."""
        for k in range(0, len(shards), LISTED):
            some = {s.path for s in shards[k : k + LISTED]}
            found = self.fs.globStatus(self._p("{" + ",".join(sorted(some)) + "}")) or ()
            if gone := some - {self._below(f.getPath()) for f in found}:
                raise FileNotFoundError(f"{min(gone)} and others, {len(gone)} in all, are gone before they were committed")

    # Shards

    def _written(self, folders: list[str]) -> list[Shard]:
        """The non-empty shards of freshly written folders; row counts come from the footers."""
        files = {}
        for k in range(0, len(folders), LISTED):  # so many folders a listing
            for f in self.fs.globStatus(self._p("{" + ",".join(folders[k : k + LISTED]) + "}/*.parquet")) or ():
                files[self._below(f.getPath())] = f.getLen()
        if not files:
            return []
        read = self.spark.read.option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{p}" for p in files))
        counts = read.groupBy(_below().alias("name")).agg(F.count("*").alias("n")).collect()
        return [Shard(r.name, r.n, files[r.name]) for r in counts]

    def append(self, arrival: DataFrame) -> Manifest:
        """Add an arrival as small shards, one per task that has rows."""
        return self.append_all(arrival, None)[-1]

    def append_all(self, rows: DataFrame, arrival_col: str | None) -> list[Manifest]:
        """Add the arrivals that the numbers in ``arrival_col`` (not stored) tell apart: one write, a version each."""
        folder = f"data/{uuid.uuid4().hex}"
        kept = rows if arrival_col is None else rows.drop(arrival_col)
        schema = json.loads(kept.schema.json())
        there = self.manifest().schema
        if there and kinds_of(json.loads(there)) != kinds_of(schema):
            raise ValueError("an arrival must have the store's columns and types")
        if arrival_col is not None:  # numbers only, so folder names need no escapes
            rows = rows.withColumn(arrival_col, F.col(arrival_col).cast("long"))
        writer = rows.write if arrival_col is None else rows.write.partitionBy(arrival_col)
        writer.parquet(f"{self.path}/{folder}")
        folders = [folder]
        if arrival_col is not None:
            found = self.fs.globStatus(self._p(f"{folder}/{arrival_col}=*")) or ()
            folders = sorted(f"{folder}/{f.getPath().getName()}" for f in found)
        new = self._written(folders)
        out = []
        for place in folders or [folder]:
            own = [s for s in new if s.path.rpartition("/")[0] == place]
            self._there(own)
            out.append(self._settle(lambda base, own=own: ((*base.shards, *own), base.schema or json.dumps(schema))))
        return out

    def compact(self, target=TARGET_BYTES, fanout=FANOUT, least=LEAST_BYTES, final=False) -> Manifest:
        """Merge until no tier has a run to merge; each round of merges is one version."""
        while True:
            base = self.manifest()
            todo = runs(base.shards, target, fanout, least, final)
            if not todo:
                return base

            def merge(run, schema=base.schema):
                folder = f"data/{uuid.uuid4().hex}"
                self._read(schema, run).coalesce(1).write.parquet(f"{self.path}/{folder}")
                return folder

            with ThreadPoolExecutor(JOBS) as pool:  # of threads that wait for Spark's jobs
                new = self._written(list(pool.map(merge, todo)))
            gone = {s for run in todo for s in run}

            self._there(new)

            def swap(now, new=new, gone=gone):
                if not gone <= set(now.shards):
                    raise LookupError("another compaction took some of the shards")
                return (*(s for s in now.shards if s not in gone), *new), now.schema

            try:
                self._settle(swap)
            except LookupError:
                continue

    def _read(self, schema: str | None, shards) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        m = self.manifest(version)
        return self._read(m.schema, m.shards)

    def read_with_shards(self, version: int | None = None, prefix: str = "shard_") -> DataFrame:
        """read(), and of each row's shard id (its place in the manifest), rows and bytes."""
        m = self.manifest(version)
        listed = self.spark.createDataFrame(
            [(s.path, k, s.rows, s.bytes) for k, s in enumerate(m.shards)],
            "__name string, __id int, __rows long, __bytes long",
        )
        if len(m.shards) <= BROADCAST_SHARDS:  # some 100 bytes each; beyond that both sides are shuffled
            listed = F.broadcast(listed)
        rows = self._read(m.schema, m.shards)
        kept = [c for c in rows.columns if c not in {prefix + x for x in ("id", "rows", "bytes")}]
        if not m.shards:
            out = rows.withColumns({"__name": F.lit("")})
        else:
            out = rows.withColumn("__name", _below())
        out = out.join(listed, "__name")
        return out.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"__{x}").alias(prefix + x) for x in ("id", "rows", "bytes")))

    def vacuum(self, keep: int = 1, older_than_s: float = VACUUM_AGE) -> int:
        """Delete manifests but the newest ``keep``, and files older than so many seconds that none of
        those names; how many files. The age must exceed the time that a writer takes to commit."""
        versions = self.versions()
        held = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        for v in versions[:-keep]:
            self.fs.delete(self._p(f"manifest/v{v:020d}.json"), False)
        deleted, bound = 0, (time.time() - older_than_s) * 1000
        for pattern in ("data/*/*.parquet", "data/*/*/*.parquet"):
            for f in self.fs.globStatus(self._p(pattern)) or ():
                if self._below(f.getPath()) not in held and f.getModificationTime() <= bound:
                    deleted += self.fs.delete(f.getPath(), False)
        return deleted
