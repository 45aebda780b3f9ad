"""The read request: what rows, what columns, of which row groups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.operators import columns as C
from parqlane.operators import predicates as P
from parqlane.sources.footer import CODECS, ENCODINGS, footer_length, over_files, read_footer, whole_uri
from parqlane.sources.footer import row_groups as groups_of
from parqlane.sources.ranges import ByteRanges, driver_ranges


@dataclass(frozen=True)
class ReadSpec:
    """A predicate and a projection; by default everything.

    Columns of the predicate are read and, unless keep_predicate_columns is false, also returned.
    """

    predicate: P.Predicate = field(default_factory=P.everything)
    columns: C.ColumnSpec = field(default_factory=C.all_columns)
    keep_predicate_columns: bool = True

    def needed(self) -> C.ColumnSpec:
        return C.union(self.columns, *(C.column(*p) for p in self.predicate.paths()))

    def predicate_includes(self, path) -> bool:
        return C.union(*(C.column(*p) for p in self.predicate.paths())).includes_path(path)

    def columns_include(self, path) -> bool:
        return self.columns.includes_path(path)

    def read_schema(self, schema: T.StructType) -> T.StructType:
        """The part of the files' schema to read."""
        self.predicate.lower(schema)  # names that aren't there are told before anything is read
        return C.prune(schema, self.needed()) or T.StructType()

    def apply(self, df: DataFrame) -> DataFrame:
        """Filter and project a DataFrame or a stream that holds at least what is needed."""
        kept = df.where(self.predicate.lower(df.schema)) if self.predicate.paths() else df
        return C.project(kept, self.needed() if self.keep_predicate_columns else self.columns)


def scan(
    spark: SparkSession, path: str, spec: ReadSpec | None = None, row_groups: Iterable[int] | None = None, check_encodings: bool = True
) -> DataFrame:
    """Rows of the Parquet files below ``path``.

    Only the pruned schema is asked of the files, nested leaves included. ``row_groups``: places of
    row groups in their files; others' rows are left out by their row index. Files that Spark's
    vectorised reader gets wrong are refused while it is on (``needs_row_reader``); with very many files
    whose writer is known, check_encodings=False saves that look at all footers.
    """
    spec = spec or ReadSpec()
    there = spark.read.parquet(path)
    schema = there.schema
    listed = there._jdf.inputFiles() if check_encodings and spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true" else None
    if listed is not None and needs_row_reader(spark, path, list(listed) if len(listed) <= FEW_FILES else None):
        raise UnsafeEncoding(f"set spark.sql.parquet.enableVectorizedReader to false to read {path}: its encodings need the row reader")
    df = spark.read.schema(spec.read_schema(schema)).parquet(path)
    if row_groups is not None:
        df = within_row_groups(spark, df, path, row_groups)
    return spec.apply(df)


class UnsafeEncoding(ValueError):
    pass


#: Files, and bytes of their footers, that the driver reads itself; more are read by a job.
FEW_FILES, FEW_BYTES = 16, 1 << 20


def needs_row_reader(spark: SparkSession, path: str, files: list[str] | None = None) -> bool:
    """Whether Spark's vectorised reader can't be trusted with these files.

    It misreads delta-encoded strings in uncompressed pages and refuses split byte streams; with
    spark.sql.parquet.enableVectorizedReader=false both are read right. files: what ``path`` holds,
    if that is known and little; the driver then reads the footers if they are small, otherwise a job does.
    """
    sources = [driver_ranges(spark, f) for f in files or ()]
    if files is not None and sum(footer_length(s) for s in sources) <= FEW_BYTES:
        return any(True for s in sources for _ in _unsafe_files("", s))
    return over_files(spark, [path], _unsafe_files, "file string").agg(F.max("file")).first()[0] is not None


def _unsafe_files(uri: str, source: ByteRanges):
    """The file, if a column chunk of it is unsafe."""
    if any(_unsafe(CODECS[c.meta[4]], [ENCODINGS.get(e, str(e)) for e in c.meta[2]]) for _, _, own in groups_of(read_footer(source)) for c in own):
        yield (uri,)


def _unsafe(codec: str, encodings: list[str]) -> bool:
    return (codec == "UNCOMPRESSED" and "DELTA_BYTE_ARRAY" in encodings) or "BYTE_STREAM_SPLIT" in encodings


#: Runs of rows in a plain filter, and runs that are broadcast.
FEW_RUNS, BROADCAST_RUNS = 16, 1 << 14


def within_row_groups(spark: SparkSession, df: DataFrame, path: str, row_groups: Iterable[int]) -> DataFrame:
    """df, read from ``path``, with the rows of the given row groups alone.

    Neighbouring groups are one run of rows. Where every file has the same few runs, they are a plain
    filter. Otherwise rows meet runs by file and block of rows; a block has as many rows as a run has in
    the mean, so the comparisons of all rows are at most three times the rows, however many groups
    files have and however unequal they are.
    """
    wanted = row_groups if isinstance(row_groups, range) else frozenset(row_groups)

    def runs_of(uri, source):
        runs, first = [], 0
        for k, group in enumerate(read_footer(source).get(4, [])):
            past = first + group[3]
            if k in wanted and past > first:
                if runs and runs[-1]["past"] == first:
                    runs[-1]["past"] = past
                else:
                    runs.append({"first": first, "past": past})
            first = past
        yield uri, runs

    found = over_files(spark, [path], runs_of, "file string, runs array<struct<first:long,past:long>>")
    rows = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])
    seen = found.agg(
        (F.min("runs") == F.max("runs")).alias("same"), F.slice(F.min("runs"), 1, FEW_RUNS).alias("some"), F.max(F.size("runs")).alias("most"),
        F.sum(F.size("runs")).alias("n"), F.sum(rows).alias("rows"),
    ).first()
    if not seen.n:
        return df.where(F.lit(False))
    if seen.same and seen.most <= FEW_RUNS:
        index = F.col("_metadata.row_index")
        return df.where(reduce(or_, ((index >= r.first) & (index < r.past) for r in seen.some)))
    block = -(-seen.rows // seen.n)
    start = lambda row: row - row % block
    file, row, part, group, run, group_part = (unused(c, df.columns) for c in ("file", "row", "part", "group_file", "run", "group_part"))
    marked = df.select("*", whole_uri(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(row))
    marked = marked.withColumn(part, start(F.col(row)))
    held = found.select(F.col("file").alias(group), F.explode("runs").alias(run))
    parts = F.sequence(start(F.col(run)["first"]), F.col(run)["past"] - 1, F.lit(block).cast("long"))
    held = held.withColumn(group_part, F.explode(parts)).hint("broadcast" if seen.n <= BROADCAST_RUNS else "merge")
    inside = (F.col(file) == F.col(group)) & (F.col(part) == F.col(group_part)) & (F.col(row) >= F.col(run)["first"]) & (F.col(row) < F.col(run)["past"])
    return marked.join(held, inside, "left_semi").drop(file, row, part)


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name
