"""Parquet files as one object: schema, metadata, presence and reading."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.operators import predicates as P
from parqlane.operators import presence
from parqlane.plans.scan import ReadSpec, scan
from parqlane.sources import footer


class ParquetFiles:
    """What is below ``path``. Nothing is read before a frame is acted upon, but for the schema."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def schema(self) -> T.StructType:
        return self.spark.read.parquet(self.path).schema

    def column_type(self, path) -> T.DataType | None:
        """The type at a path, None if there is no such field."""
        try:
            return P.kind_at(self.schema, P.as_path(path))
        except LookupError:
            return None

    def chunks(self) -> DataFrame:
        return footer.chunks(self.spark, self.path)

    def row_groups(self) -> DataFrame:
        """file, row_group, first_row, group_rows, compressed_bytes."""
        return self.chunks().groupBy("file", "row_group", "first_row", "group_rows").agg(F.sum("compressed_bytes").alias("compressed_bytes"))

    def column_chunks(self, path) -> DataFrame:
        """The chunks of one column; none if the path isn't a column."""
        return self.chunks().where(F.col("path") == ".".join(P.as_path(path)))

    def column_index(self, path) -> int | None:
        found = self.column_chunks(path).select("column_index").first()
        return None if found is None else found.column_index

    def might_contain(self, path, value) -> DataFrame:
        return presence.might_contain(self.spark, self.path, ".".join(P.as_path(path)), value)

    def dictionary_values(self, path) -> DataFrame:
        """file, row_group, complete, value: what the column's dictionary pages hold."""
        return presence.dictionary_values(self.spark, self.path, ".".join(P.as_path(path)))

    def scan(self, spec: ReadSpec | None = None, row_groups: Iterable[int] | None = None) -> DataFrame:
        return scan(self.spark, self.path, spec, row_groups)

    def scan_where_present(self, path, value, spec: ReadSpec | None = None) -> DataFrame:
        """scan(), leaving out files whose metadata rule the value out; for conditions, such as those
        on elements of lists, that the reader itself doesn't push down to row groups."""
        may = self.might_contain(path, value).where("might_contain").select("file").distinct()
        files = [r.file for r in may.collect()]
        if not files:
            return scan(self.spark, self.path, spec).limit(0)
        spec = spec or ReadSpec()
        return spec.apply(self.spark.read.schema(spec.read_schema(self.schema)).parquet(*files))
