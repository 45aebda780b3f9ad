"""The same read request over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parqlane.plans.scan import ReadSpec


def stream(spark: SparkSession, path: str, schema: T.StructType, spec: ReadSpec | None = None, max_files: int = 1000) -> DataFrame:
    """Rows of Parquet files as they appear in ``path``; stateless, so no watermark is needed."""
    spec = spec or ReadSpec()
    reader = spark.readStream.schema(spec.read_schema(schema)).option("maxFilesPerTrigger", max_files)
    return spec.apply(reader.parquet(path))
