"""Writing Parquet: codec, page version, dictionary, bloom filters, row-group size and rows a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Codec names, and what Spark calls them. LZO and BROTLI need a jar that isn't part of Spark.
CODECS = {
    "UNCOMPRESSED": "none", "SNAPPY": "snappy", "GZIP": "gzip", "LZO": "lzo", "BROTLI": "brotli", "LZ4": "lz4", "ZSTD": "zstd",
    "LZ4_RAW": "lz4_raw",
}


def register_codec(name: str, spark_name: str) -> None:
    """A further codec, whose class must be on the cluster's class path."""
    CODECS[name.upper()] = spark_name


def write(
    df: DataFrame, path: str, codec: str = "SNAPPY", version: int = 1, dictionary: bool = True, bloom: Sequence[str] = (),
    row_group_bytes: int | None = None, mode: str = "errorifexists", file_rows: int | None = None,
) -> None:
    """file_rows: rows a file has at most; a task with more writes several."""
    if codec.upper() not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    writer = df.write.mode(mode).option("compression", CODECS[codec.upper()])
    writer = writer.option("parquet.writer.version", f"PARQUET_{version}_0").option("parquet.enable.dictionary", str(dictionary).lower())
    for name in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    if file_rows:
        writer = writer.option("maxRecordsPerFile", str(file_rows))
    writer.parquet(path)


def write_empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """A file of no rows: a footer with the schema alone."""
    write(spark.createDataFrame([], schema).coalesce(1), path)
