"""Random access to bytes: local files, stores that Arrow opens by URI, and whatever is registered.

Executors open a URI by its scheme: ``OPENERS`` has local files and the object stores that Arrow
knows, and ``register_opener`` adds others; a plan takes the openers along that are there when it is
made. The driver can also read any store that Hadoop's file systems reach.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Protocol
from urllib.parse import unquote


class ByteRanges(Protocol):
    """What a source of bytes must offer; instances are made on the executors that use them."""

    def size(self) -> int: ...

    def read(self, offset: int, length: int) -> bytes:
        """Exactly length bytes; EOFError if there are fewer."""


def _whole(data: bytes, length: int) -> bytes:
    if len(data) != length:
        raise EOFError(f"{length} bytes wanted, {len(data)} there")
    return data


class FileRanges:
    def __init__(self, path: str):
        # Spark names files by URI, with escapes
        self.path = unquote(path.removeprefix("file:").removeprefix("//")) if path.startswith("file:") else path

    def size(self) -> int:
        return os.path.getsize(self.path)

    def read(self, offset: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return _whole(f.read(length), length)


class ArrowRanges:
    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return _whole(self.file.read_at(length, offset), length)


class HadoopRanges:
    """Any store that Spark reads; on the driver alone, for it goes through the driver's JVM."""

    def __init__(self, spark, uri: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path(uri)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray

    def size(self) -> int:
        return self.system.getFileStatus(self.path).getLen()

    def read(self, offset: int, length: int) -> bytes:
        if offset + length > self.size():
            raise EOFError(f"{length} bytes wanted at {offset}")
        stream = self.system.open(self.path)
        try:
            stream.seek(offset)
            return bytes(self.copy(stream, length))
        finally:
            stream.close()


def as_arrow(scheme: str) -> Callable[[str], ByteRanges]:
    """An opener for URIs that Arrow knows under another scheme."""
    return lambda uri: ArrowRanges(f"{scheme}:{uri.partition(':')[2]}")


#: How to open a URI, by scheme; Hadoop's names for S3 are Arrow's s3.
OPENERS: dict[str, Callable[[str], ByteRanges]] = {
    "": FileRanges, "file": FileRanges, "s3": ArrowRanges, "s3a": as_arrow("s3"), "s3n": as_arrow("s3"), "gs": ArrowRanges,
    "abfs": ArrowRanges, "abfss": ArrowRanges, "hdfs": ArrowRanges,
}


def register_opener(scheme: str, opener: Callable[[str], ByteRanges]) -> None:
    """How executors open URIs of a further (or the same) scheme; the opener must pickle."""
    OPENERS[scheme] = opener


def scheme_of(uri: str) -> str:
    head, colon, _ = uri.partition(":")
    return head if colon and "/" not in head else ""


def open_ranges(uri: str, openers: dict | None = None) -> ByteRanges:
    openers = OPENERS if openers is None else openers
    if scheme_of(uri) not in openers:
        raise ValueError(f"no opener for {uri}; register_opener() tells executors how to open its scheme")
    return openers[scheme_of(uri)](uri)


def driver_ranges(spark, uri: str) -> ByteRanges:
    """The same on the driver: local files as they are, anything else as Spark reads it."""
    return FileRanges(uri) if scheme_of(uri) in ("", "file") else HadoopRanges(spark, uri)
