"""Parquet footers: row groups and column chunks with statistics, dictionaries and bloom filters.

``chunks`` gives a DataFrame of one row per (file, row group, column chunk). Files are listed and
their footers read by tasks, a few files each, so a table of millions of files is a distributed scan
of footers and no list of files reaches the driver's Python. Files in a store that executors have no
opener for (``ranges.OPENERS``) are read by the driver, one after another.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import uuid
from dataclasses import dataclass
from decimal import Decimal
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parqlane.sources.bloom import plain_bytes, read_filter
from parqlane.sources.ranges import OPENERS, ByteRanges, driver_ranges, open_ranges, scheme_of
from parqlane.sources.thrift import Reader

#: Fixed by the format: names by number.
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
LOGICAL = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INTEGER", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16", 16: "VARIANT", 17: "GEOMETRY", 18: "GEOGRAPHY"}
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}
DICTIONARY_ENCODINGS = {2, 8}


class NotParquet(ValueError):
    pass


def footer_length(source: ByteRanges) -> int:
    """Bytes of the file's metadata, as its last bytes say."""
    size = source.size()
    if size < 12:
        raise NotParquet("too short for a Parquet file")
    tail = source.read(size - 8, 8)
    if tail[4:] == b"PARE":
        raise NotParquet("files with encrypted footers can't be read")
    if tail[4:] != b"PAR1":
        raise NotParquet("no Parquet magic at the end")
    (length,) = struct.unpack("<I", tail[:4])
    if length > size - 12:
        raise NotParquet("the footer's length doesn't fit the file")
    return length


def read_footer(source: ByteRanges) -> dict:
    """The file's metadata, as the numbered fields of the format's definition."""
    length = footer_length(source)
    return Reader(source.read(source.size() - 8 - length, length)).fields()


@dataclass(frozen=True)
class Leaf:
    """A column of the file, with the levels of its path."""

    path: tuple[str, ...]
    element: dict
    max_repetition: int
    max_definition: int

    @property
    def physical(self) -> str:
        return PHYSICAL[self.element[1]]

    @property
    def logical(self) -> str | None:
        kind = self.element.get(10)
        if not kind:
            return None
        number, body = next(iter(kind.items()))
        name = LOGICAL.get(number)
        if name in ("TIME", "TIMESTAMP"):
            return f"{name}({UNITS[next(iter(body[2]))]})"
        if name == "INTEGER":
            return f"INTEGER({body[1]},{'signed' if body[2] else 'unsigned'})"
        if name == "DECIMAL":
            return f"DECIMAL({body[2]},{body[1]})"
        return name


def leaves(footer: dict) -> list[Leaf]:
    """The columns in file order."""
    elements = iter(footer[2])
    out: list[Leaf] = []

    def walk(path, repetition, definition, n):
        for _ in range(n):
            e = next(elements)
            kind = REPETITIONS[e.get(3, 0)]
            r, d = repetition + (kind == "REPEATED"), definition + (kind != "REQUIRED")
            own = (*path, e[4].decode())
            if e.get(5):
                walk(own, r, d, e[5])
            else:
                out.append(Leaf(own, e, r, d))

    walk((), 0, 0, next(elements).get(5, 0))
    return out


def typed(data: bytes | None, leaf: Leaf):
    """A statistic's bytes as a value.

    Bytes that aren't text, and unknown kinds, stay bytes; moments that Python's calendar doesn't
    reach stay numbers.
    """
    if data is None:
        return None
    try:
        return _typed(data, leaf)
    except UnicodeDecodeError:
        return data
    except OverflowError:
        return int.from_bytes(data, "little", signed=True)


def _typed(data: bytes, leaf: Leaf):
    physical, logical = leaf.physical, leaf.logical or ""
    if physical == "BOOLEAN":
        return bool(data[0])
    if physical in ("INT32", "INT64"):
        n = int.from_bytes(data, "little", signed="unsigned" not in logical)
        if logical == "DATE":
            return dt.date(1970, 1, 1) + dt.timedelta(days=n)
        if logical.startswith("TIMESTAMP"):
            if "NANOS" in logical:
                return n
            return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=n * (1000 if "MILLIS" in logical else 1))
        if logical.startswith("DECIMAL"):
            return Decimal(n).scaleb(-leaf.element[10][5][1])
        return n
    if physical in ("FLOAT", "DOUBLE"):
        return struct.unpack("<f" if physical == "FLOAT" else "<d", data)[0]
    if logical in ("STRING", "ENUM", "JSON") or (physical == "BYTE_ARRAY" and leaf.element.get(6) in (0, 4, 19)):
        return data.decode()
    if logical.startswith("DECIMAL"):
        return Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-leaf.element[10][5][1])
    return data


@dataclass(frozen=True)
class Chunk:
    """A column chunk of a file and what its metadata says."""

    leaf: Leaf
    meta: dict

    @property
    def statistics(self) -> dict:
        return self.meta.get(12, {})

    def range(self):
        """(least, greatest) or None: the newer fields, or the older ones where their order is sure."""
        s = self.statistics
        low, high = s.get(6), s.get(5)
        if low is None and high is None and self.leaf.physical in ("BOOLEAN", "INT32", "INT64", "FLOAT", "DOUBLE"):
            if "unsigned" not in (self.leaf.logical or ""):
                low, high = s.get(2), s.get(1)
        if low is None or high is None:
            return None
        low, high = typed(low, self.leaf), typed(high, self.leaf)
        return None if low != low or high != high else (low, high)

    @property
    def null_count(self) -> int | None:
        return self.statistics.get(3)

    @property
    def has_dictionary(self) -> bool:
        return 11 in self.meta

    @property
    def dictionary_complete(self) -> bool:
        """Whether every data page is dictionary-encoded, so that the dictionary has every value."""
        pages = self.meta.get(13)
        if not self.has_dictionary or not pages:
            return False
        return all(p[2] in DICTIONARY_ENCODINGS for p in pages if p[1] in (0, 3) and p[3])

    def dictionary(self, source: ByteRanges) -> list | None:
        """The dictionary page's values; None without a page or with a codec Arrow can't undo."""
        if not self.has_dictionary:
            return None
        import pyarrow as pa

        start = self.meta[11]
        reader = Reader(source.read(start, min(256, source.size() - start)))
        header = reader.fields()
        body = source.read(start + reader.at, header[3])
        codec = CODECS[self.meta[4]].lower()
        if codec != "uncompressed":
            if codec in ("lzo", "lz4") or not pa.Codec.is_available(codec.replace("lz4_raw", "lz4_raw")):
                return None
            body = pa.decompress(body, header[2], codec, asbytes=True)
        out, at, physical = [], 0, self.leaf.physical
        fixed = {"INT32": 4, "INT64": 8, "FLOAT": 4, "DOUBLE": 8, "INT96": 12}.get(physical) or self.leaf.element.get(2)
        for _ in range(header[7][1]):
            if physical == "BYTE_ARRAY":
                (n,) = struct.unpack_from("<I", body, at)
                at += 4
            else:
                n = fixed
            out.append(typed(body[at : at + n], self.leaf))
            at += n
        return out

    def bloom(self, source: ByteRanges):
        """(filter, hash) or None."""
        if 14 not in self.meta:
            return None
        start = self.meta[14]
        length = self.meta.get(15)
        if length is None:  # older writers leave it out: the header tells it
            head = Reader(source.read(start, min(64, source.size() - start)))
            length = head.fields()[1] + head.at
        return read_filter(source.read(start, length))

    def might_contain(self, value, source: ByteRanges | None) -> tuple[bool, str]:
        """(answer, what decided): statistics, then bloom filter, then a complete dictionary, then nulls.

        False is certain. What is missing rules nothing out. The value is first brought to the
        column's kind (``coerced``); one that no such column can hold is in no dictionary, but
        statistics and filters can't tell. NaN equals NaN, and zero equals negative zero.
        """
        value = coerced(value, self.leaf)
        bounds = self.range()
        if bounds is not None:
            try:
                if value < bounds[0] or value > bounds[1]:
                    return False, "statistics"
            except TypeError:
                pass
        if source is not None:
            found = self.bloom(source)
            if found is not None and (stored := _patterns(value, self.leaf)) and not any(found[0].might_contain(found[1](x)) for x in stored):
                return False, "bloom"
            if self.dictionary_complete and (values := self.dictionary(source)) is not None:
                return value in values or (value != value and any(v != v for v in values)), "dictionary"
        if self.null_count is not None and self.null_count >= self.meta[5]:
            return False, "nulls"
        return True, "statistics" if bounds is not None else "nothing"


def coerced(value, leaf: Leaf):
    """A value as this column's values come from ``typed``: text and bytes, numbers, dates and UUIDs."""
    logical, physical = leaf.logical or "", leaf.physical
    text = logical in ("STRING", "ENUM", "JSON") or (physical == "BYTE_ARRAY" and leaf.element.get(6) in (0, 4, 19))
    if isinstance(value, uuid.UUID):
        return str(value) if text else value.bytes
    if isinstance(value, (bytes, bytearray)) and text:
        try:
            return bytes(value).decode()
        except UnicodeDecodeError:
            return bytes(value)
    if isinstance(value, str) and not text:
        if logical == "UUID":
            try:
                return uuid.UUID(value).bytes
            except ValueError:
                return value
        return value.encode() if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") and "DECIMAL" not in logical else value
    if isinstance(value, dt.datetime) and logical == "DATE" and value.time() == dt.time():
        return value.date()
    if type(value) is dt.date and logical.startswith("TIMESTAMP"):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, float) and logical.startswith("DECIMAL") and math.isfinite(value):
        return Decimal(repr(value))
    return value


def _patterns(value, leaf: Leaf) -> list[bytes]:
    """The bytes by which a bloom filter may know a value; none if the filter can't tell."""
    stored, physical = _stored(value, leaf), leaf.physical
    if stored != stored:
        return []  # NaN has many patterns
    try:
        if physical in ("INT32", "INT64") and isinstance(stored, (float, Decimal)):
            if stored != int(stored):
                return []
            stored = int(stored)
        if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY") and not isinstance(stored, (str, bytes, bytearray)):
            return []
        wanted = [stored]
        if physical in ("FLOAT", "DOUBLE"):
            wanted = [0.0, -0.0] if stored == 0 else [float(stored)]
            if physical == "FLOAT" and struct.unpack("<f", struct.pack("<f", wanted[0]))[0] != wanted[0]:
                return []
        if "unsigned" in (leaf.logical or "") and stored >= 1 << (31 if physical == "INT32" else 63):
            wanted = [stored - (1 << (32 if physical == "INT32" else 64))]
        return [plain_bytes(v, physical) for v in wanted]
    except (KeyError, struct.error, TypeError, ValueError, OverflowError):
        return []


def _stored(value, leaf: Leaf):
    logical = leaf.logical or ""
    if isinstance(value, dt.datetime):
        micros = (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        return micros // 1000 if "MILLIS" in logical else micros
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days
    if isinstance(value, Decimal) and logical.startswith("DECIMAL") and leaf.physical in ("INT32", "INT64") and value.is_finite():
        return value.scaleb(leaf.element[10][5][1])
    return value


def row_groups(footer: dict) -> list[tuple[int, int, list[Chunk]]]:
    """(first row, rows, chunks) of each row group."""
    columns, out, first = leaves(footer), [], 0
    for group in footer.get(4, []):
        out.append((first, group[3], [Chunk(leaf, c[3]) for leaf, c in zip(columns, group[1], strict=True)]))
        first += group[3]
    return out


SCHEMA = """file string, row_group int, first_row long, group_rows long, column_index int, path string, physical_type string,
logical_type string, max_repetition int, max_definition int, codec string, encodings array<string>, num_values long,
null_count long, has_min_max boolean, min string, max string, has_dictionary boolean, dictionary_complete boolean,
has_bloom boolean, compressed_bytes long, uncompressed_bytes long"""


def chunk_rows(uri: str, source: ByteRanges):
    """The rows of ``chunks`` for one file."""
    for k, (first, rows, own) in enumerate(row_groups(read_footer(source))):
        for i, c in enumerate(own):
            bounds, m = c.range(), c.meta
            low, high = (None, None) if bounds is None else (_said(b) for b in bounds)
            yield (
                uri, k, first, rows, i, ".".join(c.leaf.path), c.leaf.physical, c.leaf.logical, c.leaf.max_repetition,
                c.leaf.max_definition, CODECS[m[4]], sorted(ENCODINGS.get(e, str(e)) for e in m[2]), m[5], c.null_count,
                bounds is not None, low, high, c.has_dictionary, c.dictionary_complete, 14 in m, m[7], m[6],
            )


def _said(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return value.hex() if isinstance(value, bytes) else str(value)


#: Files a task of a footer scan reads, and rows it gives at once, whatever a footer's size.
FILES_A_TASK = 32
ROWS_A_BATCH = 4096


def whole_uri(column: Column) -> Column:
    """Local files with three slashes, however Spark came by their names."""
    return F.regexp_replace(column, "^file:/+", "file:///")


def file_list(spark: SparkSession, *paths: str) -> DataFrame:
    """file: URIs of the files below the paths."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    name = F.substring_index("file", "/", -1)
    files = listed.select(whole_uri(F.col("path")).alias("file"))
    return files.where(~name.isin("_metadata", "_common_metadata"))


def files_of(spark: SparkSession, *paths: str) -> list[str]:
    """URIs of the files below the paths, on the driver."""
    return sorted(r.file for r in file_list(spark, *paths).collect())


def some_footer(spark: SparkSession, path: str) -> dict:
    """The footer of one of the files below a path, read by the driver."""
    first = file_list(spark, path).first()
    if first is None:
        raise NotParquet(f"no file below {path}")
    return read_footer(driver_ranges(spark, first.file))


def over_files(spark: SparkSession, paths, rows_of, schema: str) -> DataFrame:
    """Rows (tuples) that rows_of(uri, source) gives for every file below the paths."""
    from pyspark.sql.types import _parse_datatype_string

    kind, openers = _parse_datatype_string(schema), dict(OPENERS)
    if not {scheme_of(p) or _default_scheme(spark) for p in paths} <= set(openers):
        found = [row for uri in files_of(spark, *paths) for row in rows_of(uri, driver_ranges(spark, uri))]
        return spark.createDataFrame(found, kind)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            rows = (row for uri in batch.column(0).to_pylist() for row in rows_of(uri, open_ranges(uri, openers)))
            while some := list(islice(rows, ROWS_A_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)

    files = file_list(spark, *paths)
    tasks = files._jdf.queryExecution().toRdd().getNumPartitions()
    return files.coalesce(max(1, -(-tasks // FILES_A_TASK), min(tasks, spark.sparkContext.defaultParallelism))).mapInArrow(run, kind)


def _default_scheme(spark: SparkSession) -> str:
    sc = spark.sparkContext
    return scheme_of(sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).toString())


def chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per column chunk of the Parquet files below the paths."""
    return over_files(spark, paths, chunk_rows, SCHEMA)
