"""Logical types that Spark's reader refuses: what to read them as, and how to turn them into values.

UUID, TIME and TIMESTAMP in nanoseconds and FLOAT16 have no Spark type, so a file that holds them is
read with an explicit schema of raw values. The choice comes from one file's footer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.sources.footer import Leaf, read_footer, some_footer
from parqlane.sources.ranges import driver_ranges

#: Raw Spark types by logical type.
RAW = {
    "UUID": T.BinaryType(), "FLOAT16": T.BinaryType(), "TIME(MILLIS)": T.IntegerType(), "TIME(MICROS)": T.LongType(),
    "TIME(NANOS)": T.LongType(), "TIMESTAMP(NANOS)": T.LongType(),
}


def uuid_text(raw: Column) -> Column:
    """16 bytes as 8-4-4-4-12 lowercase hex digits."""
    h = F.lower(F.hex(raw))
    return F.when(raw.isNotNull(), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def duration(raw: Column, per_second: int) -> Column:
    """A count of units of a second as a day-time interval, cut to whole microseconds."""
    whole = raw.cast("long")  # whole numbers throughout: doubles would round
    if per_second > 10**6:
        unit = F.lit(per_second // 10**6)
        micros = F.call_function("div", whole - F.pmod(whole, unit), unit)
    else:
        micros = whole * (10**6 // per_second)
    seconds = (micros.cast("decimal(20,0)") / F.lit(10**6)).cast("decimal(18,6)")
    return F.when(raw.isNotNull(), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def nanos_timestamp(raw: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp without time zone, cut to microseconds."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + duration(raw, 10**9)


def half(raw: Column) -> Column:
    """Two little-endian bytes as a 16-bit float."""
    low, high = (F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int") for k in (1, 2))
    sign = F.when(high >= 128, -1.0).otherwise(1.0)
    exponent, part = F.floor((high % 128) / 4), (high % 4) * 256 + low
    value = F.when(exponent == 0, part / F.lit(2.0**24)).otherwise((1 + part / F.lit(1024.0)) * F.pow(F.lit(2.0), exponent - 15))
    special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 31, special).otherwise(value)).cast("float")


CONVERT = {
    "UUID": uuid_text, "FLOAT16": half, "TIME(MILLIS)": lambda c: duration(c, 10**3), "TIME(MICROS)": lambda c: duration(c, 10**6),
    "TIME(NANOS)": lambda c: duration(c, 10**9), "TIMESTAMP(NANOS)": nanos_timestamp,
}
#: Spark types of the rest, by physical type.
_PLAIN = {
    "BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "INT96": T.TimestampType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "BYTE_ARRAY": T.BinaryType(), "FIXED_LEN_BYTE_ARRAY": T.BinaryType(),
}
#: Spark types by signed or unsigned bits.
_INTEGERS = {
    (8, "signed"): T.ByteType(), (16, "signed"): T.ShortType(), (32, "signed"): T.IntegerType(), (64, "signed"): T.LongType(),
    (8, "unsigned"): T.ShortType(), (16, "unsigned"): T.IntegerType(), (32, "unsigned"): T.LongType(), (64, "unsigned"): T.DecimalType(20, 0),
}


def read_type(leaf: Leaf) -> T.DataType:
    """What to read a column as."""
    logical = leaf.logical
    if logical is None:
        return T.StringType() if leaf.element.get(6) in (0, 4, 19) else _PLAIN[leaf.physical]
    if logical in RAW:
        return RAW[logical]
    if logical.startswith("INTEGER"):
        bits, sign = logical[8:-1].split(",")
        return _INTEGERS[int(bits), sign]
    if logical.startswith("DECIMAL"):
        return T.DecimalType(*map(int, logical[8:-1].split(",")))
    if logical.startswith("TIMESTAMP"):
        utc = leaf.element[10][8][1]
        return T.TimestampType() if utc else T.TimestampNTZType()
    return {"STRING": T.StringType(), "ENUM": T.StringType(), "JSON": T.StringType(), "DATE": T.DateType()}.get(logical, _PLAIN[leaf.physical])


#: Fixed by the format: numbers of the annotations in their older form.
_OLD_MAPS, _OLD_LIST = (1, 2), 3


@dataclass(frozen=True)
class Node:
    """A field of a file's schema."""

    element: dict
    children: tuple[Node, ...]

    @property
    def name(self) -> str:
        return self.element[4].decode()

    @property
    def leaf(self) -> Leaf:
        return Leaf((self.name,), self.element, 0, 0)

    def annotated(self, logical: int, *older: int) -> bool:
        return logical in self.element.get(10, {}) or self.element.get(6) in older

    def below(self) -> tuple[str, tuple[Node, ...]]:
        """What the field's values are: ("leaf" | "list" | "map" | "group", the nodes inside)."""
        if not self.element.get(5):
            return "leaf", ()
        inner = self.children[0]
        if self.annotated(3, _OLD_LIST):
            wrapped = len(inner.children) == 1 and inner.name not in ("array", f"{self.name}_tuple")
            return "list", (inner.children[0] if wrapped else inner.once(),)
        if self.annotated(2, *_OLD_MAPS) and len(inner.children) == 2:
            return "map", inner.children
        return "group", self.children

    @property
    def repeated(self) -> bool:
        return self.element.get(3) == 2

    def once(self) -> Node:
        """The field as one element of its list."""
        return Node({**self.element, 3: 0}, self.children)

    def kind(self) -> T.DataType:
        """What to read the field as."""
        if self.repeated:
            return T.ArrayType(self.once().kind())
        shape, inside = self.below()
        if shape == "leaf":
            return read_type(self.leaf)
        kinds = [n.kind() for n in inside]
        if shape == "list":
            return T.ArrayType(kinds[0])
        return T.MapType(*kinds) if shape == "map" else T.StructType([T.StructField(n.name, k) for n, k in zip(inside, kinds)])

    def converted(self, value: Column) -> Column:
        """The field's values from what was read."""
        if self.repeated:
            return self._each(value, self.once())
        shape, inside = self.below()
        if shape == "leaf":
            return CONVERT.get(self.leaf.logical, lambda c: c)(value)
        if not any(n.special() for n in inside):
            return value
        if shape == "list":
            return self._each(value, inside[0])
        if shape == "map":
            key, held = inside
            return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(key.converted(e["key"]), held.converted(e["value"]))))
        return F.when(value.isNotNull(), F.struct(*(n.converted(value.getField(n.name)).alias(n.name) for n in inside)))

    @staticmethod
    def _each(value: Column, node: Node) -> Column:
        return F.transform(value, node.converted) if node.special() else value

    def special(self) -> bool:
        """Whether anything in the field has to be converted."""
        shape, inside = self.below()
        return self.leaf.logical in CONVERT if shape == "leaf" else any(n.special() for n in inside)


def fields_of(footer: dict) -> tuple[Node, ...]:
    """The fields of a file's schema, in file order."""
    elements = iter(footer[2])

    def take():
        e = next(elements)
        return Node(e, tuple(take() for _ in range(e.get(5) or 0)))

    return take().children


def read_any(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """Parquet files, flat or nested, converted where Spark has no type of its own.

    ``file``: a file whose footer tells the types; by default one of those below ``path``.
    """
    footer = read_footer(driver_ranges(spark, file)) if file else some_footer(spark, path)
    fields = fields_of(footer)
    df = spark.read.schema(T.StructType([T.StructField(n.name, n.kind()) for n in fields])).parquet(path)
    return df.select(*(n.converted(F.col(f"`{n.name}`")).alias(n.name) for n in fields))
