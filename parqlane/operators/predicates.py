"""Predicates over flat, nested and repeated fields, and their lowering to one boolean Column.

A predicate names a path of field names. Where the path goes through an array (or a map, as a list
of key and value), some element must match. Conditions that an intersection puts on one and the same
repeated path hold for one element together; conditions on different paths look for elements of
their own. Null matches nothing. A union or intersection of nothing is true. The lowering is ordinary
Column algebra, so flat and struct predicates reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Context, Decimal
from functools import reduce
from operator import and_, ge, gt, le, lt, or_
from operator import eq as equal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = tuple[str, ...]


def as_path(path) -> Path:
    """A path from a dotted string or a sequence of names."""
    return tuple(path.split(".")) if isinstance(path, str) else tuple(path)


class Predicate:
    def __or__(self, other: Predicate) -> Predicate:
        return Combined(or_, (self, other))

    def __and__(self, other: Predicate) -> Predicate:
        return Combined(and_, (self, other))

    def paths(self) -> list[Path]:
        raise NotImplementedError

    def value_of(self, leaf: Column, kind: T.DataType) -> Column:
        """The condition on one leaf value; every path in it is that leaf's."""
        raise NotImplementedError

    def lower(self, schema: T.StructType) -> Column:
        """The boolean Column over rows of this schema."""
        paths = set(self.paths())
        if len(paths) == 1:
            return at_path(schema, paths.pop(), self.value_of)
        return self._lower_apart(schema)

    def _lower_apart(self, schema: T.StructType) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Comparison(Predicate):
    compare: Callable
    path: Path
    value: object

    def __post_init__(self):
        if self.value is None:
            raise ValueError("null matches nothing; give a value")

    def paths(self):
        return [self.path]

    def value_of(self, leaf, kind):
        if isinstance(kind, (T.StructType, T.MapType)):
            raise LookupError(f"{'.'.join(self.path)} is a group of fields")
        return _compared(self.compare, leaf, kind, self.value)


@dataclass(frozen=True)
class Custom(Predicate):
    """Any condition on the value at a path; it sees one element where the path is repeated."""

    path: Path
    condition: Callable[[Column], Column]

    def paths(self):
        return [self.path]

    def value_of(self, leaf, kind):
        return self.condition(leaf)


@dataclass(frozen=True)
class Combined(Predicate):
    combine: Callable
    parts: tuple[Predicate, ...]

    def paths(self):
        return [p for part in self.parts for p in part.paths()]

    def value_of(self, leaf, kind):
        values = [p.value_of(leaf, kind) for p in self.parts]
        return reduce(self.combine, values) if values else F.lit(True)

    def _lower_apart(self, schema):
        if not self.parts:
            return F.lit(True)
        if self.combine is and_:  # bring together what looks at one path, so that it can be one element's
            flat: list[Predicate] = []
            for p in self.parts:
                flat += p.parts if isinstance(p, Combined) and p.combine is and_ else (p,)
            groups: dict[object, list[Predicate]] = {}
            for k, p in enumerate(flat):
                own = set(p.paths())
                groups.setdefault(own.pop() if len(own) == 1 else k, []).append(p)
            lowered = [g[0].lower(schema) if len(g) == 1 else Combined(and_, tuple(g)).lower(schema) for g in groups.values()]
        else:
            lowered = [p.lower(schema) for p in self.parts]
        return reduce(self.combine, lowered)


#: Fixed: bits of the whole-number types.
_WHOLE = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _compared(compare: Callable, leaf: Column, kind: T.DataType, value) -> Column:
    """compare(leaf, value), with the value as it is: a literal is never narrowed to the column's type.

    Numbers against whole-number and decimal columns, and times against date columns, are brought to
    the column's grid first: above the grid point below a value is above the value. What the type
    can't reach is decided for all values that aren't null. So the literal has the column's own type
    and the comparison reaches the scan. NaN equals itself and is above all numbers, as Spark has it.
    """
    if compare not in (equal, gt, ge, lt, le):
        return compare(leaf, literal(value, kind))
    if isinstance(kind, (T.FloatType, T.DoubleType)) and value != value:  # a pushed "= NaN" would lose row groups
        nan = F.isnan(leaf)
        return leaf.isNotNull() & {equal: nan, ge: nan, gt: F.lit(False), lt: ~nan, le: F.lit(True)}[compare]
    if isinstance(kind, T.DateType) and isinstance(value, str) and len(value) > 10:
        value = dt.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType) and isinstance(value, dt.datetime) and value.tzinfo is None:
        return _on_grid(compare, leaf, F.lit(value.date()), value.time() == dt.time())
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if number and isinstance(kind, (T.DecimalType, *_WHOLE)):
        if isinstance(kind, T.DecimalType):
            low, high = -(10**kind.precision) + 1, 10**kind.precision - 1
            scale = kind.scale
        else:
            bits = _WHOLE[type(kind)]
            low, high, scale = -(1 << bits - 1), (1 << bits - 1) - 1, 0
        exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
        above, units = exact.is_nan() or exact > 0, None  # NaN is above all numbers
        if exact.is_finite() and exact.adjusted() < 80:
            units = int(exact.scaleb(scale, _WIDE).to_integral_value(ROUND_FLOOR))
        if units is None or not low <= units <= high:
            whole = above if units is None else units > high
            return leaf.isNotNull() & F.lit(compare in ((lt, le) if whole else (gt, ge)))
        point = F.lit(Decimal(units).scaleb(-scale, _WIDE)).cast(kind) if isinstance(kind, T.DecimalType) else F.lit(units).cast(kind)
        return _on_grid(compare, leaf, point, Decimal(units) == exact.scaleb(scale, _WIDE))
    return compare(leaf, literal(value, kind))


_WIDE = Context(prec=200)


def _on_grid(compare: Callable, leaf: Column, point: Column, exact: bool) -> Column:
    """The comparison with a value that stands at a grid point, or between it and the next."""
    if exact:
        return compare(leaf, point)
    if compare is equal:
        return leaf.isNotNull() & F.lit(False)
    return leaf > point if compare in (gt, ge) else leaf <= point


def literal(value, kind: T.DataType) -> Column:
    """A literal to compare a column of this type with; moments without a zone are the session's."""
    moments = (T.TimestampNTZType, T.TimestampType)
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(str(value)).cast(kind if isinstance(kind, moments) else "timestamp_ntz")
    if isinstance(value, Decimal) and value.is_finite():
        return F.lit(Decimal(format(value, "f")))
    if isinstance(kind, moments) or (isinstance(kind, T.DateType) and not isinstance(value, dt.datetime)):
        return F.lit(value).cast(kind)
    return F.lit(value)


def kind_at(schema: T.DataType, path: Path) -> T.DataType:
    """The type at a path; elements stand for their array, entries for their map."""
    kind = schema
    for k, name in enumerate(path):
        kind = _inside(kind)
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise LookupError(f"no field {'.'.join(path[: k + 1])}")
        kind = kind[name].dataType
    return kind


def _inside(kind: T.DataType) -> T.DataType:
    while isinstance(kind, (T.ArrayType, T.MapType)):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        else:
            kind = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
    return kind


def at_path(schema: T.StructType, path: Path, condition) -> Column:
    """condition(leaf, type) for the value, or some value, at a path."""
    kind_at(schema, path)
    def down(value: Column, kind: T.DataType, rest: Path) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.exists(value, lambda x: down(x, kind.elementType, rest))
        if isinstance(kind, T.MapType):
            return F.exists(F.map_entries(value), lambda x: down(x, _inside(kind), rest))
        if not rest:
            return condition(value, kind)
        return down(value.getField(rest[0]), kind[rest[0]].dataType, rest[1:])

    return down(F.col(f"`{path[0]}`"), schema[path[0]].dataType, path[1:])


def equals(path, value) -> Predicate:
    return Comparison(equal, as_path(path), value)


def greater_than(path, value) -> Predicate:
    return Comparison(gt, as_path(path), value)


def greater_than_or_equal(path, value) -> Predicate:
    return Comparison(ge, as_path(path), value)


def less_than(path, value) -> Predicate:
    return Comparison(lt, as_path(path), value)


def less_than_or_equal(path, value) -> Predicate:
    return Comparison(le, as_path(path), value)


def matching(path, condition: Callable[[Column], Column]) -> Predicate:
    return Custom(as_path(path), condition)


def union(*parts: Predicate) -> Predicate:
    return Combined(or_, parts)


def intersection(*parts: Predicate) -> Predicate:
    return Combined(and_, parts)


def everything() -> Predicate:
    return Combined(and_, ())
