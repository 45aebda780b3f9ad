"""Nested projection: sets of paths, their union, and pruned schemas or columns.

A path that ends on a group takes the group's whole subtree; the empty path takes everything; an
unknown name selects nothing. Nesting is kept and fields stay in the schema's order. ``prune`` gives
the schema to read, so unselected leaves never leave the file; ``project`` prunes a DataFrame that is
already there, with null groups and null lists staying null.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.operators.predicates import Path, as_path


class ColumnSpec:
    """A tree of names; None stands for all that is below.

    A subclass may answer includes_child and for_child itself; unions ask it too.
    """

    def __init__(self, tree: dict | None):
        self.tree = tree

    def includes_child(self, name: str) -> bool:
        return self.tree is None or name in self.tree

    def for_child(self, name: str) -> ColumnSpec:
        return ColumnSpec(None if self.tree is None else self.tree.get(name, {}))

    def includes_path(self, path) -> bool:
        """Whether the value at a path, or anything below it, is selected."""
        spec = self
        for name in as_path(path):
            if not spec.includes_child(name):
                return False
            spec = spec.for_child(name)
        return True

    def __or__(self, other: ColumnSpec) -> ColumnSpec:
        if type(self) is type(other) is ColumnSpec:
            return ColumnSpec(_merge(self.tree, other.tree))
        return Either(self, other)

    def __eq__(self, other):
        return isinstance(other, ColumnSpec) and self.tree == other.tree

    def __hash__(self):
        return hash(repr(self.tree))


class Either(ColumnSpec):
    """What any of its members takes; every member is asked."""

    def __init__(self, *members: ColumnSpec):
        super().__init__(None if any(m.tree is None for m in members) else {})
        self.members = members

    def includes_child(self, name):
        return any(m.includes_child(name) for m in self.members)

    def for_child(self, name):
        return union(*(m.for_child(name) for m in self.members if m.includes_child(name)))

    def __eq__(self, other):
        return isinstance(other, Either) and self.members == other.members

    def __hash__(self):
        return hash(self.members)


def _merge(a, b):
    if a is None or b is None:
        return None
    return {k: _merge(a.get(k, {}), b.get(k, {})) for k in {**a, **b}}


def all_columns() -> ColumnSpec:
    return ColumnSpec(None)


def no_columns() -> ColumnSpec:
    """Nothing: the rows stay, without columns."""
    return ColumnSpec({})


def column(*path: str) -> ColumnSpec:
    """One path, as names or one dotted string."""
    names: Path = as_path(path[0]) if len(path) == 1 and path[0] else tuple(p for p in path if p)
    tree = None
    for name in reversed(names):
        tree = {name: tree}
    return ColumnSpec(tree)


def union(*specs: ColumnSpec) -> ColumnSpec:
    return reduce(or_, specs) if specs else no_columns()


def prune(kind: T.DataType, spec: ColumnSpec) -> T.DataType | None:
    """The type with the selected fields alone; None if nothing of it is selected."""
    if spec.tree is None:
        return kind
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            below = prune(f.dataType, spec.for_child(f.name)) if spec.includes_child(f.name) else None
            if below is not None:
                fields.append(T.StructField(f.name, below, f.nullable, f.metadata))
        return T.StructType(fields) if fields else None
    if isinstance(kind, T.ArrayType):
        below = prune(kind.elementType, spec)
        return None if below is None else T.ArrayType(below, kind.containsNull)
    if isinstance(kind, T.MapType):  # a map keeps its keys
        below = prune(kind.valueType, spec.for_child("value")) if spec.includes_child("value") else None
        return kind if below is None else T.MapType(kind.keyType, below, kind.valueContainsNull)
    return None


def _shaped(value: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    if kind == wanted:
        return value
    if isinstance(kind, T.StructType):
        fields = [_shaped(value.getField(f.name), kind[f.name].dataType, f.dataType).alias(f.name) for f in wanted.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _shaped(x, kind.elementType, wanted.elementType))
    return F.transform_values(value, lambda _, x: _shaped(x, kind.valueType, wanted.valueType))


def project(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    wanted = prune(df.schema, spec) or T.StructType()
    return df.select(*(_shaped(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType).alias(f.name) for f in wanted.fields))
