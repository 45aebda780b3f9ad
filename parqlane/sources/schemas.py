"""Schemas: a step-by-step builder, and message descriptors as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


class SchemaBuilder:
    """A struct, built from the outside in: add() a leaf, or a group and then its own fields."""

    def __init__(self, name: str = "schema", repeated: bool = False, nullable: bool = True, metadata: dict | None = None):
        self.name, self.repeated, self.nullable, self.metadata = name, repeated, nullable, metadata or {}
        self.children: list[SchemaBuilder | T.StructField] = []

    def add(self, name: str, kind: T.DataType, nullable: bool = True, repeated: bool = False, metadata: dict | None = None) -> SchemaBuilder:
        self.children.append(T.StructField(name, T.ArrayType(kind, False) if repeated else kind, nullable, metadata or {}))
        return self

    def group(self, name: str, repeated: bool = False, nullable: bool = True, metadata: dict | None = None) -> SchemaBuilder:
        """A group of fields; returns the group's builder."""
        self.children.append(SchemaBuilder(name, repeated, nullable, metadata))
        return self.children[-1]

    def build(self) -> T.StructType:
        fields = []
        for c in self.children:
            if isinstance(c, SchemaBuilder):
                kind: T.DataType = c.build()
                c = T.StructField(c.name, T.ArrayType(kind, False) if c.repeated else kind, c.nullable, c.metadata)
            fields.append(c)
        return T.StructType(fields)


def from_descriptor(descriptor, enums_as_int: bool = False) -> T.StructType:
    """The schema of a Protobuf message; field numbers go into the metadata as parquet.field.id.

    Unsigned 32 bits widen to bigint, unsigned 64 bits to decimal(20,0); repeated fields are arrays
    and maps arrays of key and value; groups and messages that hold themselves are refused.
    """
    return _message(descriptor, enums_as_int, ())


def _message(descriptor, enums_as_int, above) -> T.StructType:
    if descriptor.full_name in above:
        raise ValueError(f"{descriptor.full_name} holds itself")
    fields = []
    for f in descriptor.fields:
        kind = _field(f, enums_as_int, (*above, descriptor.full_name))
        if f.is_repeated:
            kind = T.ArrayType(kind, False)
        fields.append(T.StructField(f.name, kind, not (f.is_required or f.is_repeated), {"parquet.field.id": f.number}))
    return T.StructType(fields)


def _field(f, enums_as_int, above) -> T.DataType:
    if f.type == f.TYPE_GROUP:
        raise ValueError(f"{f.full_name}: groups aren't handled")
    if f.type == f.TYPE_MESSAGE:
        return _message(f.message_type, enums_as_int, above)
    if f.type == f.TYPE_ENUM:
        return T.IntegerType() if enums_as_int else T.StringType()
    kinds = {
        T.BinaryType(): (f.TYPE_BYTES,), T.StringType(): (f.TYPE_STRING,), T.BooleanType(): (f.TYPE_BOOL,), T.FloatType(): (f.TYPE_FLOAT,),
        T.DoubleType(): (f.TYPE_DOUBLE,), T.IntegerType(): (f.TYPE_INT32, f.TYPE_SINT32, f.TYPE_SFIXED32),
        T.LongType(): (f.TYPE_INT64, f.TYPE_SINT64, f.TYPE_SFIXED64, f.TYPE_UINT32, f.TYPE_FIXED32), T.DecimalType(20, 0): (f.TYPE_UINT64, f.TYPE_FIXED64),
    }
    return next(kind for kind, types in kinds.items() if f.type in types)
