"""Row shapes: rows as maps, JSON objects, Protobuf messages or whatever a function makes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty_lists(df: DataFrame) -> DataFrame:
    """df with null lists, at any depth, as empty ones."""

    def filled(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            made = F.transform(value, lambda x: filled(x, kind.elementType)) if _has_list(kind.elementType) else value
            return F.coalesce(made, F.array().cast(kind))
        if isinstance(kind, T.StructType) and _has_list(kind):
            return F.when(value.isNotNull(), F.struct(*(filled(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
        return value

    return df.select(*(filled(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def _has_list(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_list(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType)


def as_maps(df: DataFrame) -> Iterator[dict]:
    """The rows, pulled one partition at a time, as nested dicts; null fields stay as keys."""
    return (row.asDict(recursive=True) for row in df.toLocalIterator())


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row: null fields are left out, absent lists are []."""
    return empty_lists(df).select(F.to_json(F.struct("*")).alias(name))


def as_protobuf(df: DataFrame, descriptor, name: str = "message") -> DataFrame:
    """One serialised message a row, fields by name; columns the message lacks are left out.

    descriptor: a google.protobuf Descriptor; it travels to the executors as a descriptor set.
    """
    packed, full_name = packed_descriptor(descriptor)

    def make(batches):
        import pyarrow as pa

        message = message_class(packed, full_name)
        for batch in batches:
            rows = [to_message(row, message).SerializeToString() for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=[name])

    return df.mapInArrow(make, f"`{name}` binary")


def packed_descriptor(descriptor) -> tuple[bytes, str]:
    """A descriptor's files, serialised, and its full name: what message_class() takes."""
    from google.protobuf import descriptor_pb2

    files, names = descriptor_pb2.FileDescriptorSet(), set()

    def add(file):
        for below in file.dependencies:
            add(below)
        if file.name not in names:
            names.add(file.name)
            file.CopyToProto(files.file.add())

    add(descriptor.file)
    return files.SerializeToString(), descriptor.full_name


def message_class(packed: bytes, full_name: str):
    """The message class of a serialised descriptor set."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(packed).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(full_name))


def to_message(row: dict, message):
    """A message from nested dicts; enums by name or number, maps from dicts or key-value lists."""
    out = message()
    for field in out.DESCRIPTOR.fields:
        value = row.get(field.name)
        if value is None:
            continue
        below = field.message_type
        if below is not None and below.GetOptions().map_entry:
            pairs = value.items() if isinstance(value, dict) else [(e["key"], e["value"]) if isinstance(e, dict) else e for e in value]
            target, inner = getattr(out, field.name), below.fields_by_name["value"]
            for k, v in pairs:
                k = _scalar(k, below.fields_by_name["key"])
                if inner.message_type is not None:
                    target[k].CopyFrom(to_message(v or {}, type(target[k])))
                else:
                    target[k] = _scalar(v, inner)
        elif field.is_repeated:
            target = getattr(out, field.name)
            if below is not None:
                for v in value:
                    item = target.add()
                    item.CopyFrom(to_message(v or {}, type(item)))
            else:
                target.extend(_scalar(v, field) for v in value)
        elif below is not None:
            target = getattr(out, field.name)
            target.SetInParent()
            target.CopyFrom(to_message(value, type(target)))
        else:
            setattr(out, field.name, _scalar(value, field))
    return out


def _scalar(value, field):
    if field.enum_type is not None and isinstance(value, str):
        return field.enum_type.values_by_name[value].number
    if field.cpp_type in (field.CPPTYPE_INT32, field.CPPTYPE_INT64, field.CPPTYPE_UINT32, field.CPPTYPE_UINT64):
        return int(value)  # wide unsigned numbers come as decimals
    return value


def shaped(df: DataFrame, shape: Callable[[dict], dict], schema) -> DataFrame:
    """Rows that a function makes of rows as dicts, batch by batch on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def make(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(kind)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([shape(row) for row in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(make, kind)


def drained(df: DataFrame) -> int:
    """Read everything and keep nothing; the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]
