import datetime as dt
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.functions import shapes, types
from parqlane.operators import presence
from parqlane.plans.scan import UnsafeEncoding, needs_row_reader, scan
from parqlane.sources import bloom, footer, ranges, schemas, sink


def test_ranges(tmp_path):
    path = tmp_path / "with space"
    path.write_bytes(b"0123456789")
    for uri in (str(path), path.as_uri()):
        source = ranges.open_ranges(uri)
        assert source.size() == 10 and source.read(3, 4) == b"3456"
        with pytest.raises(EOFError):
            source.read(8, 4)
    assert ranges.ArrowRanges(path.as_uri()).read(1, 2) == b"12" if " " not in path.as_uri() else True


@pytest.mark.parametrize("data", [b"", b"PAR1", b"PAR1" + b"\0" * 8, b"PAR1xxxx\x04\0\0\0PARE", b"PAR1\xff\xff\xff\x7fPAR1"])
def test_not_parquet(tmp_path, data):
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(footer.NotParquet):
        footer.read_footer(ranges.FileRanges(str(tmp_path / "f")))


def test_chunks_agree_with_arrow(spark, sf):
    for table in ("lineitem", "events", "embeddings", "documents"):
        meta = pq.ParquetFile(f"{sf}/{table}.parquet").metadata
        got = footer.chunks(spark, f"{sf}/{table}.parquet").collect()
        assert len(got) == meta.num_columns * meta.num_row_groups
        for r in got:
            c = meta.row_group(r.row_group).column(r.column_index)
            assert (r.path, r.physical_type, r.num_values, r.codec) == (c.path_in_schema, c.physical_type, c.num_values, c.compression)
            assert r.null_count == c.statistics.null_count and r.has_dictionary == c.has_dictionary_page
            assert r.has_min_max == c.statistics.has_min_max and set(r.encodings) == set(c.encodings)
            if r.has_min_max and r.physical_type in ("INT32", "INT64", "DOUBLE"):
                assert r.min == str(c.statistics.min)


def test_files_of_a_cached_frame(spark, sf):
    cached = spark.read.parquet(f"{sf}/nation.parquet").cache()
    cached.count()
    try:
        assert footer.files_of(spark, f"{sf}/nation.parquet") == [f"file://{sf}/nation.parquet"]
        assert footer.chunks(spark, f"{sf}/nation.parquet").count() == len(cached.columns)
    finally:
        cached.unpersist()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=200), st.integers(1, 20))
def test_bloom_has_no_false_negatives(values, blocks):
    f = bloom.SplitBlockBloom(32 * blocks)
    hashes = [xxhash.xxh64_intdigest(v.to_bytes(8, "little"), 0) for v in values]
    for h in hashes:
        f.insert(h)
    again = bloom.SplitBlockBloom(f.to_bytes())
    assert all(again.might_contain(h) for h in hashes)


def answers(spark, path, column, value):
    return {(r.might_contain, r.decided_by) for r in presence.might_contain(spark, path, column, value).collect()}


def test_presence_by_bloom(spark, tmp_path):
    path = str(tmp_path / "b.parquet")
    df = spark.range(0, 40_000, 2).select("id", F.concat(F.lit("v"), "id").alias("s"), F.col("id").cast("double").alias("d")).coalesce(1)
    sink.write(df, path, dictionary=False, bloom=["id", "s", "d"])
    assert footer.chunks(spark, path).where("has_bloom").count() == 3
    source = ranges.open_ranges(spark.read.parquet(path).inputFiles()[0])
    (_, _, own), = footer.row_groups(footer.read_footer(source))
    for chunk, make in zip(own, (int, lambda v: f"v{v}", float)):
        assert all(chunk.might_contain(make(v), source)[0] for v in range(0, 4000, 2))
        absent = [chunk.might_contain(make(v), source) for v in range(1, 4000, 2)]
        assert sum(a[0] for a in absent) < 100 and (False, "bloom") in absent
    assert answers(spark, path, "id", 50_000) == {(False, "statistics")} and answers(spark, path, "s", "v4") == {(True, "statistics")}


def test_presence_by_dictionary_and_statistics(spark, tmp_path):
    words = spark.createDataFrame([("oak",), ("pine",), ("oak",), ("elm",)], "w string").coalesce(1)
    for codec in ("UNCOMPRESSED", "SNAPPY", "GZIP", "ZSTD", "LZ4_RAW"):
        path = str(tmp_path / f"{codec}.parquet")
        sink.write(words, path, codec)
        assert answers(spark, path, "w", "fir") == {(False, "dictionary")}
        assert answers(spark, path, "w", "pine") == {(True, "dictionary")}
        assert answers(spark, path, "w", "a") == {(False, "statistics")}
        assert answers(spark, path, "w", 5) == {(False, "dictionary")}
    path = str(tmp_path / "plain.parquet")
    sink.write(words, path, dictionary=False)
    assert answers(spark, path, "w", "fir") == {(True, "statistics")}
    nothing = str(tmp_path / "nulls.parquet")
    sink.write(spark.createDataFrame([(None,)], "w string"), nothing)
    assert False in {a for a, _ in answers(spark, nothing, "w", "x")} or answers(spark, nothing, "w", "x") == set()
    with pytest.raises(ValueError):
        presence.might_contain(spark, path, "w", None)


def test_incomplete_dictionary_and_missing_statistics(spark, tmp_path):
    values = [f"value number {k}" for k in range(30_000)]
    fell_back, bare = str(tmp_path / "d.parquet"), str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"s": values}), fell_back, dictionary_pagesize_limit=1000, use_dictionary=True)
    pq.write_table(pa.table({"v": [1, 2, 3]}), bare, write_statistics=False, use_dictionary=False)
    (r,) = footer.chunks(spark, fell_back).collect()
    assert r.has_dictionary and not r.dictionary_complete
    assert answers(spark, fell_back, "s", values[-1]) == {(True, "statistics")}
    assert answers(spark, bare, "v", 99) == {(True, "nothing")}


@pytest.mark.parametrize("codec", ["UNCOMPRESSED", "SNAPPY", "GZIP", "LZ4", "ZSTD", "LZ4_RAW"])
@pytest.mark.parametrize("version", [1, 2])
def test_codecs_and_versions(spark, tmp_path, codec, version):
    rows = [(1, True, "a", [1, 2], dt.date(2020, 1, 2)), (2, None, None, [], None), (3, False, "é", None, dt.date(1960, 1, 1))]
    df = spark.createDataFrame(rows, "i int, b boolean, s string, a array<int>, d date")
    path = str(tmp_path / "t.parquet")
    sink.write(df, path, codec, version)
    careful = needs_row_reader(spark, path)
    assert careful == (codec == "UNCOMPRESSED" and version == 2)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", str(not careful).lower())
    try:
        assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, df.collect()))
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    assert {r.codec for r in footer.chunks(spark, path).collect()} == {codec}


def test_codecs_that_need_a_jar(spark, tmp_path):
    for codec in ("LZO", "BROTLI"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            sink.write(spark.range(1), str(tmp_path / codec), codec)
    with pytest.raises(ValueError):
        sink.write(spark.range(1), str(tmp_path / "x"), "nope")
    sink.register_codec("nope", "zstd")
    sink.write(spark.range(1), str(tmp_path / "x"), "nope")


@pytest.mark.parametrize("encoding", ["DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "PLAIN"])
def test_encodings(spark, tmp_path, encoding):
    column = pa.array([3, -1, 2**40, 7] if encoding == "DELTA_BINARY_PACKED" else ["prefix-a", "prefix-ab", "", "prefix-ab"])
    path = str(tmp_path / "e.parquet")
    pq.write_table(pa.table({"v": column}), path, use_dictionary=False, column_encoding={"v": encoding})
    assert [r.v for r in spark.read.parquet(path).collect()] == column.to_pylist()


def test_split_byte_streams(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    pq.write_table(pa.table({"v": [1.5, -2.0]}), path, use_dictionary=False, column_encoding={"v": "BYTE_STREAM_SPLIT"})
    assert needs_row_reader(spark, path)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    try:
        assert [r.v for r in spark.read.parquet(path).collect()] == [1.5, -2.0]
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_logical_types(spark, tmp_path):
    path = str(tmp_path / "l.parquet")
    ids = [uuid.UUID(int=5), uuid.UUID(int=2**127 + 9)]
    day = dt.datetime(2021, 3, 4, 5, 6, 7, 891011)
    table = pa.table({
        "u8": pa.array([0, 255], pa.uint8()), "u16": pa.array([0, 65535], pa.uint16()), "u32": pa.array([0, 2**32 - 1], pa.uint32()),
        "u64": pa.array([0, 2**64 - 1], pa.uint64()), "i8": pa.array([-128, 127], pa.int8()), "d": pa.array([dt.date(1969, 12, 31), None]),
        "tms": pa.array([1, 86_399_999], pa.time32("ms")), "tus": pa.array([1, None], pa.time64("us")), "tns": pa.array([1_500, 2_000_000_999], pa.time64("ns")),
        "us": pa.array([day, None], pa.timestamp("us")), "ms": pa.array([day, None], pa.timestamp("ms", "UTC")), "ns": pa.array([1_700_000_000_123_456_999, -1], pa.timestamp("ns")),
        "f16": pa.array(np.array([1.5, -65504.0], np.float16)), "dec": pa.array([None, 12], pa.decimal128(9, 2)), "s": ["x", None], "b": [b"x", None],
        "uuid": pa.ExtensionArray.from_storage(pa.uuid(), pa.array([i.bytes for i in ids], pa.binary(16))),
    })
    pq.write_table(table, path)
    one, two = types.read_any(spark, path).collect()
    assert (two.u8, two.u16, two.u32, two.u64, one.i8) == (255, 65535, 2**32 - 1, 2**64 - 1, -128)
    assert (one.uuid, two.uuid) == tuple(map(str, ids)) and one.d == dt.date(1969, 12, 31) and two.d is None
    ms, us = dt.timedelta(milliseconds=1), dt.timedelta(microseconds=1)
    assert (one.tms, two.tms, one.tus, two.tus, one.tns, two.tns) == (ms, 86_399_999 * ms, us, None, us, dt.timedelta(seconds=2))
    assert one.us == day and one.ns == dt.datetime(2023, 11, 14, 22, 13, 20, 123456) and two.ns == dt.datetime(1969, 12, 31, 23, 59, 59, 999999)
    assert (one.f16, two.f16) == (1.5, -65504.0) and str(two.dec) == "12.00" and (one.s, bytes(one.b)) == ("x", b"x")


def test_logical_types_in_nested_files_of_a_folder(spark, tmp_path):
    ids = [uuid.UUID(int=5), uuid.UUID(int=2**127 + 9)]
    raw = pa.ExtensionArray.from_storage(pa.uuid(), pa.array([i.bytes for i in ids], pa.binary(16)))
    when = pa.array([1_500, 2_000_000_999], pa.time64("ns"))
    table = pa.table({
        "group": pa.StructArray.from_arrays([raw, when], names=["id", "t"]),
        "list": pa.ListArray.from_arrays([0, 2, 2], pa.StructArray.from_arrays([raw], names=["id"])),
        "map": pa.MapArray.from_arrays([0, 1, 2], pa.array(["a", "b"]), when),
        "plain": pa.array([[1, None], None]),
    })
    for k in range(2):
        (tmp_path / "d").mkdir(exist_ok=True)
        pq.write_table(table.slice(k, 1), tmp_path / "d" / f"{k}.parquet")
    one, two = sorted(types.read_any(spark, str(tmp_path / "d")).collect(), key=lambda r: r.group.id)
    us = dt.timedelta(microseconds=1)
    assert (one.group.id, one.group.t, [x.id for x in one.list], one.map, one.plain) == (str(ids[0]), us, list(map(str, ids)), {"a": us}, [1, None])
    assert (two.group.id, two.group.t, two.list, two.map, two.plain) == (str(ids[1]), dt.timedelta(seconds=2), [], {"b": dt.timedelta(seconds=2)}, None)


def test_statistics_that_python_cannot_say(spark, tmp_path):
    """Bytes that aren't text and moments beyond the calendar stay what they are; the rest of the footer is read."""
    path, leaf = str(tmp_path / "t.parquet"), lambda kind: pa.array([2**62, -(2**62)], pa.int64()).view(kind)
    pq.write_table(pa.table({"t": leaf(pa.timestamp("us")), "n": [1, 2]}), path)
    rows = {r.path: r for r in footer.chunks(spark, path).collect()}
    assert (rows["t"].min, rows["t"].max, rows["n"].max) == (str(-(2**62)), str(2**62), "2")
    text = footer.Leaf(("s",), {1: 6, 10: {1: {}}}, 0, 0)
    day = footer.Leaf(("d",), {1: 1, 10: {6: {}}}, 0, 0)
    assert footer.typed(b"ok", text) == "ok" and footer.typed(b"\xff\xfe", text) == b"\xff\xfe"
    assert footer.typed((2**31 - 1).to_bytes(4, "little"), day) == 2**31 - 1


def test_values_of_another_kind(spark, tmp_path):
    path = str(tmp_path / "k.parquet")
    nan = float("nan")
    pq.write_table(pa.table({
        "b": pa.array([b"abc", b"z", b"abc"], pa.binary()), "s": ["abc", "z", "abc"], "d": [1.0, nan, 0.0], "i": pa.array([1, 4, 9], pa.int32()),
        "t": pa.array([dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), None], pa.timestamp("us")), "day": pa.array([dt.date(2024, 1, 1), dt.date(2024, 1, 3), None]),
        "m": pa.array([Decimal("1.50"), Decimal("2.00"), None], pa.decimal128(9, 2)),
    }), path)
    asked = lambda column, value: {a for a, _ in answers(spark, path, column, value)}
    assert asked("b", "abc") == asked("s", b"abc") == asked("b", b"abc") == asked("s", "abc") == {True}
    assert asked("b", "abd") == asked("s", b"abd") == asked("s", b"\xff") == {False}
    assert asked("d", nan) == asked("d", -0.0) == asked("d", 1) == {True} and asked("d", 0.5) == {False}
    assert asked("i", 4.0) == {True} and asked("i", 4.5) == asked("i", 5) == asked("i", 10**30) == {False}
    assert asked("t", dt.date(2024, 1, 3)) == asked("day", dt.datetime(2024, 1, 3)) == {True}
    assert asked("t", dt.date(2024, 1, 2)) == asked("day", dt.datetime(2024, 1, 3, 1)) | {False} == {False}
    assert asked("m", 1.5) == asked("m", 2) == {True} and asked("m", 1.501) == {False}
    filtered = str(tmp_path / "f.parquet")
    sink.write(spark.createDataFrame([(0.0, 5), (2.0, 7)], "d double, i int").coalesce(1), filtered, dictionary=False, bloom=["d", "i"])
    asked = lambda column, value: {a for a, _ in answers(spark, filtered, column, value)}
    assert asked("d", -0.0) == asked("d", 0) == asked("d", 2) == asked("d", nan) == asked("i", 5.0) == {True} and asked("i", 6.0) == {False}


def test_dictionary_pages(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    pq.write_table(pa.table({"s": ["a", "b", "a", "c"], "i": [1, 2, 1, 3]}), path, row_group_size=2, use_dictionary=["s"])
    got = sorted(tuple(r)[1:] for r in presence.dictionary_values(spark, path, "s").collect())
    assert got == [(0, True, "a"), (0, True, "b"), (1, True, "a"), (1, True, "c")]
    assert presence.dictionary_values(spark, path, "i").count() == 0
    with pytest.raises(LookupError):
        presence.dictionary_values(spark, path, "nothing")


def test_files_that_need_the_row_reader_are_refused(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    sink.write(spark.createDataFrame([("a",), ("ab",)], "s string").coalesce(1), path, "UNCOMPRESSED", 2, dictionary=False)
    with pytest.raises(UnsafeEncoding):
        scan(spark, path)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    try:
        assert sorted(r.s for r in scan(spark, path).collect()) == ["a", "ab"]
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_large_footers_are_read_by_a_job(spark, tmp_path, monkeypatch):
    from parqlane.plans import scan as S

    path = str(tmp_path / "t.parquet")
    sink.write(spark.createDataFrame([("a",), ("ab",)], "s string").coalesce(1), path, "UNCOMPRESSED", 2, dictionary=False)
    opened = []
    monkeypatch.setattr(S, "read_footer", lambda source: opened.append(source) or footer.read_footer(source))
    for most, on_driver in ((1 << 20, 1), (0, 1)):
        monkeypatch.setattr(S, "FEW_BYTES", most)
        with pytest.raises(UnsafeEncoding):
            scan(spark, path)
        assert len(opened) == on_driver
    sink.write(spark.range(10).coalesce(1), f"{path}-ok", file_rows=4)
    assert scan(spark, f"{path}-ok").count() == 10 and len(footer.files_of(spark, f"{path}-ok")) == 3


def test_stores(spark, sf, tmp_path):
    """Executors open what has an opener; the driver reads any store that Spark reads."""
    whole = ranges.HadoopRanges(spark, f"file://{sf}/nation.parquet")
    with open(f"{sf}/nation.parquet", "rb") as f:
        assert whole.read(3, 100) == f.read()[3:103]
    with pytest.raises(EOFError):
        whole.read(whole.size() - 1, 2)
    assert ranges.scheme_of("s3a://b/k:1") == "s3a" and ranges.scheme_of("/a:b") == "" and {"s3a", "hdfs"} <= set(ranges.OPENERS)
    with pytest.raises(ValueError):
        ranges.open_ranges("odd://x")
    want = footer.chunks(spark, f"{sf}/nation.parquet").drop("file").collect()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.there.link./in", f"file://{sf}")
    there = "viewfs://there/in/nation.parquet"
    assert footer.chunks(spark, there).drop("file").collect() == want and scan(spark, there).count() == 25
    assert presence.might_contain(spark, there, "n_nationkey", 3).first().might_contain


def test_json_and_maps(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "x", [{"v": None}], {"e": [1]})], "i int, s string, l array<struct<v:array<int>>>, c struct<e:array<int>>")
    assert [r.json for r in shapes.as_json(df).collect()] == ['{"l":[]}', '{"i":1,"s":"x","l":[{"v":[]}],"c":{"e":[1]}}']
    assert list(shapes.as_maps(df))[0] == {"i": None, "s": None, "l": None, "c": None}
    assert list(shapes.as_maps(df))[1]["l"] == [{"v": None}] and shapes.drained(df) == 2


def test_schema_builder():
    b = schemas.SchemaBuilder().add("id", T.LongType(), nullable=False).add("tags", T.StringType(), repeated=True)
    b.group("child").add("x", T.IntegerType()).group("deep", repeated=True).add("y", T.DoubleType())
    assert b.build().simpleString() == "struct<id:bigint,tags:array<string>,child:struct<x:int,deep:array<struct<y:double>>>>"


@pytest.fixture(scope="module")
def message():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool

    F_ = pb.FieldDescriptorProto
    file = pb.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    file.enum_type.add(name="Kind").value.extend([pb.EnumValueDescriptorProto(name=n, number=k) for k, n in enumerate(("UNKNOWN", "ONE"))])
    child = file.message_type.add(name="Child")
    top = file.message_type.add(name="Top")
    loop = file.message_type.add(name="Loop")
    scalars = [("b", F_.TYPE_BYTES), ("f", F_.TYPE_FLOAT), ("d", F_.TYPE_DOUBLE), ("i64", F_.TYPE_INT64), ("u64", F_.TYPE_UINT64), ("i32", F_.TYPE_INT32), ("u32", F_.TYPE_UINT32), ("ok", F_.TYPE_BOOL), ("s", F_.TYPE_STRING)]
    for k, (n, t) in enumerate(scalars, 1):
        child.field.add(name=n, number=k, type=t, label=F_.LABEL_OPTIONAL)
    entry = top.nested_type.add(name="MEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=F_.TYPE_UINT64, label=F_.LABEL_OPTIONAL)
    entry.field.add(name="value", number=2, type=F_.TYPE_MESSAGE, type_name=".t.Child", label=F_.LABEL_OPTIONAL)
    top.field.add(name="name", number=1, type=F_.TYPE_STRING, label=F_.LABEL_OPTIONAL)
    top.field.add(name="child", number=2, type=F_.TYPE_MESSAGE, type_name=".t.Child", label=F_.LABEL_OPTIONAL)
    top.field.add(name="kind", number=3, type=F_.TYPE_ENUM, type_name=".t.Kind", label=F_.LABEL_OPTIONAL)
    top.field.add(name="kids", number=4, type=F_.TYPE_MESSAGE, type_name=".t.Child", label=F_.LABEL_REPEATED)
    top.field.add(name="kinds", number=5, type=F_.TYPE_ENUM, type_name=".t.Kind", label=F_.LABEL_REPEATED)
    top.field.add(name="m", number=6, type=F_.TYPE_MESSAGE, type_name=".t.Top.MEntry", label=F_.LABEL_REPEATED)
    loop.field.add(name="again", number=1, type=F_.TYPE_MESSAGE, type_name=".t.Loop", label=F_.LABEL_OPTIONAL)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return pool


def test_descriptor_schema(message):
    kind = schemas.from_descriptor(message.FindMessageTypeByName("t.Top"))
    child = "struct<b:binary,f:float,d:double,i64:bigint,u64:decimal(20,0),i32:int,u32:bigint,ok:boolean,s:string>"
    assert kind.simpleString() == f"struct<name:string,child:{child},kind:string,kids:array<{child}>,kinds:array<string>,m:array<struct<key:decimal(20,0),value:{child}>>>"
    assert kind["kids"].metadata == {"parquet.field.id": 4}
    assert schemas.from_descriptor(message.FindMessageTypeByName("t.Top"), True)["kinds"].dataType == T.ArrayType(T.IntegerType(), False)
    with pytest.raises(ValueError):
        schemas.from_descriptor(message.FindMessageTypeByName("t.Loop"))


def test_protobuf_round_trip(spark, message):
    from google.protobuf import message_factory

    descriptor = message.FindMessageTypeByName("t.Top")
    child = {"b": bytearray(b"\0x"), "f": 1.5, "d": -2.0, "i64": -5, "u64": 2**64 - 1, "i32": 7, "u32": 2**32 - 1, "ok": True, "s": "é"}
    rows = [("x", child, "ONE", [child, {**child, "s": None}], ["ONE", "UNKNOWN"], [{"key": 3, "value": child}], 1), (None, None, None, [], [], None, 2)]
    fixed = lambda v: {k: fixed(x) for k, x in v.items()} if isinstance(v, dict) else [fixed(x) for x in v] if isinstance(v, list) else v
    whole = lambda c: None if c is None else {**c, "u64": Decimal(c["u64"])}
    data = [(n, whole(c), k, [whole(x) for x in kids], kinds, None if m is None else [{"key": Decimal(e["key"]), "value": whole(e["value"])} for e in m], extra) for n, c, k, kids, kinds, m, extra in rows]
    schema = T.StructType([*schemas.from_descriptor(descriptor).fields, T.StructField("extra", T.IntegerType())])
    for f in schema.fields:
        f.nullable = True
    cls = message_factory.GetMessageClass(descriptor)
    got = [cls.FromString(bytes(r.message)) for r in shapes.as_protobuf(spark.createDataFrame(data, schema), descriptor).collect()]
    made = fixed({**child, "b": bytes(child["b"])})
    want = cls(name="x", child=made, kind=1, kids=[made, {k: v for k, v in made.items() if k != "s"}], kinds=[1, 0], m={3: made})
    assert got == [want, cls()]


def test_files_as_one_object(spark, sf, tmp_path):
    from parqlane.operators import columns as C
    from parqlane.operators import predicates as P
    from parqlane.plans.files import ParquetFiles
    from parqlane.plans.scan import ReadSpec

    files = ParquetFiles(spark, f"{sf}/embeddings.parquet")
    assert files.column_type("embedding") == T.ArrayType(T.FloatType()) and files.column_type("nothing") is None
    assert files.column_index("embedding.list.element") == 1 and files.column_index("nothing") is None
    assert files.row_groups().agg(F.sum("group_rows")).first()[0] == files.scan().count()
    path = str(tmp_path / "parts")
    spark.range(0, 4000).select("id", F.array(F.col("id")).alias("a")).repartitionByRange(4, "id").write.parquet(path)
    parts = ParquetFiles(spark, path)
    spec = ReadSpec(P.equals("a", 1234), C.column("id"))
    assert [r.id for r in parts.scan_where_present("a.list.element", 1234, spec).collect()] == [1234]
    assert len(parts.scan_where_present("a.list.element", 1234, spec).inputFiles()) == 1
    assert parts.scan_where_present("a.list.element", 9999, spec).count() == 0
