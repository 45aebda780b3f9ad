import datetime as dt
import operator
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parqlane.operators import columns as C
from parqlane.operators import predicates as P
from parqlane.plans.scan import ReadSpec, scan
from parqlane.sources import sink

SCHEMA = """id int, a int, b int, child struct<x:int,s:string>, tags array<int>, reps array<struct<s:string,e:int,deep:array<int>>>,
m map<string,struct<v:int>>"""


def rows():
    out = [(0, None, None, None, None, None, None)]
    for i in range(1, 60):
        reps = [{"s": f"s{(i + k) % 4}", "e": (i * k) % 7, "deep": list(range(k))} for k in range(i % 4)]
        child = None if i % 5 == 0 else {"x": i % 9 if i % 7 else None, "s": f"t{i % 3}"}
        out.append((i, i % 4 or None, i % 6, child, [i % 5, i % 8] if i % 3 else [], reps, {f"k{i % 2}": {"v": i % 5}}))
    return out


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("nested") / "t.parquet")
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(where)
    return where


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def values(value, path):
    """All leaf values at a path of a row as nested dicts and lists."""
    if value is None:
        return []
    if isinstance(value, list):
        return [v for x in value for v in values(x, path)]
    if not path:
        return [value]
    return values(value.get(path[0]), path[1:])


def holds(tree, row):
    kind, *rest = tree
    if kind == "and":
        return all(holds(t, row) for t in rest)
    if kind == "or":
        return any(holds(t, row) for t in rest)
    compare, where, value = rest
    return any(compare(v, value) for v in values(row, where))


def built(tree):
    kind, *rest = tree
    if kind in ("and", "or"):
        return (P.intersection if kind == "and" else P.union)(*map(built, rest))
    compare, where, value = rest
    return P.Comparison(compare, where, value)


COMPARE = st.sampled_from([operator.eq, operator.gt, operator.ge, operator.lt, operator.le])
FLAT = st.one_of(
    st.tuples(st.just("is"), COMPARE, st.sampled_from([("a",), ("b",), ("child", "x")]), st.integers(0, 8)),
    st.tuples(st.just("is"), COMPARE, st.just(("child", "s")), st.sampled_from(["t0", "t1", "t2"])),
)
TREES = st.recursive(
    FLAT,
    lambda t: st.one_of(*(st.lists(t, min_size=1, max_size=3).map(lambda x, k=k: (k, *x)) for k in ("and", "or"))),
    max_leaves=6,
)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREES)
def test_boolean_algebra_over_different_columns(spark, path, tree):
    data = spark.read.parquet(path)
    plain = [r.asDict(recursive=True) for r in data.collect()]
    assert ids(data.where(built(tree).lower(data.schema))) == [r["id"] for r in plain if holds(tree, r)]


def test_repeated_paths(spark, path):
    df = spark.read.parquet(path)
    plain = [r.asDict(recursive=True) for r in df.collect()]

    def check(predicate, want):
        assert ids(df.where(predicate.lower(df.schema))) == [r["id"] for r in plain if want(r)]

    check(P.equals("tags", 4), lambda r: 4 in (r["tags"] or []))
    both = P.intersection(P.greater_than("tags", 2), P.less_than("tags", 4))
    check(both, lambda r: any(2 < x < 4 for x in r["tags"] or []))
    check(P.intersection(P.equals("a", 1), both), lambda r: r["a"] == 1 and any(2 < x < 4 for x in r["tags"] or []))
    check(P.greater_than("tags", 2) & P.equals("a", 1) & P.less_than("tags", 4), lambda r: r["a"] == 1 and any(2 < x < 4 for x in r["tags"] or []))
    check(P.greater_than("tags", 6) | P.less_than("tags", 1), lambda r: any(x > 6 or x < 1 for x in r["tags"] or []))
    apart = P.intersection(P.equals("reps.s", "s1"), P.equals("reps.e", 0))
    check(apart, lambda r: any(x["s"] == "s1" for x in r["reps"] or []) and any(x["e"] == 0 for x in r["reps"] or []))
    together = P.matching("reps", lambda e: (e["s"] == "s1") & (e["e"] == 0))
    check(together, lambda r: any(x["s"] == "s1" and x["e"] == 0 for x in r["reps"] or []))
    check(P.equals("reps.deep", 1), lambda r: any(1 in x["deep"] for x in r["reps"] or []))
    check(P.equals("m.value.v", 3), lambda r: any(x["v"] == 3 for x in (r["m"] or {}).values()))
    check(P.equals("m.key", "k1"), lambda r: "k1" in (r["m"] or {}))
    check(P.union(), lambda r: True)
    check(P.everything(), lambda r: True)


def test_user_conditions_anywhere(spark, path):
    """matching() below unions and intersections; on one path it looks at the same element as the rest."""
    df = spark.read.parquet(path)
    plain = [r.asDict(recursive=True) for r in df.collect()]

    def check(predicate, want):
        assert ids(df.where(predicate.lower(df.schema))) == [r["id"] for r in plain if want(r)]

    first, last = P.matching("reps", lambda e: e["s"] == "s1"), P.matching("reps", lambda e: e["e"] == 0)
    some = lambda r, f: any(f(x) for x in r["reps"] or [])
    check(P.union(P.intersection(first, P.equals("a", 1)), P.intersection(last, P.equals("b", 2))), lambda r: (some(r, lambda x: x["s"] == "s1") and r["a"] == 1) or (some(r, lambda x: x["e"] == 0) and r["b"] == 2))
    check(P.union(P.intersection(first), P.intersection(last)), lambda r: some(r, lambda x: x["s"] == "s1" or x["e"] == 0))
    check(P.intersection(P.union(first), P.union(last)), lambda r: some(r, lambda x: x["s"] == "s1" and x["e"] == 0))
    check(P.matching("tags", lambda x: x % 2 == 0) & P.greater_than("tags", 4), lambda r: any(x % 2 == 0 and x > 4 for x in r["tags"] or []))


LITERALS = [
    Decimal("1.005"), Decimal("-0.01"), Decimal("99.999"), Decimal("1E+6"), Decimal("-1E+6"), 1.005, -0.5, 0.1, 7, -7, 1000, 10**40, -(10**40), 2.5, Decimal("1.00"),
    float("inf"), float("-inf"),
]


@pytest.mark.parametrize("kind", ["decimal(4,2)", "decimal(38,6)", "tinyint", "bigint"])
def test_numbers_are_never_narrowed(spark, kind):
    values = [Decimal(v) for v in ("-99.99", "-1", "-0.01", "0", "0.1", "1", "1.01", "2", "3", "7", "99.99")]
    if "int" in kind:
        values = [v for v in values if v == int(v)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v decimal(38,6)").selectExpr(f"CAST(v AS {kind}) AS v").cache()
    every = [(value, compare) for value in LITERALS for compare in (operator.eq, operator.gt, operator.ge, operator.lt, operator.le)]
    told = df.select("v", *(P.Comparison(c, ("v",), v).lower(df.schema).alias(f"c{k}") for k, (v, c) in enumerate(every))).collect()
    for k, (value, compare) in enumerate(every):
        exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
        got = sorted(Decimal(r.v) for r in told if r[f"c{k}"])
        assert got == [v for v in values if compare(v, exact)], (value, compare)
    df.unpersist()


def test_decimals_reach_the_scan(spark, tmp_path):
    where = str(tmp_path / "d.parquet")
    spark.range(9).selectExpr("CAST(id AS decimal(10,2)) AS d").write.parquet(where)
    for value in (Decimal("1.005"), 1.005, 7):
        assert "PushedFilters: [IsNotNull(d), GreaterThan(d," in scan(spark, where, ReadSpec(P.greater_than("d", value)))._jdf.queryExecution().toString()


def test_dates_and_times(spark):
    days = [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    df = spark.createDataFrame([(d, dt.datetime(d.year, d.month, d.day)) for d in days], "d date, t timestamp_ntz")

    def got(predicate):
        return sorted(r.d.day for r in df.where(predicate.lower(df.schema)).collect())

    noon, midnight = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1)
    assert got(P.greater_than_or_equal("d", noon)) == [2] and got(P.greater_than("d", noon)) == [2]
    assert got(P.less_than("d", noon)) == got(P.less_than_or_equal("d", noon)) == [1, 31] and got(P.equals("d", noon)) == []
    assert got(P.equals("d", midnight)) == [1] and got(P.greater_than_or_equal("d", midnight)) == [1, 2] and got(P.less_than("d", midnight)) == [31]
    assert got(P.equals("d", "2024-01-01")) == [1] and got(P.equals("d", "2024-01-01 12:00:00")) == []
    assert got(P.equals("t", dt.date(2024, 1, 1))) == [1] and got(P.greater_than("t", noon)) == [2] and got(P.equals("t", midnight)) == [1]


def test_nan_is_a_value(spark, tmp_path):
    where = str(tmp_path / "n.parquet")
    spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id int, v double").write.parquet(where)
    nan = float("nan")
    for make, want in ((P.equals, [2]), (P.greater_than, []), (P.greater_than_or_equal, [2]), (P.less_than, [1]), (P.less_than_or_equal, [1, 2])):
        assert ids(scan(spark, where, ReadSpec(make("v", nan)))) == want


def test_own_column_specs_in_unions(spark, path):
    class Short(C.ColumnSpec):
        def __init__(self):
            super().__init__({})

        def includes_child(self, name):
            return len(name) == 1

        def for_child(self, name):
            return C.all_columns()

    df = spark.read.parquet(path)
    assert C.project(df, Short()).columns == ["a", "b", "m"]
    both = C.union(C.column("child.s"), Short(), C.column("id"))
    assert C.project(df, both).schema.simpleString() == "struct<id:int,a:int,b:int,child:struct<s:string>,m:map<string,struct<v:int>>>"
    assert scan(spark, path, ReadSpec(P.equals("child.x", 8), C.union(Short()))).columns == ["a", "b", "child", "m"]
    assert both.includes_path("child.s") and not both.includes_path("child.x") and both == C.union(C.column("child.s"), both.members[0].members[1], C.column("id"))


def test_mistakes_are_told(spark, path):
    schema = spark.read.parquet(path).schema
    with pytest.raises(ValueError):
        P.equals("a", None)
    for wrong in ("nothing", "child.nothing", "a.b"):
        with pytest.raises(LookupError):
            P.equals(wrong, 1).lower(schema)
    with pytest.raises(LookupError):
        P.equals("child", 1).lower(schema)


def test_null_struct_before_the_match(spark, path):
    got = scan(spark, path, ReadSpec(P.equals("child.x", 8), C.union(C.column("id"), C.column("child")))).collect()
    assert [r.id for r in got] == [8, 17, 26, 44, 53] and all(r.child.x == 8 and r.child.s for r in got)


def test_projection(spark, path):
    df = spark.read.parquet(path)
    whole = {r.id: r.asDict(recursive=True) for r in df.collect()}
    spec = C.union(C.column("id"), C.column("child", "s"), C.column("reps.e"), C.column("m", "value", "v"))
    pruned = "struct<id:int,child:struct<s:string>,reps:array<struct<e:int>>,m:map<string,struct<v:int>>>"
    for got in (scan(spark, path, ReadSpec(columns=spec)), C.project(df, spec)):
        assert got.schema.simpleString() == pruned
        for r in got.collect():
            w, r = whole[r.id], r.asDict(recursive=True)
            assert r["child"] == (None if w["child"] is None else {"s": w["child"]["s"]})
            assert r["reps"] == (None if w["reps"] is None else [{"e": x["e"]} for x in w["reps"]]) and r["m"] == w["m"]
    assert f"ReadSchema: {pruned}" in scan(spark, path, ReadSpec(columns=spec))._jdf.queryExecution().toString().replace("...", "")
    assert C.column("nothing") == C.column("nothing") and C.project(df, C.column("nothing")).columns == []
    assert C.project(df, C.no_columns()).count() == 60 and C.project(df, C.column()).schema == df.schema
    assert C.project(df, C.column("child")).schema["child"].dataType == df.schema["child"].dataType
    spec = ReadSpec(P.equals("child.x", 8), C.column("id"))
    assert scan(spark, path, spec).columns == ["id", "child"]
    assert scan(spark, path, ReadSpec(spec.predicate, spec.columns, False)).columns == ["id"]
    assert spec.predicate_includes("child.x") and not spec.predicate_includes("child.s") and spec.columns_include("id")


def test_row_groups(spark, tmp_path):
    from parqlane.sources.footer import chunks

    where = str(tmp_path / "many.parquet")
    sink.write(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1), where, row_group_bytes=1 << 20)
    groups = {r.row_group: (r.first_row, r.group_rows) for r in chunks(spark, where).collect()}
    assert len(groups) > 3
    first, n = groups[2]
    got = scan(spark, where, ReadSpec(columns=C.column("id")), [2]).agg(F.min("id"), F.max("id"), F.count("*")).first()
    assert tuple(got) == (first, first + n - 1, n)
    assert scan(spark, where, row_groups=list(groups)).count() == 200_000
    two = str(tmp_path / "two.parquet")
    sink.write(spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).repartition(2), two, row_group_bytes=1 << 20)
    places = {(r.file, r.first_row, r.group_rows) for r in chunks(spark, two).where("row_group = 0").collect()}
    assert scan(spark, two, row_groups=[0]).count() == sum(n for _, _, n in places)


def test_row_groups_of_files_with_unequal_numbers(spark, tmp_path):
    """A group that only some files have is read from these alone, whatever columns are called."""
    where = tmp_path / "unequal"
    where.mkdir()
    pq.write_table(pa.table({"file": range(1000), "row": range(1000)}), where / "a.parquet")
    pq.write_table(pa.table({"file": range(5000, 6000), "row": range(1000)}), where / "b.parquet", row_group_size=500)
    got = scan(spark, str(where), row_groups=[1])
    assert got.columns == ["file", "row"] and sorted(r.file for r in got.collect()) == list(range(5500, 6000))
    assert scan(spark, str(where), row_groups=[0]).count() == 1500 and scan(spark, str(where), row_groups=[7]).count() == 0


def _numbered(where, sizes):
    """A file of row groups of these numbers of rows, in which a row has its group's place."""
    schema = pa.schema([("id", pa.int64()), ("g", pa.int64())])
    with pq.ParquetWriter(where, schema) as out:
        for k, n in enumerate(sizes):
            out.write_table(pa.table({"id": range(n), "g": [k] * n}, schema=schema), row_group_size=max(n, 1))


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_meet_row_groups_in_blocks(spark, tmp_path, monkeypatch, broadcast):
    """Rows are dealt by file and block of rows, so none meets all groups of its file, though groups are unequal."""
    from parqlane.plans import scan as S

    if not broadcast:
        monkeypatch.setattr(S, "BROADCAST_RUNS", 0)
    where = tmp_path / "groups"
    where.mkdir()
    sizes = {"a": [1] * 150 + [5000] + [3] * 150, "b": [700, 0, 1, 2, 900, 1], "c": [10]}
    for name, n in sizes.items():
        _numbered(where / f"{name}.parquet", n)
    for wanted in (range(0, 400, 2), [1, 2, 4], range(1, 301), [150], [0, 299]):
        got = scan(spark, str(where), row_groups=wanted)
        rows = got.groupBy("g").count().collect()
        want = {k: sum(n[k] for n in sizes.values() if k < len(n)) for k in wanted}
        assert {r.g: r["count"] for r in rows} == {k: n for k, n in want.items() if n}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin [file#" in plan) == broadcast
        join = next(line for line in plan.splitlines() if "Join [" in line)
        assert "part#" in join and "group_part#" in join


def test_very_many_row_groups_of_one_file(spark, tmp_path):
    """As a filter, each run of rows would be a condition."""
    where = str(tmp_path / "many.parquet")
    _numbered(where, [2] * 3000)
    got = scan(spark, where, row_groups=range(0, 3000, 2)).agg(F.count("*"), F.count_distinct("g"), F.max(F.col("g") % 2)).first()
    assert tuple(got) == (3000, 1500, 0)
    filtered = scan(spark, where, row_groups=range(1, 3000))  # neighbours are one run
    assert filtered.count() == 5998 and "Join" not in filtered._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, path):
    from parqlane.streaming.scan import stream

    spec = ReadSpec(P.greater_than("tags", 5), C.column("id"))
    frame = stream(spark, path, spark.read.parquet(path).schema, spec)
    q = frame.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert ids(spark.table("streamed")) == ids(scan(spark, path, spec))
