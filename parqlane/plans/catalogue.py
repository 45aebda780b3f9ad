"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqlane.functions import shapes, types
from parqlane.operators import columns as C
from parqlane.operators import predicates as P
from parqlane.operators import presence
from parqlane.plans.files import ParquetFiles
from parqlane.plans.scan import ReadSpec, scan
from parqlane.sources import footer, ranges, schemas, sink
from parqlane.sources.stores import file_system, scratch_path
from parqlane.streaming import scan as streaming

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query (spark, sf_dir) under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, table, predicate=None, columns=None, **options):
    spec = ReadSpec(predicate or P.everything(), columns or C.all_columns(), **options)
    return scan(spark, f"{sf_dir}/{table}.parquet", spec)


def cols(*names):
    return C.union(*(C.column(n) for n in names))


for _table in TABLES:
    QUERIES[f"scan_{_table}"] = lambda spark, sf_dir, table=_table: read(spark, sf_dir, table)
    ORACLE_SQL[f"scan_{_table}"] = f"SELECT * FROM {_table}"


# Predicates


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return read(spark, sf_dir, "orders", P.equals("o_orderstatus", "F"))


@query("SELECT * FROM lineitem WHERE l_quantity > 30")
def filter_gt(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.greater_than("l_quantity", 30))


@query("SELECT * FROM lineitem WHERE l_quantity >= 30")
def filter_ge(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.greater_than_or_equal("l_quantity", 30))


@query("SELECT * FROM lineitem WHERE l_quantity < 5")
def filter_lt(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.less_than("l_quantity", 5))


@query("SELECT * FROM lineitem WHERE l_quantity <= 5")
def filter_le(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.less_than_or_equal("l_quantity", 5))


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW'")
def filter_union_same_col(spark, sf_dir):
    return read(spark, sf_dir, "orders", P.union(*(P.equals("o_orderpriority", v) for v in ("1-URGENT", "5-LOW"))))


@query("SELECT * FROM lineitem WHERE l_quantity < 5 OR l_discount > 0.08")
def filter_union_diff_col(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.less_than("l_quantity", 5) | P.greater_than("l_discount", 0.08))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity >= 20 AND l_quantity < 30"
)
def filter_intersection(spark, sf_dir):
    where = P.intersection(
        P.greater_than_or_equal("l_shipdate", dt.datetime(1995, 1, 1)),
        P.greater_than_or_equal("l_quantity", 20),
        P.less_than("l_quantity", 30),
    )
    return read(spark, sf_dir, "lineitem", where, cols("l_orderkey", "l_linenumber"))


@query("SELECT * FROM lineitem WHERE l_quantity < 5 OR (l_discount > 0.05 AND l_tax < 0.03)")
def filter_or_of_and(spark, sf_dir):
    where = P.less_than("l_quantity", 5) | (P.greater_than("l_discount", 0.05) & P.less_than("l_tax", 0.03))
    return read(spark, sf_dir, "lineitem", where)


@query("SELECT * FROM lineitem WHERE (l_quantity < 5 OR l_discount > 0.05) AND l_tax < 0.03")
def filter_and_of_or(spark, sf_dir):
    where = (P.less_than("l_quantity", 5) | P.greater_than("l_discount", 0.05)) & P.less_than("l_tax", 0.03)
    return read(spark, sf_dir, "lineitem", where)


@query("SELECT * FROM customer WHERE c_name > 'Customer#000000100'")
def filter_string_order(spark, sf_dir):
    return read(spark, sf_dir, "customer", P.greater_than("c_name", "Customer#000000100"))


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-05 06:07:08.123456'")
def filter_ts_micros(spark, sf_dir):
    return read(spark, sf_dir, "events", P.greater_than("ts", dt.datetime(2024, 1, 5, 6, 7, 8, 123456)))


@query("SELECT * FROM region")
def filter_nothing_asked(spark, sf_dir):
    return read(spark, sf_dir, "region", P.union())


@query("SELECT vec_id, embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0")
def exists_embedding_gt(spark, sf_dir):
    return read(spark, sf_dir, "embeddings", P.greater_than("embedding", 0.3), cols("vec_id"))


@query("SELECT vec_id, embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.301)) > 0")
def exists_embedding_between(spark, sf_dir):
    where = P.intersection(P.greater_than("embedding", 0.3), P.less_than("embedding", 0.301))
    return read(spark, sf_dir, "embeddings", where, cols("vec_id"))


@query("SELECT * FROM documents WHERE lang LIKE 'd%' AND n_chars > 500")
def filter_custom(spark, sf_dir):
    return read(spark, sf_dir, "documents", P.matching("lang", lambda c: c.like("d%")) & P.greater_than("n_chars", 500))


def _orders_with_lines(spark, sf_dir):
    """Orders with their lines as a list of groups; as many orders as the table has, none cut."""
    line = F.struct(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.struct(F.col("l_tax").alias("t")).alias("more"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
    return lines.agg(F.collect_list(line).alias("lines"))  # an order has a handful of lines


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > 45 AND bool_or(l_tax = 0)")
def exists_in_repeated_group(spark, sf_dir):
    """Each condition looks for a line of its own."""
    where = P.greater_than("lines.q", 45) & P.equals("lines.more.t", 0.0)
    return ReadSpec(where, C.column("l_orderkey"), keep_predicate_columns=False).apply(_orders_with_lines(spark, sf_dir))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_tax = 0")
def exists_same_element(spark, sf_dir):
    """One line that fulfils both conditions."""
    where = P.matching("lines", lambda e: (e["q"] > 45) & (e["more"]["t"] == 0))
    return ReadSpec(where, C.column("l_orderkey"), keep_predicate_columns=False).apply(_orders_with_lines(spark, sf_dir))


# Projection


@query("SELECT p_name FROM part")
def project_one(spark, sf_dir):
    return read(spark, sf_dir, "part", columns=C.column("p_name"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def project_union(spark, sf_dir):
    return read(spark, sf_dir, "part", columns=C.union(C.column("p_size"), C.column("p_partkey"), C.column("p_brand")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def project_keeps_predicate_cols(spark, sf_dir):
    return read(spark, sf_dir, "customer", P.greater_than("c_acctbal", 5000), C.column("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def project_drops_predicate_cols(spark, sf_dir):
    return read(spark, sf_dir, "customer", P.greater_than("c_acctbal", 5000), C.column("c_custkey"), keep_predicate_columns=False)


@query(
    "SELECT o_orderkey, struct_pack(status := o_orderstatus, inner_ := struct_pack(price := o_totalprice)) AS o FROM orders "
    "WHERE o_totalprice > 100000"
)
def project_nested(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    inner = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    made = orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("date"), inner.alias("inner_")).alias("o"))
    spec = ReadSpec(P.greater_than("o.inner_.price", 100000), C.union(C.column("o_orderkey"), C.column("o.status")))
    return spec.apply(made)


@query("SELECT l_orderkey, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def project_in_repeated_group(spark, sf_dir):
    pruned = C.project(_orders_with_lines(spark, sf_dir), C.union(C.column("l_orderkey"), C.column("lines", "q")))
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["q"])
    return pruned.select("l_orderkey", total.alias("total"), F.size("lines").cast("long").alias("n"))


@query("SELECT count(*) AS n FROM orders")
def project_nothing(spark, sf_dir):
    return read(spark, sf_dir, "orders", columns=C.no_columns()).agg(F.count("*").alias("n"))


# Metadata


@query("SELECT column_name AS path, (row_number() OVER () - 1)::INTEGER AS column_index FROM (DESCRIBE lineitem)")
def column_index_by_path(spark, sf_dir):
    return ParquetFiles(spark, f"{sf_dir}/lineitem.parquet").chunks().select("path", "column_index").distinct()


#: Bytes of a table that one task may write again; rows a file has at most, so that its footer stays small however small row groups are.
TASK_BYTES, FILE_ROWS = 1 << 25, 1 << 20


def _in_files(spark, sf_dir, table, files=1):
    """The table in so many partitions; in those of its scan, where they would be larger than TASK_BYTES."""
    path = f"{sf_dir}/{table}.parquet"
    system, there = file_system(spark, path)
    df = spark.read.parquet(path)
    return df if system.getContentSummary(there).getLength() > files * TASK_BYTES else df.coalesce(files)


def _written(spark, sf_dir, table, change=lambda df: df, files=1, **options):
    """The table, changed, written again below the shared folder as so many files, or more if it is large; their path."""
    path = scratch_path(spark, table)
    sink.write(change(_in_files(spark, sf_dir, table, files)), path, **options)
    return path


def _two_unequal_files(spark, sf_dir):
    """Orders as two files, of one row group and of several; as more files of both kinds, where orders are many."""
    path = scratch_path(spark, "orders")
    orders = _in_files(spark, sf_dir, "orders")
    sink.write(orders.where("o_orderkey % 10 = 0"), path, file_rows=FILE_ROWS)
    sink.write(orders.where("o_orderkey % 10 != 0"), path, row_group_bytes=1 << 14, mode="append", file_rows=FILE_ROWS)
    return path


@query("SELECT count(*) AS group_rows, true AS several FROM orders")
def row_groups(spark, sf_dir):
    groups = ParquetFiles(spark, _two_unequal_files(spark, sf_dir)).row_groups()
    return groups.agg(F.sum("group_rows").alias("group_rows"), (F.max("row_group") > 1).alias("several"))


def _with_nulls(df):
    return df.select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("some"), F.lit(None).cast("int").alias("none"))


@query("SELECT 'some' AS path, count(CASE WHEN value > 10 THEN 1 END) > 0 AS holds_values FROM events UNION ALL SELECT 'none', false")
def contains_non_nulls(spark, sf_dir):
    found = footer.chunks(spark, _written(spark, sf_dir, "events", _with_nulls)).where("path != 'event_id'")
    holds = presence.contains_non_nulls(F.col("null_count"), F.col("num_values"))
    return found.groupBy("path").agg(F.max(holds).alias("holds_values"))


@query("SELECT * FROM nation WHERE n_name = 'NATION_3'")
def scan_where_present(spark, sf_dir):
    files = ParquetFiles(spark, f"{sf_dir}/nation.parquet")
    return files.scan_where_present("n_name", "NATION_3", ReadSpec(P.equals("n_name", "NATION_3")))


@query("SELECT c_custkey, [c_custkey, c_custkey + 1] AS pair FROM customer WHERE c_custkey = 40 OR c_custkey + 1 = 40")
def scan_where_element_present(spark, sf_dir):
    """Of several files, those whose list elements may hold the value are read."""
    path = scratch_path(spark, "pairs")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array("c_custkey", F.col("c_custkey") + 1).alias("pair"))
    sink.write(customers.repartitionByRange(4, "c_custkey"), path)
    return ParquetFiles(spark, path).scan_where_present("pair.list.element", 40, ReadSpec(P.equals("pair", 40)))


@query("SELECT column_name AS path, (row_number() OVER () - 1)::INTEGER AS column_index, (SELECT count(*) FROM lineitem) AS num_values, 0::BIGINT AS null_count FROM (DESCRIBE lineitem)")
def footer_chunks(spark, sf_dir):
    found = footer.chunks(spark, f"{sf_dir}/lineitem.parquet").groupBy("path", "column_index")
    return found.agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"))


@query("SELECT 'l_quantity' AS path, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_orderkey', min(l_orderkey)::DOUBLE, max(l_orderkey)::DOUBLE FROM lineitem")
def chunk_min_max(spark, sf_dir):
    found = footer.chunks(spark, f"{sf_dir}/lineitem.parquet").where(F.col("path").isin("l_quantity", "l_orderkey"))
    return found.groupBy("path").agg(F.min(F.col("min").cast("double")).alias("low"), F.max(F.col("max").cast("double")).alias("high"))


@query(
    "SELECT 'some' AS path, count(*) AS num_values, count(*) - count(CASE WHEN value > 10 THEN 1 END) AS null_count FROM events "
    "UNION ALL SELECT 'none', count(*), count(*) FROM events"
)
def null_counts(spark, sf_dir):
    found = footer.chunks(spark, _written(spark, sf_dir, "events", _with_nulls)).where("path != 'event_id'")
    return found.groupBy("path").agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"))


@query("SELECT count(*) AS n, max(CASE WHEN c_custkey = 17 THEN 1 ELSE 0 END) = 1 AS present FROM customer")
def might_contain_present(spark, sf_dir):
    asked = presence.might_contain(spark, f"{sf_dir}/customer.parquet", "c_custkey", 17)
    n = footer.chunks(spark, f"{sf_dir}/customer.parquet").where("column_index = 0").agg(F.sum("group_rows").alias("n"))
    return n.crossJoin(asked.agg(F.max("might_contain").alias("present")))  # two single rows


#: Rows of a file with a bloom filter: of many more, a filter of Parquet's largest size (1 MB) would let most values through.
BLOOM_ROWS = 1 << 17


def _even_keys(df):
    return df.select((F.col("c_custkey") * 2).alias("key"), "c_name")


@query("SELECT max(CASE WHEN c_custkey * 2 = 55 THEN 1 ELSE 0 END) = 1 AS present, 'bloom' AS decided_by FROM customer")
def might_contain_absent_in_bloom(spark, sf_dir):
    """A value between the least and the greatest, refused by the bloom filter alone."""
    path = _written(spark, sf_dir, "customer", _even_keys, dictionary=False, bloom=["key"], file_rows=BLOOM_ROWS)
    asked = presence.might_contain(spark, path, "key", 55).where("might_contain OR decided_by != 'statistics'")
    return asked.groupBy("decided_by").agg(F.max("might_contain").alias("present"))


@query("SELECT count(*) AS n FROM customer")
def bloom_holds_all(spark, sf_dir):
    """Every value that was written is in the file's filter, as loaded and probed by this library."""
    path = _written(spark, sf_dir, "customer", _even_keys, dictionary=False, bloom=["c_name"], file_rows=BLOOM_ROWS)
    openers = dict(ranges.OPENERS)

    def probe(batches):
        import pyarrow as pa

        uri, filters = None, []
        for batch in batches:
            held = []
            for name, file in zip(*(c.to_pylist() for c in batch.columns)):
                if file != uri:
                    uri, source = file, ranges.open_ranges(file, openers)
                    filters = [own[1].bloom(source) for _, _, own in footer.row_groups(footer.read_footer(source))]
                held.append(any(bits.might_contain(hashed(name.encode())) for bits, hashed in filters))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_())], names=["held"])

    names = spark.read.parquet(path).select("c_name", footer.whole_uri(F.col("_metadata.file_path")).alias("file"))
    return names.mapInArrow(probe, "held boolean").where("held").agg(F.count("*").alias("n"))


@query("SELECT max(CASE WHEN o_orderpriority = '3-NONE' THEN 1 ELSE 0 END) = 1 AS present FROM orders")
def might_contain_absent_in_dictionary(spark, sf_dir):
    asked = presence.might_contain(spark, f"{sf_dir}/orders.parquet", "o_orderpriority", "3-NONE")
    return asked.agg(F.max("might_contain").alias("present"))


@query("SELECT max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) = 1 AS present FROM orders")
def might_contain_present_as_bytes(spark, sf_dir):
    """Bytes asked of a text column are taken as its UTF-8."""
    asked = presence.might_contain(spark, f"{sf_dir}/orders.parquet", "o_orderpriority", b"5-LOW")
    return asked.where("decided_by = 'dictionary'").agg(F.max("might_contain").alias("present"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def dictionary_values(spark, sf_dir):
    return presence.distinct_values(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment")


@query("SELECT DISTINCT o_orderpriority AS value, true AS complete FROM orders")
def dictionary_pages(spark, sf_dir):
    """The same from the dictionary pages of the row groups."""
    pages = ParquetFiles(spark, _two_unequal_files(spark, sf_dir)).dictionary_values("o_orderpriority")
    return pages.groupBy("value").agg(F.min("complete").alias("complete"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def row_group_scope(spark, sf_dir):
    """First, second and further row groups of files that have different numbers of them are the table."""
    path = _two_unequal_files(spark, sf_dir)
    last = footer.chunks(spark, path).agg(F.max("row_group")).first()[0]
    spec = ReadSpec(columns=cols("o_orderkey", "o_totalprice"))
    parts = [scan(spark, path, spec, groups) for groups in ([0], [1], range(2, last + 1))]
    return reduce(DataFrame.unionByName, parts)


# Literals of another kind than the column


def _priced(df):
    return df.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) > 1005.005 AND CAST(o_totalprice AS DECIMAL(12,2)) <= 200000.019")
def filter_decimal_finer(spark, sf_dir):
    """Bounds with more digits than the column has."""
    where = P.greater_than("price", Decimal("1005.005")) & P.less_than_or_equal("price", 200000.019)
    return scan(spark, _written(spark, sf_dir, "orders", _priced), ReadSpec(where, C.column("o_orderkey"), keep_predicate_columns=False))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= TIMESTAMP '1995-01-01 12:00:00'")
def filter_date_by_time(spark, sf_dir):
    where = P.greater_than_or_equal("day", dt.datetime(1995, 1, 1, 12)) & P.less_than("price", 10**15)
    return scan(spark, _written(spark, sf_dir, "orders", _priced), ReadSpec(where, C.column("o_orderkey"), keep_predicate_columns=False))


@query("SELECT * FROM lineitem WHERE l_linenumber > 2.5")
def filter_int_by_fraction(spark, sf_dir):
    return read(spark, sf_dir, "lineitem", P.greater_than("l_linenumber", 2.5))


@query("SELECT c_custkey, CAST(c_custkey AS DECIMAL(25,3)) AS wide FROM customer WHERE c_custkey < 100")
def filter_fixed_length_decimal(spark, sf_dir):
    """Decimals of more than 18 digits are stored as bytes of a fixed length."""
    path = _written(spark, sf_dir, "customer", lambda df: df.select("c_custkey", F.col("c_custkey").cast("decimal(25,3)").alias("wide")))
    return scan(spark, path, ReadSpec(P.less_than("wide", 100), C.column("c_custkey")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def filter_boolean(spark, sf_dir):
    path = _written(spark, sf_dir, "lineitem", lambda df: df.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("r")), version=2)
    return scan(spark, path, ReadSpec(P.equals("r", True), cols("l_orderkey", "l_linenumber"), keep_predicate_columns=False))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 45 AND l_tax = 0) OR (bool_or(l_quantity < 2) AND count(*) > 1)")
def filter_custom_nested(spark, sf_dir):
    """User conditions on groups inside unions and intersections, on a list of groups read from a file."""
    path = scratch_path(spark, "lines")
    sink.write(_orders_with_lines(spark, sf_dir).withColumn("n", F.size("lines")), path)
    good = P.matching("lines", lambda e: (e["q"] > 45) & (e["more"]["t"] == 0))
    few = P.intersection(P.matching("lines", lambda e: e["q"] < 2), P.greater_than("n", 1))
    return scan(spark, path, ReadSpec(P.union(P.intersection(good), few), C.column("l_orderkey"), keep_predicate_columns=False))


# Nested files


@query("SELECT l_orderkey, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_tax > 0.07)")
def nested_file(spark, sf_dir):
    """Lists of groups assembled from a file, pruned to one leaf besides the predicate's."""
    path = scratch_path(spark, "lines")
    sink.write(_orders_with_lines(spark, sf_dir), path)
    found = scan(spark, path, ReadSpec(P.greater_than("lines.more.t", 0.07), cols("l_orderkey", "lines.q")))
    return found.select("l_orderkey", F.array_max("lines.q").alias("most"), F.size("lines").cast("long").alias("n"))


class _Starting(C.ColumnSpec):
    """A user's own column spec: the top-level fields whose names start so."""

    def __init__(self, start):
        super().__init__({})
        self.start = start

    def includes_child(self, name):
        return name.startswith(self.start)

    def for_child(self, name):
        return C.all_columns()


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")
def project_by_own_spec(spark, sf_dir):
    return read(spark, sf_dir, "part", P.greater_than("p_size", 25), C.union(_Starting("p_na"), C.column("p_partkey")))


# Codecs, page versions and encodings


def _round_trip(name, **options):
    def again(spark, sf_dir):
        return scan(spark, _written(spark, sf_dir, "part", **options))

    QUERIES[name], ORACLE_SQL[name] = again, "SELECT * FROM part"


_round_trip("codec_none", codec="UNCOMPRESSED")
_round_trip("codec_snappy_v2", codec="SNAPPY", version=2)
_round_trip("codec_gzip_v2_no_dictionary", codec="GZIP", version=2, dictionary=False)
_round_trip("codec_lz4_no_dictionary", codec="LZ4", dictionary=False)
_round_trip("codec_zstd_several_files", codec="ZSTD", files=3)


@query("SELECT * FROM region WHERE r_regionkey < 0")
def empty_file(spark, sf_dir):
    path = scratch_path(spark, "empty")
    sink.write_empty(spark, spark.read.parquet(f"{sf_dir}/region.parquet").schema, path)
    return scan(spark, path)


@query("SELECT * FROM orders WHERE o_totalprice > 100000")
def stream_of_files(spark, sf_dir):
    """The same read request over a stream of files, until all that are there are read."""
    source, out = _written(spark, sf_dir, "orders", files=2), scratch_path(spark, "streamed")
    frame = streaming.stream(spark, source, spark.read.parquet(source).schema, ReadSpec(P.greater_than("o_totalprice", 100000)))
    sunk = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    sunk.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


# Shapes


@query("SELECT to_json({'n_name': n_name, 'n_nationkey': n_nationkey}) AS json FROM nation")
def as_json(spark, sf_dir):
    nation = read(spark, sf_dir, "nation", columns=cols("n_nationkey", "n_name"))
    return shapes.as_json(nation.select("n_name", "n_nationkey"))


@query("SELECT r_regionkey, upper(r_name) AS name FROM region")
def custom_shape(spark, sf_dir):
    kind = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("name", T.StringType())])
    return shapes.shaped(read(spark, sf_dir, "region"), lambda row: {"r_regionkey": row["r_regionkey"], "name": row["r_name"].upper()}, kind)


@query("SELECT r_regionkey, r_name FROM region")
def as_maps(spark, sf_dir):
    """Rows as maps on the driver, as an application would take them one by one."""
    regions = read(spark, sf_dir, "region")
    return spark.createDataFrame(list(shapes.as_maps(regions)), regions.schema)


@query("SELECT count(*) AS n FROM lineitem")
def drained(spark, sf_dir):
    return spark.createDataFrame([(shapes.drained(read(spark, sf_dir, "lineitem")),)], "n long")


def _order_message():
    """A message type as an application might define it; needs google.protobuf."""
    from google.protobuf import descriptor_pb2, descriptor_pool

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="order.proto", package="shop", syntax="proto3")
    file.enum_type.add(name="Status").value.extend(descriptor_pb2.EnumValueDescriptorProto(name=n, number=k) for k, n in enumerate("NFOP"))
    line, order = file.message_type.add(name="Line"), file.message_type.add(name="Order")
    line.field.add(name="q", number=1, type=kinds.TYPE_DOUBLE, label=kinds.LABEL_OPTIONAL)
    order.field.add(name="key", number=1, type=kinds.TYPE_INT64, label=kinds.LABEL_OPTIONAL)
    order.field.add(name="status", number=2, type=kinds.TYPE_ENUM, type_name=".shop.Status", label=kinds.LABEL_OPTIONAL)
    order.field.add(name="first", number=3, type=kinds.TYPE_MESSAGE, type_name=".shop.Line", label=kinds.LABEL_OPTIONAL)
    order.field.add(name="lines", number=4, type=kinds.TYPE_MESSAGE, type_name=".shop.Line", label=kinds.LABEL_REPEATED)
    order.field.add(name="keys", number=5, type=kinds.TYPE_INT64, label=kinds.LABEL_REPEATED)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return pool.FindMessageTypeByName("shop.Order")


@query(
    "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS first, 2 * o_totalprice AS total, [o_orderkey, o_custkey] AS keys FROM orders"
)
def as_protobuf(spark, sf_dir):
    """Orders as messages, with enums by name, a message and lists inside; parsed again for the result."""
    descriptor = _order_message()
    line = F.struct(F.col("o_totalprice").alias("q"))
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), line.alias("first"), F.array(line, line).alias("lines"),
        F.array("o_orderkey", "o_custkey").alias("keys"), F.lit("not in the message").alias("other"),
    )
    packed, full_name = shapes.packed_descriptor(descriptor)

    def parse(batches):
        import pyarrow as pa

        message = shapes.message_class(packed, full_name)
        for batch in batches:
            got = [message.FromString(m) for m in batch.column(0).to_pylist()]
            columns = [
                [m.key for m in got], ["NFOP"[m.status] for m in got], [m.first.q for m in got], [sum(x.q for x in m.lines) for m in got],
                [list(m.keys) for m in got],
            ]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "status", "first", "total", "keys"])

    return shapes.as_protobuf(orders, descriptor).mapInArrow(parse, "key long, status string, first double, total double, keys array<long>")


@query(
    "SELECT * FROM (VALUES ('key', 'bigint'), ('status', 'string'), ('first', 'struct<q:double>'), ('lines', 'array<struct<q:double>>'), "
    "('keys', 'array<bigint>')) AS t(name, type)"
)
def schema_of_descriptor(spark, sf_dir):
    fields = schemas.from_descriptor(_order_message()).fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, type string")


@query("SELECT * FROM (VALUES ('l_orderkey', 'bigint'), ('l_quantity', 'double'), ('l_returnflag', 'string'), ('l_shipdate', 'timestamp_ntz')) AS t(path, type)")
def column_types(spark, sf_dir):
    files = ParquetFiles(spark, f"{sf_dir}/lineitem.parquet")
    asked = ("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    return spark.createDataFrame([(p, files.column_type(p).simpleString()) for p in asked], "path string, type string")


@query("SELECT * FROM orders")
def read_any_type(spark, sf_dir):
    """With the schema made from the footer, of a folder of files, lists and groups included."""
    line = F.struct(*(F.col(c) for c in ("o_totalprice", "o_orderdate", "o_orderpriority")))
    path = _written(spark, sf_dir, "orders", lambda df: df.select("o_orderkey", "o_custkey", "o_orderstatus", F.array(line).alias("more")), files=2)
    return types.read_any(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", F.inline("more"))
