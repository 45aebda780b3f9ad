"""Might a value be present in a column chunk? Asked of metadata, filters and dictionaries alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parqlane.functions.types import read_type
from parqlane.sources.footer import leaves, over_files, read_footer, row_groups, some_footer

_SCHEMA = "file string, row_group int, might_contain boolean, decided_by string"


def might_contain(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """file, row_group, might_contain, decided_by for every row group of the files below ``path``.

    Statistics, then the bloom filter, then a dictionary that holds every value decide; false is
    certain, true may be wrong. Missing statistics rule nothing out. Each task reads the footers, and
    at most one filter and one dictionary page a row group, of its files. A column that a file lacks
    gives no row for it.
    """
    if value is None:
        raise ValueError("null is not a value to look for")

    def ask(uri, source):
        for k, (_, _, own) in enumerate(row_groups(read_footer(source))):
            for c in own:
                if ".".join(c.leaf.path) == column:
                    yield uri, k, *c.might_contain(value, source)

    return over_files(spark, [path], ask, _SCHEMA)


def dictionary_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """file, row_group, complete, value: the dictionary page of a column in each row group.

    complete: whether every value of the row group is in it. Row groups without a dictionary page
    give no rows.
    """
    kind = next((read_type(x) for x in leaves(some_footer(spark, path)) if ".".join(x.path) == column), None)
    if kind is None:
        raise LookupError(f"no column {column}")

    def read(uri, source):
        for k, (_, _, own) in enumerate(row_groups(read_footer(source))):
            for c in own:
                if ".".join(c.leaf.path) == column and c.has_dictionary:
                    values = c.dictionary(source)
                    if values is None:
                        raise ValueError(f"{uri}: a dictionary page whose codec can't be undone")
                    for v in values:
                        yield uri, k, c.dictionary_complete, v

    return over_files(spark, [path], read, f"file string, row_group int, complete boolean, value {kind.simpleString()}")


def range_may_hold(low: Column, high: Column, value: Column) -> Column:
    """The same test by statistics alone, as a Column over any bounds; missing bounds say true."""
    return low.isNull() | high.isNull() | ((low <= value) & (value <= high))


def contains_non_nulls(null_count: Column, num_values: Column) -> Column:
    return F.coalesce(null_count < num_values, F.lit(True))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values a complete dictionary of the column would hold: one row each, without null."""
    return df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
