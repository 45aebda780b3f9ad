"""What the operators share: scratch tables in the cluster's shared folder and text patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parqlane.plans.scan import unused  # noqa: F401
from parqlane.sources.stores import discard, discard_since, file_system, hadoop_path, mark, materialise, scratch_path, shared_dir  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash seed of every seeded choice unless the caller gives another.
SEED = 42
#: Rows that Python holds as objects at once.
ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def smallest(df: DataFrame, k: int, hashed, *ties) -> DataFrame:
    """The k rows of df with the smallest hash (a long, of which 63 bits count), ties by columns.

    Of a large df only rows below about twice the expected bound are ordered, so the one task that
    merges the parts' lists gets some 2k rows, however many parts there are.
    """
    from pyspark.sql import functions as F

    place, n = F.shiftrightunsigned(hashed, 1), df.count()
    if n > 4 * k:
        below = df.where(place < F.lit((2 * k << 63) // n))
        df = below if below.count() >= k else df
    return df.orderBy(place, *ties).limit(k)


def map_columns(df: DataFrame, inputs, make, fields, keep=None) -> DataFrame:
    """df's ``keep`` columns (default: all) and new ``fields`` that Python derives batch by batch.

    make() is called once per task and gives a function from lists of the input columns' values
    to as many lists as there are fields. Kept columns named like a new field are left out.
    fields: (name, Spark type) pairs. Tasks stream Arrow batches; nothing is gathered.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {n for n, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    given = df.select(
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
        *(F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)),
    )
    kept, n = given.schema.fields[: len(keep)], len(keep)
    kinds = [T._parse_datatype_string(t) if isinstance(t, str) else t for _, t in fields]
    schema = T.StructType([*kept, *(T.StructField(f"n{i}", t) for i, t in enumerate(kinds))])

    def run(batches):
        work, arrow = make(), None
        for batch in batches:
            if arrow is None:
                arrow = to_arrow_schema(T.StructType(schema.fields[n:]))
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                lists = work(*(part.column(n + i).to_pylist() for i in range(len(inputs))))
                made = [pa.array(x, type=f.type) for x, f in zip(lists, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=schema.names)

    out = given.mapInArrow(run, schema)
    names = [*keep, *(n for n, _ in fields)]
    return out.select(*(F.col(f.name).alias(name) for f, name in zip(schema.fields, names, strict=True)))
