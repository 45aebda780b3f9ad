from pyspark.sql import functions as F

from parqlane.llm import common


def test_smallest(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    rows = sorted(((r.h % 2**64) >> 1, r.id) for r in df.collect())
    for k in (0, 1, 40, 1000, 4999, 6000):
        assert [r.id for r in common.smallest(df, k, F.col("h"), "id").collect()] == [i for _, i in rows[:k]]
    same = df.withColumn("h", F.lit(7).cast("long"))
    assert [r.id for r in common.smallest(same, 3, F.col("h"), "id").collect()] == [0, 1, 2]


def test_scratch(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    kept = common.materialise(df, "t")
    assert kept.schema == df.schema and sorted(kept.collect()) == sorted(df.collect())
    assert kept._scratch.startswith(common.shared_dir(spark))
    common.discard(kept)
    fs, path = common.file_system(spark, kept._scratch)
    assert not fs.exists(path)
