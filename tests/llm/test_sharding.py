import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parqlane.llm import sharding
from parqlane.llm.common import scratch_path

SCHEMA = "doc_id long, text string, shard_id string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40_000), max_size=60), st.booleans())
def test_runs(sizes, final):
    shards = [sharding.Shard(f"s{k:03d}", 1, n) for k, n in enumerate(sizes)]
    options = dict(target=10_000, fanout=4, least=100)
    got = sharding.runs(shards, final=final, **options)
    taken = [s for r in got for s in r]
    assert len(taken) == len(set(taken)) and all(s.bytes < 10_000 for s in taken)
    for r in got:
        assert len(r) > 1 and sum(s.bytes for s in r) <= 11_000
        assert final or len({sharding.tier(s.bytes, 4, 100) for s in r}) == 1


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_appends_compaction_and_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    versions = store.append_all(docs.withColumn("a", F.pmod("doc_id", F.lit(5))), "a")
    assert [m.version for m in versions] == [1, 2, 3, 4, 5] and rows_of(store.read()) == rows_of(docs)
    assert rows_of(store.read(2)) == rows_of(docs.where("doc_id % 5 < 2"))
    small = len(store.manifest().shards)
    assert small >= 25 and sum(s.rows for s in store.manifest().shards) == docs.count()
    options = dict(target=100_000, fanout=4, least=1000)
    done = store.compact(**options)
    assert len(done.shards) < small and rows_of(store.read()) == rows_of(docs)
    assert not sharding.runs(done.shards, **options) and max(s.bytes for s in done.shards) < 200_000
    assert store.compact(**options).version == done.version  # nothing is left to merge
    assert rows_of(store.read(5)) == rows_of(docs)  # the older version is still there
    marked = store.read_with_shards().groupBy("shard_id", "shard_rows").count().collect()
    assert {r.shard_id: (r.shard_rows, r["count"]) for r in marked} == {k: (s.rows, s.rows) for k, s in enumerate(done.shards)}
    assert store.vacuum(keep=99) == 0  # all files are young
    assert store.vacuum(older_than_s=0) > 0 and rows_of(store.read()) == rows_of(docs) and store.versions() == [done.version]


def test_the_second_of_two_writers_starts_again(spark):
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    one = spark.createDataFrame([(1, "a", None)], SCHEMA)
    base = store.append(one)
    store.append(one)
    with pytest.raises(sharding.Conflict):
        store.commit(base, base.shards, base.schema)
    assert store.versions() == [1, 2] and store.read().count() == 2
    for other in (one.drop("text"), one.withColumn("doc_id", F.col("doc_id").cast("string")), one.select("text", "doc_id", "shard_id")):
        with pytest.raises(ValueError):
            store.append(other)
    assert store.versions() == [1, 2] and store.read().count() == 2


def test_vacuum_beside_an_append(spark):
    """Files of an append that hasn't committed stay; an append whose files are gone doesn't commit."""
    one = spark.createDataFrame([(1, "a", None)], SCHEMA)
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    store.append(one)
    settle = store._settle

    def between(age):
        def run(change):
            sharding.ShardStore(spark, store.path).vacuum(older_than_s=age)
            return settle(change)

        return run

    store._settle = between(sharding.VACUUM_AGE)
    store.append(one)
    assert store.read().count() == 2
    store._settle, there = settle, store._there
    store._there = lambda shards: (sharding.ShardStore(spark, store.path).vacuum(older_than_s=-60), there(shards))
    with pytest.raises(FileNotFoundError):
        store.append(one)
    assert store.read().count() == 2


def test_query_against_the_table(spark, sf):
    """Every row once, each in a shard whose count and place in the manifest agree."""
    from parqlane.llm import queries

    got = queries.QUERIES["op5_tiered_shards"](spark, sf).collect()
    want = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(text, 256) AS text_sha256").collect()
    assert sorted((r.doc_id, str(r.text_sha256)) for r in got) == sorted((r.doc_id, str(r.text_sha256)) for r in want)
    shards = {}
    for r in got:
        shards.setdefault((r.shard_id, r.shard_rows, r.shard_bytes), []).append(r.doc_id)
    assert sorted(k for k, _, _ in shards) == list(range(len(shards))) and all(n == len(rows) for (_, n, _), rows in shards.items())


def test_odd_rows(spark):
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    assert store.read().count() == 0 and store.compact().version == 0
    rows = [(None, None, "x"), (1, "", None), (1, "", None), (2, "long " * 100000, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    store.append(df.limit(0))
    assert store.read().columns == df.columns and store.read().count() == 0 and store.read_with_shards().count() == 0
    store.append(df)
    store.append(df)
    store.compact(final=True)
    assert len(store.manifest().shards) == 1 and rows_of(store.read()) == sorted(rows_of(df) * 2)
    assert store.read_with_shards().columns == ["doc_id", "text", "shard_id", "shard_rows", "shard_bytes"]
