import math

import numpy as np
from pyspark.sql import functions as F

from parqlane.llm import anisotropic

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for i, v in good.items():
        if i % every == 0:
            scored = sorted((-float(v @ w), j) for j, w in good.items() if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_loss_weighs_the_parallel_part():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = anisotropic.fit(x)
    mean, length, rest = q.split(x)
    assert np.allclose(q.coarse[mean] + length[:, None] * rest, x)
    codes = q.encode(rest, x)
    decoded = q.decode(codes, 64)
    plain = anisotropic.Quantiser(q.coarse, q.centres, 1.0)
    nearest = q.decode(plain.encode(rest, x), 64)
    parallel = lambda d: (((rest - d) * x).sum(1) ** 2).mean()
    assert parallel(decoded) < parallel(nearest) and ((rest - decoded) ** 2).sum(1).mean() >= ((rest - nearest) ** 2).sum(1).mean()
    table = q.tables(x[:3])
    packed = q.pack(codes)
    scanned = sum(table[:, m][:, packed[:, m]] for m in range(packed.shape[1]))
    assert np.allclose(scanned, x[:3] @ decoded.T, atol=1e-5)


def test_crowded_vectors_are_told_apart(spark):
    """A third of all vectors lie close to one place."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4500, 32))
    x[::3] = x[0] + 0.004 * rng.normal(size=(1500, 32))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    check(spark, df, rows, 0.95)


def recall(got, want):
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items() if w)
    return hits / sum(map(len, want.values()))


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def check(spark, df, rows, least, **options):
    got, want = as_lists(anisotropic.nearest(df, F.col("vec_id") % 20 == 0, **options)), brute(rows)
    assert got.keys() == {i for i, w in want.items() if w}
    vector = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v and None not in v}
    for i, found in got.items():
        assert len(found) == len(want[i])
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and i not in [j for j, _ in found]
        assert all(abs(s - vector[i] @ vector[j]) < 1e-12 for j, s in found)
    assert recall(got, want) >= least


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(spark, df, rows, 0.95)
    check(spark, df, rows, 0.95, shard_rows=130, query_rows=9, rerank=40)


def test_query_against_brute_force(spark, sf):
    from parqlane.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.QUERIES["op2_anisotropic_search"](spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.dtypes[1:] == [("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert recall(as_lists(got), brute(rows)) >= 0.95


def test_probing_few_cells_of_clusters(spark):
    rng = np.random.default_rng(3)
    centres = 3 * rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    check(spark, spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA), rows, 0.9, probe=0.25)


def test_large_components(spark):
    """Products beyond single precision."""
    rng = np.random.default_rng(4)
    x = (1e25 * rng.normal(size=(300, 8))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = as_lists(anisotropic.nearest(spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0))
    assert recall(got, brute(rows)) >= 0.95


def test_larger_sample_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(spark, df, rows, 0.95)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(1, 80)]
    hot = [0.5, 0.25, 1.0, -2.0, 4.0]
    rows += [(i, hot) for i in range(100, 190)]
    rows += [(None, hot), (200, None), (220, []), (240, [0.0] * 5), (260, [1.0, None, 1.0, 1.0, 1.0]), (280, [float("nan")] * 5), (300, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + rows[:3] + [rows[99]]], SCHEMA)
    check(spark, df, rows, 1.0, rerank=500)
    check(spark, df, rows, 1.0, rerank=500, shard_rows=20, query_rows=2)
    assert anisotropic.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.where("vec_id in (1, 2, 20)")
    assert sorted((r.query_id, r.rank) for r in anisotropic.nearest(few, F.col("vec_id") % 20 == 0).collect()) == [(20, 1), (20, 2)]
