"""Nearest neighbours by largest inner product: anisotropic quantisation, 4-bit tables, exact rerank.

The error that matters for an inner product is the one along the vector, so the quantiser weighs a
residual's parallel part more than the rest: loss = |r|^2 + (eta - 1) (r . x / |x|)^2. What is
quantised is the direction of the vector's difference from the nearest of ``COARSE`` means; the
difference's length is kept, so vectors crowded round one place are told apart as well as others. The
direction is cut into subspaces of 2 components with 16 centres each (4-bit codes). Codes are chosen
by coordinate descent on that loss, centres by solving its normal equations.

Every different vector is encoded once; the codes are stored, ``SHARD_ROWS`` vectors a row. A search
deals queries into blocks of ``QUERY_ROWS``. A task takes one block and a run of stored shards, scans
their packed codes through the queries' tables and keeps the ``RERANK`` vectors a query with the best
table scores. The best of all tasks' are fetched by key and scored exactly in double precision.
Equal vectors stand once in all this and bring their ids back at the end (the k + 1 smallest, for no
more can be among the nearest), so copies neither crowd out others nor break ties.

All codes are scanned by default. ``probe`` scans the cells (of vectors nearest to one mean) whose
best possible score by mean and radius is greatest, that part of them; measured, it pays only where
vectors stand in clusters: of evenly spread directions the upper half of 64 cells holds 0.89 of the
nearest, a quarter 0.69.

The quantiser is fitted on at most ``FIT_ROWS`` vectors, those with the smallest seeded hash; every
vector is indexed. Defined cases: vectors that are null, empty, all zero or hold a null or
non-finite component, and rows with null id, take no part; vectors of another length than the
query's aren't its candidates; rows repeated in full count once; a row never finds its own id;
with fewer than k candidates all come; no queries give no rows; columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parqlane.llm.common import SEED, materialise, smallest

FIT_ROWS, SHARD_ROWS, QUERY_ROWS, RERANK, TOP = 8192, 8192, 512, 160, 20
#: Stored shards that one task scans for a block, at most.
RUN = 64
COARSE = 64  # means
PARALLEL = 0.2  # eta for inner products above this part of the norm
_SCAN = 128  # queries scanned at once
_TINY = 1e-300


@dataclass
class Quantiser:
    coarse: np.ndarray  # means, components
    centres: np.ndarray  # subspace, 16, components
    eta: float

    @property
    def width(self) -> int:
        return self.centres.shape[2]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, component), padded with zeros."""
        parts, width = self.centres.shape[0], self.width
        padded = np.zeros((len(x), parts * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), parts, width)

    def split(self, x: np.ndarray):
        """Nearest mean of each row, length of the rest, and the rest's direction."""
        mean = _nearest(x, self.coarse)
        rest = x - self.coarse[mean]
        length = np.linalg.norm(rest, axis=1)
        return mean, length, rest / np.maximum(length, 1e-300)[:, None]

    def encode(self, rest: np.ndarray, towards: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of the rests; towards: the unit vectors along which an error weighs more."""
        cut, along = self.cut(rest), self.cut(towards)
        # For every subspace and centre: squared residual and its part along the vector.
        square = ((cut[:, :, None, :] - self.centres[None]) ** 2).sum(-1)
        parallel = (cut * along).sum(-1)[:, :, None] - np.einsum("nmd,mkd->nmk", along, self.centres)
        codes = square.argmin(-1)
        rows = np.arange(len(rest))
        sums = np.take_along_axis(parallel, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(cut.shape[1]):
                others = sums - parallel[rows, m, codes[:, m]]
                loss = square[:, m] + (self.eta - 1) * (others[:, None] + parallel[:, m]) ** 2
                codes[:, m] = loss.argmin(-1)
                sums = others + parallel[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray, d: int) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, :d]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two 4-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each pair of centres: (query, byte place, 256)."""
        one = np.einsum("qmd,mkd->qmk", self.cut(queries), self.centres).astype(np.float32)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256)


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(1) - 2 * x @ means.T).argmin(1)


def _means(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    """k-means; a mean that no row is nearest to starts again from some row."""
    means = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, means)
        count = np.bincount(own, minlength=len(means))
        total = np.stack([np.bincount(own, x[:, j], len(means)) for j in range(x.shape[1])], 1)
        again = x[rng.integers(0, len(x), len(means))]
        means = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], again)
    return means


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def fit(x: np.ndarray, width: int = 2, rounds: int = 4, coarse: int = COARSE, seed: int = SEED) -> Quantiser:
    rng, (n, d) = np.random.default_rng(seed), x.shape
    parts = -(-d // width)
    eta = max(1.0, (d - 1) * PARALLEL**2 / (1 - PARALLEL**2))
    q = Quantiser(_means(x, coarse, rng), np.zeros((parts, 16, width)), eta)
    rest, towards = q.split(x)[2], unit(x)
    cut, along = q.cut(rest), q.cut(towards)
    for m in range(parts):
        found = _means(cut[:, m], 16, rng, 8)
        q.centres[m] = found[np.arange(16) % len(found)]
    wanted = (rest * towards).sum(1)  # what the centres' parts along the vector should add up to
    size = parts * 16 * width
    for _ in range(rounds):
        codes = q.encode(rest, towards)
        places = (np.arange(parts)[None, :, None] * 16 + codes[:, :, None]) * width + np.arange(width)
        flat = places.reshape(n, -1)
        z = np.zeros((n, size))
        np.put_along_axis(z, flat, along.reshape(n, -1), 1)
        left = (q.eta - 1) * (z.T @ z)
        right = (q.eta - 1) * (z.T @ wanted)
        used = np.bincount(flat.ravel(), minlength=size)
        left[np.diag_indices(size)] += np.where(used == 0, 1.0, used + 1e-9)
        right += np.bincount(flat.ravel(), cut.reshape(n, -1).ravel(), size)
        right[used == 0] += q.centres.ravel()[used == 0]
        q.centres = np.linalg.solve(left, right).reshape(parts, 16, width)
    return q


def _coder(model: Quantiser, d: int, scale: float):
    """A shard's vectors to one row of its codes: keys, mean, length of the rest, packed codes."""

    def code(table):
        import pyarrow as pa

        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d) / scale
        mean, length, rest = model.split(x)
        codes = model.pack(model.encode(rest, unit(x)))
        made = (table.column("vh").to_numpy().astype("<i8"), mean.astype("<u2"), length.astype("<f4"), codes)
        cells = np.stack([mean, length], 1)
        radius = [float(cells[mean == c, 1].max(initial=0)) for c in range(len(model.coarse))]
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), **{n: pa.array([m.tobytes()], pa.binary()) for n, m in zip(("keys", "mean", "length", "codes"), made)}, "radius": pa.array([radius], pa.list_(pa.float64()))})

    return code


_CODES = "shard int, keys binary, mean binary, length binary, codes binary, radius array<double>"


def _packed_queries(d: int):
    """A block's queries in one row."""

    def pack(table):
        import pyarrow as pa

        _, first = np.unique(table.column("h").to_numpy(), return_index=True)  # repeated rows count once
        table = table.take(pa.array(first))
        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "hs": pa.array([table.column("h").to_numpy().astype("<i8").tobytes()], pa.binary()), "qs": pa.array([unit(x).astype("<f4").tobytes()], pa.binary())})

    return pack


def scan_codes(model: Quantiser, keys, mean, length, codes, queries, rerank: int, allowed=None):
    """(keys, table scores) of the best ``rerank`` vectors of a shard for each query.

    allowed: for each query, which cells to look at.
    """
    packed, deep = codes.astype(np.intp), min(rerank, len(keys))
    best, told = np.empty((len(queries), deep), np.int64), np.empty((len(queries), deep), np.float32)
    for at in range(0, len(queries), _SCAN):
        some = queries[at : at + _SCAN].astype(np.float64)
        tables = model.tables(some)
        score = np.zeros((len(some), len(keys)), np.float32)
        for m in range(packed.shape[1]):
            score += np.take(tables[:, m], packed[:, m], axis=1)
        score = score * length + (some @ model.coarse.T).astype(np.float32)[:, mean]
        if allowed is not None:
            score[~allowed[at : at + _SCAN][:, mean]] = -np.inf
        place = np.argpartition(-score, deep - 1, axis=1)[:, :deep]
        best[at : at + _SCAN], told[at : at + _SCAN] = keys[place], np.take_along_axis(score, place, 1)
    return best, told


def _scanner(model: Quantiser, d: int, rerank: int, probe: float, radius: np.ndarray):
    """Scan of a run of stored shards by one block of queries, both as Arrow tables."""

    def scan(one, many):
        import pyarrow as pa

        hs, keys, told = np.empty(0, np.int64), np.empty((0, 0), np.int64), np.empty((0, 0), np.float32)
        if len(one) and len(many):
            hs = np.frombuffer(many.column("hs")[0].as_py(), "<i8")
            queries, allowed = np.frombuffer(many.column("qs")[0].as_py(), "<f4").reshape(-1, d), None
            if probe < 1:
                most = queries @ model.coarse.T + radius
                allowed = np.argsort(np.argsort(-most, axis=1), axis=1) < max(1, round(probe * len(model.coarse)))
            keys, told = np.empty((len(hs), 0), np.int64), np.empty((len(hs), 0), np.float32)
            for k in range(len(one)):
                own, mean, length = (np.frombuffer(one.column(n)[k].as_py(), t) for n, t in (("keys", "<i8"), ("mean", "<u2"), ("length", "<f4")))
                codes = np.frombuffer(one.column("codes")[k].as_py(), np.uint8).reshape(len(own), -1)
                found, scores = scan_codes(model, own, mean, length, codes, queries, rerank, allowed)
                keys, told = np.concatenate((keys, found), 1), np.concatenate((told, scores), 1)
                if keys.shape[1] > rerank:
                    place = np.argpartition(-told, rerank - 1, axis=1)[:, :rerank]
                    keys, told = np.take_along_axis(keys, place, 1), np.take_along_axis(told, place, 1)
        seen = np.isfinite(told)
        row = np.nonzero(seen)[0]
        return pa.table({"h": pa.array(hs[row], pa.int64()), "vh": pa.array(keys[seen], pa.int64()), "near": pa.array(told[seen], pa.float32())})

    return scan


def nearest(
    vectors: DataFrame, is_query, id_col="vec_id", vector_col="embedding", k=TOP, rerank=RERANK, fit_rows=FIT_ROWS,
    shard_rows=SHARD_ROWS, query_rows=QUERY_ROWS, probe=1.0, seed=SEED,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row where is_query holds."""
    spark = vectors.sparkSession
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = (
        vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), is_query.alias("is_query"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(good)
        .select("id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.size("v").alias("d"), F.xxhash64(F.lit(seed), "id", "v").alias("h"), F.xxhash64(F.lit(seed), "v").alias("vh"))
    )
    usable = materialise(usable, "vectors")
    sizes = usable.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("nq")).collect()
    kind = usable.schema["id"].dataType
    found = None
    for d, n, nq in ((r.d, r.n, r.nq) for r in sizes if r.nq):
        some = _nearest_of_length(usable.where(F.col("d") == d), d, n, nq, k, rerank, fit_rows, shard_rows, query_rows, probe, seed)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, vec_id {kind.simpleString()}, score double")
    return found


def _nearest_of_length(own: DataFrame, d, n, nq, k, rerank, fit_rows, shard_rows, query_rows, probe, seed) -> DataFrame:
    sample = smallest(own, fit_rows, F.col("h"), "id").select("v").toArrow().column("v").combine_chunks()
    x = np.asarray(sample.flatten(), np.float64).reshape(-1, d)
    scale = float(np.abs(x).max())  # so that table scores stay within single precision
    model = fit(x / scale, seed=seed)
    distinct = materialise(own.groupBy("vh").agg(F.first("v").alias("v")), "distinct")
    shards, blocks = -(-n // shard_rows), -(-nq // query_rows)
    shard = F.pmod(F.xxhash64("vh"), F.lit(shards)).cast("int").alias("shard")
    codes = distinct.select("vh", "v", shard).groupBy("shard").applyInArrow(_coder(model, d, scale), _CODES)
    codes = materialise(codes, "codes")
    radius = np.zeros(len(model.coarse))
    if probe < 1:
        most = codes.select(F.posexplode("radius").alias("cell", "r")).groupBy("cell").agg(F.max("r").alias("r")).collect()  # one a mean
        for r in most:
            radius[r.cell] = r.r
    queries = own.where("is_query").select("h", "v", F.pmod(F.shiftrightunsigned("h", 20), F.lit(blocks)).cast("int").alias("block"))
    queries = materialise(queries.groupBy("block").applyInArrow(_packed_queries(d), "block int, hs binary, qs binary"), "queries")
    runs = max(-(-shards // RUN), min(shards, -(-own.sparkSession.sparkContext.defaultParallelism // blocks)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = codes.drop("radius").withColumn("run", F.pmod("shard", F.lit(runs))).withColumn("block", every(blocks)).groupBy("run", "block")
    right = queries.withColumn("run", every(runs)).groupBy("run", "block")
    met = left.cogroup(right).applyInArrow(_scanner(model, d, rerank, probe, radius), "h long, vh long, near float")
    by_query = lambda *order: Window.partitionBy("h").orderBy(*order)
    met = met.withColumn("r", F.row_number().over(by_query(F.col("near").desc(), "vh"))).where(F.col("r") <= rerank).select("h", F.col("vh").alias("w"))
    # Exact scores of what the scan leaves, in double precision, on the original vectors.
    asked = own.where("is_query").select(F.col("h").alias("q_h"), F.col("id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["q_h"])
    pairs = met.join(distinct, F.col("w") == F.col("vh")).select("h", "vh", "v").join(asked, F.col("h") == F.col("q_h"))
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = pairs.select("h", "query_id", F.col("vh").alias("w"), product.alias("score"))
    scored = scored.withColumn("r", F.rank().over(by_query(F.col("score").desc()))).where(F.col("r") <= k + 1).drop("r")
    ids = own.select("vh", "id").distinct()
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("r") <= k + 1)
    named = scored.join(ids.select("vh", "id"), F.col("w") == F.col("vh")).where(F.col("id") != F.col("query_id"))
    ranked = named.withColumn("rank", F.row_number().over(by_query(F.col("score").desc(), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
