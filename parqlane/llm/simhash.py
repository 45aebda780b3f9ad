"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint is cut into segments of two bits and embedded as their bit counts, 32 coordinates of
0, 1 or 2 a lane of 64 bits. The Manhattan distance of two embeddings is a lower bound of the Hamming
distance of the fingerprints. The embedding is kept as unary digits (a segment's bits, sorted), so
that this distance is a bit count of one exclusive or.

The join lays grids over subspaces of the embedding: points whose counts agree in a grid's
coordinates share a cell. In a cell, pairs beyond the radius in Manhattan distance are ruled out, and
those left are compared bit by bit.

* ``cover`` lays grids that meet every pair within the radius: the coordinates are dealt into g
  groups, a distance of r leaves at least g - r groups without any difference, and each choice of
  g - r groups is a grid.
* ``sampled`` lays grids over random coordinates, for radii too wide to be covered: so many that a
  pair just at the radius's expected distance is met with a given probability.

Equal fingerprints are one point. Cells of up to ``CHUNK`` points are compared as a whole. In a larger
cell the best of 16 candidates becomes its leader; points within the radius of the leader are linked
to it, so only points out of its reach (in chunks) are compared with the cell's points (in chunks);
no task holds more than two chunks of a cell. Links between points that are connected already may be
left out, all others are found; nothing is capped.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any
other; fewer words than a shingle give one shingle; repeated rows and equal texts have equal
fingerprints and so one component; null ids are kept, and the least id that isn't null names a
component; an empty table gives an empty table; columns named like an output are replaced, other
columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parqlane.llm.common import SEED, discard, map_columns, materialise
from parqlane.llm.components import connected_components

WORDS, RADIUS, CHUNK = 4, 4, 4096
#: Bits of a segment, and segments of a lane.
SEGMENT_BITS, SEGMENTS = 2, 32
#: Heavy cells (some 700 bytes each, with their candidates) up to which their table is broadcast.
BROADCAST_CELLS = 10_000
#: Candidates for a heavy cell's leader.
CANDIDATES = 16
#: Fixed: hashes whose bits are counted at once, as many as a byte can count.
_BLOCK = 255
#: Costs in the same unit, measured: a point in a cell, and a comparison.
_POINT_COST, _PAIR_COST = 5.0, 0.005
#: Fixed: the low bits of all segments; odd factors and shifts that mix a hash (any good ones would do).
_LOW = int("01" * SEGMENTS, 2)
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def shingles(text: str | None, words: int) -> list[bytes]:
    """All shingles in order, repeats included; A-Z lower-cased, words split at ASCII white space."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist())]


def hashes_of(made: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(seed)), np.uint64, len(made))


def majority(hashes: np.ndarray) -> list[int]:
    """For each row of hashes the bits that are set in over half of it, as a signed 64-bit number."""
    lanes, n = hashes.shape
    ones, raw = np.zeros((lanes, 64), np.int64), np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(lanes, n, 8)
    for k in range(0, n, _BLOCK):
        ones += np.add.reduce(np.unpackbits(raw[:, k : k + _BLOCK], axis=2, bitorder="little"), axis=1, dtype=np.uint8)
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of the text's shingles, repeats included, as a signed 64-bit number."""
    return majority(hashes_of(shingles(text, words), seed)[None, :])[0]


def fingerprints(docs: DataFrame, text_col="text", keep=None, words=WORDS, seed=SEED, name="fingerprint") -> DataFrame:
    """docs' ``keep`` columns (default: all) and the text's fingerprint, a long."""
    return map_columns(docs, [text_col], lambda: lambda texts: [[fingerprint(t, words, seed) for t in texts]], [(name, "long")], keep)


# The embedding


def embedded(points: np.ndarray) -> np.ndarray:
    """Unary digits of the bit counts of all segments of each lane."""
    low, high = np.uint64(_LOW), points >> np.uint64(1)
    return (((points & high) & low) << np.uint64(1)) | ((points | high) & low)


def embedded_column(lane):
    low, high = F.lit(_LOW), F.shiftrightunsigned(lane, 1)
    return F.shiftleft(lane.bitwiseAND(high).bitwiseAND(low), 1).bitwiseOR(lane.bitwiseOR(high).bitwiseAND(low))


def _mask(segments) -> int:
    """The bits of segments, numbered from the lowest, as a signed 64-bit number."""
    bits = sum(3 << SEGMENT_BITS * s for s in segments)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


#: Chance that two random bits pairs have equal counts.
_EQUAL = sum(math.comb(SEGMENT_BITS, k) ** 2 for k in range(SEGMENT_BITS + 1)) / 4**SEGMENT_BITS


def cover(points: int, radius: int, agree: int | None = None) -> list[tuple[int, ...]]:
    """Grids, each the mask of one lane, one of which meets any pair within the radius.

    How many groups of coordinates must agree (``agree``) is chosen by the number of points, by cost
    alone: any choice meets every pair.
    """
    best = []
    for k in range(1, 5):
        if radius + k <= SEGMENTS:
            inside = points * _EQUAL ** (SEGMENTS * k / (radius + k))
            best.append((math.comb(radius + k, k) * (_POINT_COST + inside / 2 * _PAIR_COST), k))
    agree = agree or min(best)[1]
    n = radius + agree
    dealt = [range(k * SEGMENTS // n, (k + 1) * SEGMENTS // n) for k in range(n)]
    return [(_mask(s for group in chosen for s in group),) for chosen in combinations(dealt, agree)]


def _grids_for(size: int, segments: int, same: float, recall: float) -> int:
    """Grids of so many random segments that meet, with probability ``recall``, a pair each of whose
    segments has equal counts with chance ``same`` (no flip, or both of two unlike bits)."""
    equal = np.arange(size, segments + 1)  # segments of the pair with equal counts
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = np.exp([log(segments, j) + j * math.log(same) + (segments - j) * math.log(1 - same) for j in equal.tolist()])
    missed = -np.expm1([log(j, size) - log(segments, size) for j in equal.tolist()])  # by one grid
    low, high = 0, 1
    while chance @ (1 - missed**high) < recall:
        low, high = high, 2 * high
        if high > 1 << 20:
            return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if chance @ (1 - missed**mid) >= recall else (mid, high)
    return high


def sampled(points: int, lanes: int, flip: float, recall: float, seed: int = SEED) -> list[tuple[int, ...]]:
    """Grids, each one mask a lane, that meet a pair whose bits differ with chance ``flip`` with
    probability ``recall`` or more; how many coordinates a grid has is chosen by cost alone."""
    best = []
    for size in range(1, 25):
        count = _grids_for(size, lanes * SEGMENTS, (1 - flip) ** 2 + flip**2 / 2, recall)
        best.append((count * (_POINT_COST + points * _EQUAL**size / 2 * _PAIR_COST), size, count))
    _, size, count = min(best)
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        chosen = rng.choice(lanes * SEGMENTS, size, replace=False)
        out.append(tuple(_mask((chosen[chosen // SEGMENTS == lane] % SEGMENTS).tolist()) for lane in range(lanes)))
    return out


# Comparing the points of a cell


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return reduce(np.add, (np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.uint16) for k in range(a.shape[-1])))


def near_pairs(points: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int):
    """Of pairs of positions those within the radius: first by Manhattan distance, then by bits."""
    may = _apart(counts[left], counts[right]) <= radius
    left, right = left[may], right[may]
    near = _apart(points[left], points[right]) <= radius
    return left[near], right[near]


def walk(points: np.ndarray, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest of the rows of lanes within the radius, breadth first.

    A point that is reached leaves the rest, so n points give fewer than n links and a dense cell
    costs few passes.
    """
    rest, left, right = np.arange(len(points)), [], []
    while len(rest) > 1:
        todo, rest = [rest[-1]], rest[:-1]
        while todo and len(rest):
            one = todo.pop()
            _, found = near_pairs(points, counts, np.full(len(rest), one), rest, radius)
            if len(found):
                left.append(np.full(len(found), one))
                right.append(found)
                todo += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


#: Pairs compared at once, and links a point from which a cell is walked instead.
_PAIRS, _DENSE = 1 << 18, 8


def cell_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of the rows of lanes within the radius: all, or in a dense cell a forest."""
    counts, n, left, right, found = embedded(points), len(points), [], [], 0
    step = max(1, _PAIRS // n)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        bound = reduce(np.add, (np.bitwise_count(c[lo:hi, None] ^ c[None, lo:]).astype(np.uint16) for c in counts.T))
        i, j = np.nonzero(bound <= radius)
        i, j = i[i < j] + lo, j[i < j] + lo
        near = _apart(points[i], points[j]) <= radius
        left.append(i[near])
        right.append(j[near])
        found += len(left[-1])
        if found > _DENSE * n:
            return walk(points, counts, radius)
    return np.concatenate(left), np.concatenate(right)


#: Cells of up to so many points are compared together with others.
_SMALL = 64


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the links between n positions join what the links before them don't: fewer than n."""
    own, kept = list(range(n)), []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while own[a] != a:
            own[a] = a = own[own[a]]
        while own[b] != b:
            own[b] = b = own[own[b]]
        if a != b:
            own[b] = a
            kept.append(k)
    return np.array(kept, np.int64)


def links_of_rows(cells: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest within the cells of rows that come by cell."""
    start = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1)) if len(cells) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(cells)))
    left, right, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], embedded(points)
    after = np.repeat(start + size, size) - np.arange(len(cells)) - 1  # rows of the cell that follow a row
    at = np.flatnonzero((after > 0) & (np.repeat(size, size) <= _SMALL))
    for k in range(1, _SMALL):
        at = at[after[at] >= k]
        if not len(at):
            break
        i, j = near_pairs(points, counts, at, at + k, radius)
        left.append(i)
        right.append(j)
    for s, n in zip(start[size > _SMALL], size[size > _SMALL]):
        i, j = cell_links(points[s : s + n], radius)
        left.append(i + s)
        right.append(j + s)
    left, right = np.concatenate(left), np.concatenate(right)
    kept = forest(len(cells), left, right)
    return left[kept], right[kept]


def _links_of_cells(radius: int, lanes: int):
    """Batches of (cell, node, lanes), by cell, to links of nodes; with one lane it is the node."""

    def run(batches):
        import pyarrow as pa

        width = 2 if lanes == 1 else 2 + lanes
        held = np.empty((0, width), np.int64)

        def links(rows):
            points = np.ascontiguousarray(rows[:, -lanes:]).view(np.uint64)
            a, b = links_of_rows(rows[:, 0], points, radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[a, 1]), pa.array(rows[b, 1])], names=["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(i).to_numpy() for i in range(width)], axis=1)
            held = np.concatenate((held, new)) if len(held) else new
            if len(held):
                start = np.searchsorted(held[:, 0], held[-1, 0])  # the last cell may go on
                done, held = held[:start], held[start:]
                yield links(done)
        yield links(held)

    return run


def links(points: DataFrame, lanes, node: str, radius: int, grids, chunk: int = CHUNK) -> DataFrame:
    """a, b: links of nodes whose lanes differ in ``radius`` bits or fewer and that a grid brings together."""
    points = points.select(*dict.fromkeys((node, *lanes))).distinct()
    given = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(m).alias(f"m{i}") for i, m in enumerate(g))) for k, g in enumerate(grids)))
    at = lambda g: F.xxhash64(g["k"], *(embedded_column(F.col(lane)).bitwiseAND(g[f"m{i}"]) for i, lane in enumerate(lanes)))
    cells = points.select(F.explode(F.transform(given, at)).alias("cell"), *points.columns)
    heavy = materialise(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "cells")
    many = heavy.count()
    if many:
        there = F.broadcast(heavy) if many <= BROADCAST_CELLS else heavy
        found, more = _heavy(cells.join(there, "cell"), lanes, node, radius, chunk, many)
        cells = cells.join(there, "cell", "left_anti").unionByName(more)
    rows = cells.repartition(F.col("cell")).sortWithinPartitions("cell")
    out = rows.mapInArrow(_links_of_cells(radius, len(lanes)), "a long, b long")
    return out.unionByName(found) if many else out


def _heavy(members: DataFrame, lanes, node: str, radius: int, chunk: int, many: int):
    """Links to the leaders of heavy cells, and smaller cells of what has still to be compared."""

    def near(other):
        return reduce(add, (F.bit_count(F.col(lane).bitwiseXOR(other[lane])) for lane in lanes)) <= radius

    fields = list(dict.fromkeys((node, *lanes)))
    small = F.broadcast if many <= BROADCAST_CELLS else lambda df: df
    one = F.struct(F.xxhash64(F.lit(SEED), node).alias("order"), *fields)
    some = members.groupBy("cell", F.pmod(F.xxhash64(node), F.lit(CANDIDATES)).alias("s")).agg(F.min(one).alias("x"))
    some = materialise(some.groupBy("cell").agg(F.collect_list("x").alias("xs")), "leaders")  # 16 a cell
    hits = members.join(small(some), "cell").select("cell", *(near(F.get("xs", F.lit(k))).cast("long").alias(f"c{k}") for k in range(CANDIDATES)))
    hits = hits.groupBy("cell").agg(F.array(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(CANDIDATES))).alias("hits"))
    best = F.get("xs", F.array_position("hits", F.array_max("hits")).cast("int") - 1)
    leaders = some.join(hits, "cell").select("cell", best.alias("leader"))
    marked = members.join(small(leaders), "cell").withColumn("near", near(F.col("leader")))
    marked = materialise(marked.select("cell", "n", *fields, F.col(f"leader.{node}").alias("to"), "near"), "heavy")
    found = marked.where(F.col("near") & (F.col("to") != F.col(node))).select(F.col("to").alias("a"), F.col(node).alias("b"))
    left = marked.groupBy("cell").agg(F.sum((~F.col("near")).cast("long")).alias("rest")).where("rest > 0")
    dealt = marked.join(small(left), "cell").select(
        "cell", "near", *fields, F.ceil(F.col("n") / chunk).alias("blocks"), F.ceil(F.col("rest") / chunk).alias("chunks")
    )
    blocks, chunks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    own_block, own_chunk = F.pmod(F.xxhash64(node), F.col("blocks")), F.pmod(F.xxhash64(F.lit(1), node), F.col("chunks"))
    every = dealt.withColumn("other", F.explode(chunks)).select(F.xxhash64("cell", "other", own_block).alias("cell"), *fields)
    rest = dealt.where(~F.col("near")).withColumn("other", F.explode(blocks))
    return found, every.unionByName(rest.select(F.xxhash64("cell", own_chunk, "other").alias("cell"), *fields))


def _named(points: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """p and the least ``value`` of its component, for every node in points.p, given the links.

    What is joined is written first: the joins then stand on shuffles alone, whose large partitions
    (a component, or a point with many rows) Spark can split.
    """
    roots = connected_components(found, "a", "b")
    linked = materialise(points.join(roots, F.col("p") == F.col("node")).select(F.col("p").alias("q"), "root", value), "linked")
    least = materialise(linked.groupBy(F.col("root").alias("r")).agg(F.min(value).alias("least")), "least")
    named = linked.join(least, F.col("root") == F.col("r")).select("q", "least")
    out = points.join(named, F.col("p") == F.col("q"), "left").select("p", F.coalesce("least", value).alias(value))
    out = materialise(out, "components")
    for done in (linked, least):
        discard(done)
    return out


def near_duplicates(
    docs: DataFrame, id_col="doc_id", text_col="text", keep=None, words=WORDS, radius=RADIUS, seed=SEED, chunk=CHUNK, agree=None
) -> DataFrame:
    """docs' ``keep`` columns (default: the id), fingerprint (long) and component_id.

    component_id: the least id reachable over links of at most ``radius`` bits, itself included.
    """
    keep = [c for c in (keep or [id_col]) if c not in ("fingerprint", "component_id")]
    marked = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = materialise(fingerprints(marked, "text", [*(f"k{i}" for i in range(len(keep))), "id"], words, seed, "p"), "fingerprints")
    points = materialise(marked.groupBy("p").agg(F.min("id").alias("component_id")), "points")
    found = links(points, ("p",), "p", radius, cover(points.count(), radius, agree), chunk)
    named = _named(points, found, "component_id").withColumnRenamed("p", "q")
    return marked.join(named, F.col("p") == F.col("q")).select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("p").alias("fingerprint"), "component_id"
    )


# One document of each group, by the similarity of sets of shingles


LANES, KEPT_WORDS, SIMILARITY, RECALL = 4, 5, 0.8, 0.95
#: Rows (16 bytes each) up to which the keys of candidates are broadcast.
BROADCAST_KEYS = 500_000
#: Shingles (and 64 a document) that a chunk of a group of candidates holds.
CHUNK_SHINGLES = 1 << 20


def flip_chance(similarity: float) -> float:
    """Chance that a bit differs between two sets of equal size with this Jaccard similarity.

    It is angle / pi, where cos(angle) = 2s / (1 + s); sets of unequal size have a greater cosine.
    """
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def candidate_bits(similarity: float, bits: int) -> int:
    """Differing bits that a pair of sets with this Jaccard similarity or more practically never passes.

    4.5 standard deviations leave out some 2 of 100,000 pairs that are just so similar, and fewer above.
    """
    p = flip_chance(similarity)
    return int(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's different shingles, in order."""
    return np.unique(hashes_of(shingles(text, words), seed))


def lanes_of(hashes: np.ndarray, lanes: int) -> list[int]:
    """Fingerprints of a set under as many hash functions; the further ones mix the first one's hash."""
    x = hashes[None, :] + (np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in _MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return majority(x ^ (x >> np.uint64(31)))


def _set_prints(words: int, seed: int, lanes: int):
    """Texts to the name of their shingle set, its size and the lanes of its fingerprint."""

    def make():
        def work(texts):
            out = [[] for _ in range(2 + lanes)]
            for text in texts:
                hashes = shingle_set(text, words, seed)
                name = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed)).view(np.int64))
                for column, value in zip(out, (name, len(hashes), *lanes_of(hashes, lanes))):
                    column.append(value)
            return out

        return work

    return make


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the sets with this Jaccard similarity or more."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    holders, ends = owner[np.argsort(token, kind="stable")], np.cumsum(np.bincount(token))
    own = np.split(token, np.cumsum(sizes)[:-1])
    rest, left, out = np.ones(m, bool), m, []
    for first in range(m):
        todo = [first] if rest[first] else []
        left -= len(todo)
        rest[first] = False
        while todo and left:
            one = todo.pop()
            near = [holders[ends[t - 1] if t else 0 : ends[t]] for t in own[one].tolist()]
            if not near:
                continue
            common = np.bincount(np.concatenate(near), minlength=m)
            good = np.flatnonzero(rest & (common > 0) & (common >= similarity * (sizes + sizes[one] - common))).tolist()
            rest[good] = False
            left -= len(good)
            todo += good
            out += [(one, k) for k in good]
    return out


def _similar_of_groups(words: int, seed: int, similarity: float):
    """Batches of (group, leads, node, text), by group, leaders first, to links of nodes.

    In a group with a leader each other node is linked to it or, where it isn't similar, to itself.
    """

    def run(batches):
        import pyarrow as pa

        now, nodes, sets, led = None, [], [], False

        def found():
            if led:
                common = [len(np.intersect1d(sets[0], x, assume_unique=True)) for x in sets[1:]]
                got = [(0 if c >= similarity * (len(sets[0]) + len(x) - c) else k, k) for k, (c, x) in enumerate(zip(common, sets[1:]), 1)]
            else:
                got = similar(sets, similarity) if len(sets) > 1 else []
            a, b = [nodes[i] for i, _ in got], [nodes[j] for _, j in got]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for group, leads, node, text in zip(*batch.columns):
                if group.as_py() != now:
                    yield found()
                    now, nodes, sets, led = group.as_py(), [], [], leads.as_py()
                nodes.append(node.as_py())
                sets.append(shingle_set(text.as_py(), words, seed))
        yield found()

    return run


def _verified(row: DataFrame, points: DataFrame, found: DataFrame, words, seed, similarity, chunk_shingles) -> DataFrame:
    """a, b: the links that exact comparison leaves of the components of the candidates ``found``.

    A component that fits a chunk is compared as a whole. In a larger one every set is compared with
    a leader, and those that aren't similar to it (in chunks) with all (in chunks).
    """

    def compared(groups):
        spread = groups.repartition(F.col("group")).sortWithinPartitions("group", F.col("leads").desc())
        return spread.mapInArrow(_similar_of_groups(words, seed, similarity), "a long, b long")

    weight, no = F.col("size") + 64, F.lit(False).alias("leads")
    near = connected_components(found, "a", "b")
    members = materialise(points.join(near, F.col("p") == F.col("node")).select("p", "root", "size", "first.h", "first.g"), "candidates")
    total = F.ceil(F.sum(weight) / chunk_shingles).cast("int")
    sizes = materialise(members.groupBy(F.col("root").alias("r")).agg(total.alias("chunks"), F.min("p").alias("leader")), "sizes")
    members = members.join(sizes, F.col("root") == F.col("r")).select("p", "root", "size", "chunks", "leader", F.col("h").alias("mh"), F.col("g").alias("mg"))
    texts, keys = row.select("h", "g", "text"), members.select(F.col("mh").alias("h"), F.col("mg").alias("g"))
    if members.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(keys), ["h", "g"], "left_semi")
    texts = texts.groupBy("h", "g").agg(F.first("text").alias("text"))  # repeated rows meet before they move
    held = texts.join(members, (F.col("h") == F.col("mh")) & (F.col("g") == F.col("mg"))).drop("h", "g", "mh", "mg")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return compared(held.select(F.col("root").alias("group"), no, "p", "text"))
    held = materialise(held, "texts")
    out = compared(held.where("chunks = 1").select(F.col("root").alias("group"), no, "p", "text"))
    wide = held.where("chunks > 1")
    own = F.pmod(F.xxhash64("p"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    led = wide.where("p != leader").select(F.xxhash64("root", own).alias("group"), no, "p", "text")
    leaders = wide.where("p = leader").withColumn("other", F.explode(every))
    led = led.unionByName(leaders.select(F.xxhash64("root", "other").alias("group"), F.lit(True).alias("leads"), "p", "text"))
    met = materialise(compared(led), "led")
    rest = wide.join(met.where("a = b").select(F.col("a").alias("q")), F.col("p") == F.col("q"), "left_semi")
    parts = materialise(rest.groupBy(F.col("root").alias("r")).agg(total.alias("parts")), "parts")
    dealt = wide.join(parts, F.col("root") == F.col("r"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("root", "other", own).alias("group"), no, "p", "text")
    own_part = F.pmod(F.xxhash64(F.lit(1), "p"), F.col("parts")).cast("int")
    rest = rest.join(parts, F.col("root") == F.col("r")).withColumn("other", F.explode(every))
    dealt = dealt.unionByName(rest.select(F.xxhash64("root", own_part, "other").alias("group"), no, "p", "text"))
    return out.unionByName(met.where("a != b")).unionByName(compared(dealt))


def keep_one(
    docs: DataFrame, id_col="doc_id", text_col="text", words=KEPT_WORDS, similarity=SIMILARITY, lanes=LANES, recall=RECALL, seed=SEED,
    chunk=CHUNK, chunk_shingles=CHUNK_SHINGLES,
) -> DataFrame:
    """One row of docs of each component: that with the least id (nulls last), then the least row hash.

    Links join texts whose sets of shingles have the Jaccard similarity or more, exactly: fingerprints
    of the sets only find candidates, within ``candidate_bits`` and with probability ``recall`` or more
    for a pair that is just so similar. Rows that agree in everything are one row.
    """
    names = docs.columns
    row = docs.toDF(*(f"k{i}" for i in range(len(names))))
    hashed = [c for c, kind in row.dtypes if "map<" not in kind]  # maps have no order, and so no hash
    own_id, own_text = f"k{names.index(id_col)}", f"k{names.index(text_col)}"
    row = row.withColumns({"h": F.xxhash64(F.lit(seed), *hashed), "g": F.xxhash64(F.lit(seed + 1), *hashed), "text": F.col(own_text)})
    marked = row.select(F.col(own_id).alias("id"), "h", "g", "text")
    prints = [f"lane{k}" for k in range(lanes)]
    fields = [(n, "long") for n in ("p", "size", *prints)]
    marked = materialise(map_columns(marked, ["text"], _set_prints(words, seed, lanes), fields, ["id", "h", "g"]), "fingerprints")
    order = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "g")).alias("first")
    points = materialise(marked.groupBy("p").agg(order, *(F.first(c).alias(c) for c in ("size", *prints))), "points")
    grids = sampled(points.count(), lanes, flip_chance(similarity), recall, seed)
    found = links(points, prints, "p", candidate_bits(similarity, 64 * lanes), grids, chunk)
    found = _verified(row, points, found, words, seed, similarity, chunk_shingles)
    firsts = _named(points.select("p", "first"), found, "first").select(F.col("first.h").alias("fh"), F.col("first.g").alias("fg")).distinct()
    rows = row.drop("text").groupBy("h", "g").agg(*(F.first(f"k{i}").alias(f"k{i}") for i in range(len(names))))
    kept = rows.join(firsts, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")), "left_semi")
    return kept.select(*(f"k{i}" for i in range(len(names)))).toDF(*names)


def hex_fingerprint(column):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
