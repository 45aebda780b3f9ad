import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parqlane.llm import simhash
from parqlane.llm.components import connected_components


def plain_fingerprint(text, k=4, seed=42):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Index -> least index reachable."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "É", "the", " ", "\n", "\t", "\x1c", " ", "x y z "]), max_size=30).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)
    assert simhash.fingerprint(text, seed=43) % 2**64 == plain_fingerprint(text, seed=43)


def segment_counts(x):
    return [(x >> k & 3).bit_count() for k in range(0, 64, 2)]


def test_the_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    some = [rng.getrandbits(64) for _ in range(100)]
    unary = [int(x) for x in simhash.embedded(np.array(some, np.uint64))]
    for x, y in zip(some, unary):
        assert [(y >> k & 3) for k in range(0, 64, 2)] == [(0, 1, 3)[c] for c in segment_counts(x)]
    for k in range(1, 100):
        manhattan = sum(abs(a - b) for a, b in zip(segment_counts(some[0]), segment_counts(some[k])))
        assert manhattan == (unary[0] ^ unary[k]).bit_count() <= (some[0] ^ some[k]).bit_count()
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in some], "x long")
    assert [r.y % 2**64 for r in df.select(simhash.embedded_column(F.col("x")).alias("y")).collect()] == unary


def test_every_near_pair_shares_a_cell():
    rng = random.Random(3)
    for radius, agree in ((4, 1), (4, 2), (9, 2), (4, 3), (4, None)):
        grids = [g % 2**64 for (g,) in simhash.cover(10**6, radius, agree)]
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), radius):
                b ^= 1 << k
            assert any(segment_counts(a & g) == segment_counts(b & g) for g in grids)


def test_sampled_grids_meet_as_many_pairs_as_asked():
    rng, flip = random.Random(6), simhash.flip_chance(0.8)
    for points in (1000, 10**6, 10**9):
        grids = simhash.sampled(points, 4, flip, 0.95)
        met = 0
        for _ in range(400):
            a = [rng.getrandbits(64) for _ in range(4)]
            b = [x ^ sum((rng.random() < flip) << k for k in range(64)) for x in a]
            met += any(all(segment_counts(x & m % 2**64) == segment_counts(y & m % 2**64) for x, y, m in zip(a, b, g)) for g in grids)
        assert met >= 0.92 * 400


def test_walk_gives_the_components():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 3), dtype=np.uint64), axis=1) for c in centres]))
    want = plain_components([int(p) for p in points], 4)
    lanes, cells = points[:, None], np.sort(rng.integers(0, 5, len(points)))
    assert len(simhash.walk(lanes, simhash.embedded(lanes), 4)[0]) < len(points)
    for left, right in (simhash.walk(lanes, simhash.embedded(lanes), 4), simhash.cell_links(lanes, 4)):
        assert all(int(points[a] ^ points[b]).bit_count() <= 4 for a, b in zip(left, right))
        assert joined(len(points), zip(left, right)) == want
    for at in (cells, np.arange(len(points)) // 7):  # cells above and below the size that is compared in one go
        left, right = simhash.links_of_rows(at, lanes, 4)
        assert (at[left] == at[right]).all() and len(left) < len(points)
        inside = [(a, b) for a in range(len(points)) for b in range(a) if at[a] == at[b] and int(points[a] ^ points[b]).bit_count() <= 4]
        assert joined(len(points), zip(left, right)) == joined(len(points), inside)
    assert [len(x) for x in simhash.links_of_rows(np.empty(0, np.int64), np.empty((0, 1), np.uint64), 4)] == [0, 0]


def joined(n, links):
    """Index -> least index reachable."""
    own = {i: {i} for i in range(n)}
    for a, b in links:
        if own[a] is not own[b]:
            both = own[a] | own[b]
            for x in both:
                own[x] = both
    return [int(min(own[i])) for i in range(n)]


def near_texts(rng, n):
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    texts = near_texts(rng, 60) + near_texts(rng, 40) + [f"{rng.random()} {rng.random()} some" for _ in range(100)] + [None, "", " \n", "One", "one", "oNe two"]
    rows = [(i + 5, t, "x", 1) for i, t in enumerate(texts)]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, p int")
    prints = [plain_fingerprint(t) for t in texts]
    for radius, options in ((4, {}), (4, {"chunk": 4, "agree": 1}), (4, {"agree": 3}), (9, {"chunk": 16, "agree": 2})):
        want = {i + 5: r + 5 for i, r in enumerate(plain_components(prints, radius))}
        got = simhash.near_duplicates(df, radius=radius, **options).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.fingerprint % 2**64 for r in got} == {i + 5: p for i, p in enumerate(prints)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(odd).collect()) == [("3", "3"), ("None", "None"), ("None", "None")]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"v{rng.randrange(10**6)}"
    return out


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[r][0]) for i, r in enumerate(plain_components(prints, 4))}
    got = simhash.near_duplicates(docs).withColumn("f", simhash.hex_fingerprint("fingerprint")).collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 90)] + [(500, 500)]
    rng.shuffle(chain)
    links = spark.createDataFrame([*chain, (None, 4), chain[0]], "a long, b long")
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 90)}
    assert connected_components(links.where(F.lit(False)), "a", "b").count() == 0


def test_keep_one_against_brute_force_jaccard(spark):
    rng = random.Random(8)
    sets = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(t.lower().split())
    texts = ["", "one two", "One two"]
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 300]))]
        texts += [" ".join(edited(rng, base, n)) for n in (0, 1 + k % 3, len(base) // 40, len(base) // 30, len(base) // 20)]
        texts += [" ".join(base[: len(base) * 17 // 20]), " ".join([*base, *base[:20] * 20])]
    held = [sets(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])]
    assert len(alike) > 100
    roots = joined(len(texts), alike)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(roots))
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want
    # heavy cells with leaders, components in chunks with leaders
    assert sorted(r.doc_id for r in simhash.keep_one(df, chunk=8, chunk_shingles=1500).collect()) == want


def test_keep_one_of_documents_against_brute_force_jaccard(spark):
    """Recall of the links over the documents of a larger table, and of near copies of them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(9)
    texts = {r.doc_id: r.text or "" for r in rows}
    long = [t.split() for t in texts.values() if 150 < len(t.split()) < 2000]
    texts |= {10**6 + k: " ".join(edited(rng, w, len(w) // 60)) for k, w in enumerate(long[:150])}
    ids, held = sorted(texts), {}
    for d in ids:
        w = texts[d].encode().lower().split()
        held[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by, alike = {}, []
    for d in ids:
        common = {}
        for x in held[d]:
            for other in by.setdefault(x, []):
                common[other] = common.get(other, 0) + 1
            by[x].append(d)
        alike += [(d, o) for o, c in common.items() if 5 * c >= 4 * (len(held[d]) + len(held[o]) - c)]
    alike += [(a, b) for a, b in zip(*[iter(sorted(d for d in ids if not held[d]))] * 2)]
    place = {d: k for k, d in enumerate(ids)}
    roots = joined(len(ids), [(place[a], place[b]) for a, b in alike])
    docs = spark.createDataFrame([(d, texts[d]) for d in ids], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    groups = {}
    for d, root in zip(ids, roots):
        groups.setdefault(root, []).append(d)
    assert len(alike) > 150 and all(any(d in kept for d in g) for g in groups.values())
    copies = sum(len(g) - 1 for g in groups.values())
    assert sum(sum(d in kept for d in g) - 1 for g in groups.values()) <= 0.05 * copies


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", 5, "u"), (1, "a b c d e f", 5, "u"), (2, "A b c d e f", 6, "v"), (None, None, 7, None), (3, "other words here", 8, "w")]
    df = spark.createDataFrame(rows, "__id long, text string, __row int, p string")
    got = simhash.keep_one(df, "__id")
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    found = simhash.near_duplicates(df, "__id", keep=["__id", "__row", "p"]).collect()
    assert sorted((r["__row"], r.component_id) for r in found) == [(5, 1), (5, 1), (6, 1), (7, None), (8, 3)]
