import random

from hypothesis import given, settings
from hypothesis import strategies as st

from parqlane.llm import line_dedup
from parqlane.llm.edit_distance import _banded, within


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


SHORT = st.text("abé", max_size=12)


@settings(max_examples=800, deadline=None)
@given(SHORT, SHORT, st.integers(1, 4))
def test_edit_distance(a, b, most):
    want = plain_distance(a, b)
    assert within(a, b, most) == (want <= most)
    if abs(len(a) - len(b)) <= most:
        assert _banded(a, b, most) == want or (want > most and _banded(a, b, most) > most)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("xyz"))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rng.choice("xyz")
    return "".join(out)


def test_every_near_pair_meets_under_a_key():
    rng = random.Random(1)
    for _ in range(3000):
        most = rng.choice([1, 2, 3])
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(most + 8, 40)))
        b = edited(rng, a, rng.randrange(most + 1))
        (ia, pa), (ib, pb) = (line_dedup.keys_of(x, most, most + 1) for x in (a, b))
        assert set(ia) & {*ib, *pb} or set(ib) & {*ia, *pa}


def plain_dedup(rows, most, least):
    """rows: (id, text) -> per row (n_lines, n_dropped, kept_text, kept_in)."""
    import xxhash

    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63)))
    places, texts = [], []
    for d in docs:
        for pos, line in enumerate(d[1].split("\n") if d[1] is not None else []):
            line = line.strip(" \t\n\r\x0b\x0c")
            if len(line) >= least:
                places.append((d, pos))
                texts.append(line)
    cls = list(range(len(texts)))

    def root(i):
        while cls[i] != i:
            i = cls[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (abs(len(texts[i]) - len(texts[j])) <= most and plain_distance(texts[i], texts[j]) <= most):
                a, b = sorted((root(i), root(j)))
                cls[b] = a
    gone, held = {}, {}
    for i, (d, pos) in enumerate(places):
        if root(i) != i:
            gone.setdefault(d, set()).add(pos)
            held.setdefault(d, set()).add(places[root(i)][0][0])
    out = {}
    for d in docs:
        lines = d[1].split("\n") if d[1] is not None else []
        dropped = gone.get(d, set())
        kept = None if d[1] is None else "\n".join(x for p, x in enumerate(lines) if p not in dropped)
        out[d] = (len(lines), len(dropped), kept, sorted(held.get(d, ())))
    seen, found = set(), []
    for r in rows:
        if r in seen and r[1] is not None:  # a copy of the whole row loses every line that takes part
            lines = r[1].split("\n")
            kept = [x for x in lines if len(x.strip(" \t\n\r\x0b\x0c")) < least]
            lost = len(lines) - len(kept)
            found.append((len(lines), lost, "\n".join(kept), [r[0]] if lost and r[0] is not None else []))
        else:
            found.append(out[r])
        seen.add(r)
    return found


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept_text string, line string")
    got = line_dedup.dedup_lines(df, **options).collect()
    want = plain_dedup(rows, options.get("most", 2), options.get("least", 20))
    said = lambda r: repr((r[0], r[1], r[2]))
    assert sorted(said(((r.doc_id, r.text), (r.n_lines, r.n_dropped), (r.kept_text, list(r.kept_in)))) for r in got) == sorted(
        said((d, w[:2], w[2:])) for d, w in zip(rows, want)
    )


def corpus(rng, n):
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(22, 60))).strip().ljust(22, "q") for _ in range(25)]
    rows = []
    for i in range(n):
        lines = [edited(rng, rng.choice(pool), rng.randrange(4)) for _ in range(rng.randrange(1, 6))]
        lines += rng.choices(["", "short", "  " + pool[0] + "\t", pool[1], "unique line number %d of this text" % rng.randrange(10**9)], k=2)
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = corpus(rng, 60)
    check(spark, rows)
    check(spark, rows, chunk=2)
    check(spark, rows, most=1, least=5)


def test_bags_of_near_lines_share_a_key():
    rng = random.Random(3)
    for _ in range(500):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é0123") for _ in range(rng.randrange(22, 60)))
        most = rng.choice([1, 2, 3])
        b = edited(rng, a, rng.randrange(most + 1))
        assert set(line_dedup.bag_keys(a, most)) & set(line_dedup.bag_keys(b, most))


def test_query_against_brute_force(spark, sf, tmp_path):
    """The registered query over a whole table of a few documents."""
    import hashlib

    from parqlane.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.union(docs.limit(2)).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    want = sorted(repr((d, n, gone, digest(kept), held)) for (d, _), (n, gone, kept, held) in zip(rows, plain_dedup(rows, 2, 20)))
    got = queries.QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, list(r.kept_in))) for r in got) == want


def test_odd_rows(spark):
    line = "the very same line of more than twenty characters"
    rows = [(None, None), (None, line), (5, line + "\n" + line), (5, line + "\n" + line), (5, "x" + line), (3, ""), (3, "\n\n"), (9, (line + "\n") * 3000 + "end")]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(df.where("text is null")).collect()[0].kept_text is None


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows)
