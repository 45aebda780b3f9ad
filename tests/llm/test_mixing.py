import re
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from parqlane.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_size int"


def plain_targets(sizes, weights, cap):
    target, fixed = [Fraction(0)] * len(sizes), set()
    while True:
        left = Fraction(sum(sizes)) - sum(target[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return target
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > cap * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = Fraction(cap * sizes[i])
            fixed.add(i)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = mixing.capped_targets(sizes, weights)
    assert [round(float(x), 6) for x in plain_targets(sizes, weights, 3)] == [round(x, 6) for x in got]
    assert abs(sum(got) - sum(sizes)) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9), st.integers(0, 400))
def test_sainte_lague_against_one_seat_at_a_time(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))
        got[best] += 1
    assert mixing.sainte_lague(votes, seats, [10**9] * len(votes)) == got


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, cap=3, slack=0.02):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda n: (n is None, n or ""))
    sizes = [sum(words(r["text"]) for r in by[n]) for n in names]
    targets = plain_targets(sizes, [i % 3 + 1 for i in range(len(names))], cap)
    for n, s, t in zip(names, sizes, targets):
        for r in by[n]:
            assert r["mix_size"] == words(r["text"]) and r["mix_source_size"] == s
            assert 0 <= r["mix_taken"] <= cap * r["mix_size"]
            assert abs(r["mix_target"] - float(t)) < 1e-6 * max(1, s)
        assert abs(sum(r["mix_taken"] for r in by[n]) - t) <= max(2, slack * float(t)), (n, s, float(t))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = mixing.mix(docs, shard_words=4000).collect()
    check(once)
    again = mixing.mix(docs.repartition(5), shard_words=4000).collect()
    assert sorted((r.doc_id, r.mix_taken) for r in once) == sorted((r.doc_id, r.mix_taken) for r in again)
    mixed = mixing.mixed_documents(docs, shard_words=4000)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.mix_taken for r in once)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_odd_rows(spark):
    rows = [(None, "a b c", None, 1), (1, None, "s", 2), (1, "", "s", 2), (2, "x " * 5000, "s", 3), (2, "x " * 5000, "s", 3)]
    rows += [(3, "one\ttwo\nthree", "é", None), (4, "q", "z", 0), (4, "q", "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    check(out, slack=0.05)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text = ''")).collect()[0].mix_taken == 0
