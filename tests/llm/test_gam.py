import zlib

import numpy as np
import pytest

from parqlane.llm import gam


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_additive_and_pairwise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    alone = (x[:, 0] > 0.3).astype(float)
    m = gam.fit(x[:3000], alone[:3000])
    assert auc(alone[3000:], m.score(x[3000:])) > 0.98
    crossed = ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(float)
    m = gam.fit(x[:3000], crossed[:3000])
    assert auc(crossed[3000:], m.score(x[3000:])) > 0.95 and (m.pairs[0][0], m.pairs[0][1]) == (1, 2)
    row = x[3000:3001]
    by_hand = m.base + sum(t[(row[0, k] >= e).sum()] for k, (e, t) in enumerate(zip(m.edges, m.tables)))
    by_hand += sum(t[(row[0, a] >= ca).sum(), (row[0, b] >= cb).sum()] for a, b, ca, cb, t in m.pairs)
    assert m.raw(row)[0] == pytest.approx(by_hand)


def test_features_of_any_text():
    for text in (None, "", " ", "\n\n", "a", "ÀÉ 日本", "x" * 100000, "A! " * 5000):
        f = gam.features(text)
        assert len(f) == len(gam.FEATURES) and np.isfinite(f).all()
    named = dict(zip(gam.FEATURES, gam.features("AB cd!\ncd 12")))
    assert named["exclamation"] == 1 / 12 and named["upper"] == 2 / 12 and named["digits"] == 2 / 12 and named["distinct_words"] == 1.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = gam.score_quality(docs, model, keep=["doc_id"]).collect()
    held = [(truth[r.doc_id], r.score) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    y, s = np.array(held).T
    print("held out:", len(y), "auc", auc(y, s), "right", ((s >= 0.3) == (y == 1)).mean(), "junk caught", (s[y == 0] < 0.3).mean(), "clean kept", (s[y == 1] >= 0.3).mean())
    assert auc(y, s) > 0.97 and ((s >= 0.3) == (y == 1)).mean() > 0.95
    again = gam.train(docs.repartition(3), labels.repartition(3))
    assert again.base == model.base and all((a == b).all() for a, b in zip(again.tables, model.tables))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "q"), (1, "", "r"), (1, "", "r"), (2, "word " * 60000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = gam.train(df, some)
        out = gam.score_quality(df, model).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert gam.score_quality(df.limit(0), model).count() == 0
