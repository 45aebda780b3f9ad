import base64
import re

import public_tokenizers as P
import pytest
import tiktoken
from test_line_dedup import plain_dedup
from test_mixing import plain_targets, words
from test_simhash import joined

import corpus_pipeline
from parqlane.llm import gam, mixing, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns on documents, [documents, ...]."""
    out = [spark.read.parquet(f"{sf}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    yield out
    for frame in out:
        frame.unpersist()


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "byte-level bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(spark, sf, stages):
    model = gam.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    rows = stages[0].collect()
    import numpy as np

    keep = model.score(np.array([gam.features(r.text) for r in rows])) >= 0.3
    assert sorted(r.doc_id for r, k in zip(rows, keep) if k) == sorted(r.doc_id for r in stages[1].collect())
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert all(d in kept for d, q in truth.items() if q == 1)
    assert not all(d in kept for d, q in truth.items() if q == 0)  # few labels here; accuracy is tested on more


def test_line_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[1].orderBy("doc_id").limit(50).collect()]
    # brute force over a small part of the texts, through the same function
    part = stages[1].where(stages[1].doc_id.isin([d for d, _ in before]))
    got = {r.doc_id: r for r in corpus_pipeline.dedup_lines(None, part, None).collect()}
    for (d, _), (_, _, kept, _) in zip(before, plain_dedup(before, 2, 20)):
        assert got[d].text == kept and got[d].n_chars == len(kept)


def test_near_stage(stages):
    """One document of each group by the exact similarity of five-word sets."""
    rows = sorted((r.doc_id, r.text or "") for r in stages[2].collect())
    held = [plain_set(t) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])]
    roots = joined(len(rows), alike)
    kept = {r.doc_id for r in stages[3].collect()}
    assert kept <= {rows[i][0] for i in range(len(rows))} and kept >= {rows[i][0] for i in set(roots)}
    assert len(kept) - len(set(roots)) <= 0.05 * (len(rows) - len(set(roots)))


def plain_set(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_mixing_stage(stages):
    by = {}
    for r in stages[3].collect():
        by.setdefault(r.source, []).append(words(r.text))
    names = sorted(by, key=lambda n: (n is None, n or ""))
    targets = plain_targets([sum(by[n]) for n in names], [i % 3 + 1 for i in range(len(names))], mixing.CAP)
    got = dict.fromkeys(names, 0)
    texts = {r.doc_id: re.findall(mixing.WORD, r.text) for r in stages[3].collect()}
    for r in stages[4].collect():
        got[r.source] += words(r.text)
        own = texts[r.doc_id]
        assert words(r.text) <= len(own) and r.n_chars == len(r.text)
    assert all(abs(got[n] - t) <= max(3, 0.02 * float(t)) for n, t in zip(names, targets))


def test_bpe_stage(stages):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, tuple(e.encode_ordinary(r.text))) for r in stages[4].collect())
    assert want == sorted((r.doc_id, tuple(r.token_ids)) for r in stages[5].collect())
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in stages[5].collect())


def test_run_agrees_with_the_stages(spark, sf, stages):
    said = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.token_ids)) for r in df.collect())
    assert said(corpus_pipeline.run(spark, sf)) == said(stages[5])


def test_odd_rows_go_through_every_stage(spark, sf):
    long = "a fairly long line of words number "
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one\ntwo", None, "t", 7), (7, "long " * 20000, "en", "s", 1)]
    rows += [(k, "\n".join(long + str(j) for j in range(k)), "en", "s", None) for k in range(10, 14)]
    for docs in (spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], COLUMNS)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf)
            docs.collect()
            if k < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_row_of_each_group(spark):
    rows = [(4, "a b c", "x"), (4, "a b c", "x"), (4, "A b c", "y"), (None, "q r", "x"), (None, "q r", "x"), (9, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "8", "None"] and len(got) == 3
