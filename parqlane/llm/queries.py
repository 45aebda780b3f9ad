"""The op queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import functions as F

from parqlane.llm import anisotropic, bpe, gam, gif, line_dedup, mixing, secrets, sharding, simhash
from parqlane.llm.common import read, scratch_path


def op1_mix_sources(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"], prefix="").select("doc_id", "size", "source_size", "target", "taken")


def op2_anisotropic_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return anisotropic.nearest(vectors, F.col("vec_id") % 20 == 0)


def op3_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.token_counts(docs, path, keep=["doc_id"])


def op4_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"], outputs=outputs)


ARRIVALS = 4


def op5_tiered_shards(spark, sf_dir):
    """Documents arrive in four parts; each row with the compacted shard that holds it."""
    docs = read(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch_path(spark, "store"))
    store.append_all(docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "arrival")
    store.compact()
    store.vacuum(older_than_s=0)  # nobody else writes to this store
    rows = store.read_with_shards()
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard_id", "shard_rows", "shard_bytes")


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = gam.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = gam.score_quality(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(gam.held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_gif_media(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return gif.text_media(docs, keep=["doc_id"], outputs=[k for k in gif.TEXT_MEDIA if k != "media"])


def op8_simhash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hex_fingerprint("fingerprint").alias("fingerprint"), "component_id")


def op9_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = line_dedup.dedup_lines(docs, keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_in")


def op10_secret_scan(spark, sf_dir):
    """Two versions of the corpus through one ledger: half of the rows, then all; only unseen blobs are scanned."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    ledger = scratch_path(spark, "ledger")
    secrets.record(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = secrets.scan_secrets(docs, keep=["doc_id"], ledger=ledger)
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("secret_spans", lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, kinds),
        F.sha2(secrets.said(base), 256).alias("base_sha256"),
        secrets.said("secret_spans").alias("spans"),
    )


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_anisotropic_search": op2_anisotropic_search,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_tiered_shards": op5_tiered_shards,
    "op6_quality": op6_quality,
    "op7_gif_media": op7_gif_media,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
}


def _secret_sql() -> str:
    """The scan in DuckDB: a match starts after the pieces and the matches before it."""

    def quoted(rule):
        pattern = rule.pattern
        if rule.any_case:  # of A-Z alone: SQL's own flag would fold other letters into them
            words, _, rest = pattern.partition(")")
            words = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)
            pattern = f"{words}){rest}"
        return pattern.replace("'", "''")

    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS ms, "
        f"regexp_extract_all(t, '{p}', {r.group}) AS gs, regexp_split_to_array(t, '{p}') AS ps FROM d"
        for k, r in enumerate(secrets.RULES)
        for p in (quoted(r),)
    )
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    base = [r.kind for r in secrets.BASE]
    counts = ", ".join(f"count(s) FILTER (kind = '{k}') AS n_{k}" for k in base)
    own = f"FILTER (kind IN ({', '.join(repr(k) for k in base)}))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({kinds}),
    i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
    p AS (SELECT doc_id, k, kind, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, ms[i] AS m
          FROM i WHERE length(gs[i]) >= least),
    f AS (SELECT doc_id, k, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM p)
    SELECT d.doc_id, {counts}, sha256(coalesce({said} {own}, '')) AS base_sha256, coalesce({said}, '') AS spans
    FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


ORACLE_SQL = {"op10_secret_scan": _secret_sql()}
