"""Secret scans over an incremental blob ledger.

A text version is a blob, addressed by the SHA-256 of its UTF-8 bytes; a rule is addressed by its
kind and a digest of its pattern. The ledger, a folder of Parquet files in a store all executors
share, has one row per (blob, rule version) that was ever scanned, with what was found. A scan

1. addresses all rows and looks up, by addresses alone, which pairs the ledger lacks,
2. takes one copy of each blob that lacks a pair: where few do, a blob that stands once is scanned in
   its place and only the others move; equal texts are merged before any shuffle,
3. runs the missing rules over those texts and appends the findings to the ledger, and
4. joins the findings back to every path, that is, every row that holds the blob.

So copies cost one scan, a second run over the same rows scans nothing, and a new rule version scans
each blob for that rule alone. Appending is Spark's own commit: a failed run adds no rows.

Offsets are in code points, ends exclusive. Defined cases: null text counts as empty and has no
spans; repeated rows get the same spans; null ids are kept; an empty table gives an empty table;
columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqlane.llm.common import discard, file_system, hadoop_path, materialise, scratch_path

#: Blobs (some 200 bytes each) up to which what the ledger lacks is broadcast.
BROADCAST_BLOBS = 200_000


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` has fewer than ``least`` characters are dropped.

    hints: lower-case strings one of which any match contains, whatever its case.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        said = repr((self.kind, self.pattern, self.least, self.group, self.any_case))
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def finder(self):
        # ASCII: with it, "either case" is that of A-Z alone.
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer

        def spans(text: str, lowered: str) -> list[tuple[str, int, int]]:
            if self.hints and not any(h in lowered for h in self.hints):
                return []
            return [(self.kind, *m.span()) for m in found(text) if len(m[self.group]) >= self.least]

        return spans


#: The base kinds. Fixed patterns and lengths; a run of hex digits is as long as it gets, so a
#: shorter run never holds a longer one and {24,} says the same as + with a least length.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, False, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: What the ledger's scan finds besides: key blocks, signed web tokens, credentials in addresses.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[ \t\r\f\v]*\n(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)+)?[ \t\n\r\f\vA-Za-z0-9+/=]*-----END [A-Z ]*PRIVATE KEY-----)?", hints=("private key-----",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("url", r"\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^ \t\n\r\f\v/@:]+:[^ \t\n\r\f\v/@]+@", hints=("://",)),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:int,end:int>>"
_LEDGER = f"blob binary, rule string, spans {SPANS}"


def find(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[str, int, int]]:
    """All spans by start, then in the order of the rules."""
    text = text or ""
    lowered = text.lower()
    found = [(s, k, e, kind) for k, r in enumerate(rules) for kind, s, e in r.finder()(text, lowered)]
    return [(kind, s, e) for s, k, e, kind in sorted(found)]


class BlobLedger:
    """The findings of every (blob, rule version) scanned so far, at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        fs, _ = file_system(self.spark, self.path)
        if not len(fs.globStatus(hadoop_path(self.spark, f"{self.path}/*.parquet")) or ()):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(self.path)

    def update(self, addressed: DataFrame, rules: Sequence[Rule]) -> None:
        """Scan what the ledger lacks of addressed (blob binary, text string) and append it."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        versions = [r.version for r in rules]
        have = self.rows().where(F.col("rule").isin(versions)).groupBy(F.col("blob").alias("b")).agg(F.collect_set("rule").alias("have"))
        blobs = addressed.groupBy("blob").agg(F.count("*").alias("copies")).join(have, F.col("blob") == F.col("b"), "left")
        keys = blobs.select(F.col("blob").alias("b"), "copies", F.coalesce("have", F.array().cast("array<string>")).alias("have"))
        keys = materialise(keys.where(F.size("have") < len(set(versions))), "lacking")
        same = F.col("blob") == F.col("b")
        if keys.count() <= BROADCAST_BLOBS:
            some = addressed.join(F.broadcast(keys), same)
            again = some.where("copies > 1").groupBy("blob").agg(F.first("text").alias("text"), F.first("have").alias("have"))
            lacking = some.where("copies = 1").select("blob", "text", "have").unionByName(again)
        else:
            texts = addressed.groupBy("blob").agg(F.first("text").alias("text"))
            lacking = texts.join(keys, same).select("blob", "text", "have")
        out = self.spark.createDataFrame([], _LEDGER).schema

        def scan(batches):
            finders, schema = [r.finder() for r in rules], to_arrow_schema(out)
            for batch in batches:
                rows = [[], [], []]
                for blob, text, have in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    text = text or ""
                    lowered = text.lower()
                    for version, finder in zip(versions, finders):
                        if version not in have:
                            rows[0].append(blob)
                            rows[1].append(version)
                            rows[2].append([dict(zip(("kind", "start", "end"), x)) for x in finder(text, lowered)])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

        lacking.mapInArrow(scan, out).write.mode("append").parquet(self.path)
        discard(keys)


def _addressed(docs: DataFrame, text_col: str):
    """The address of a row's text, and the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.unhex(F.sha2(text, 256)), text


def record(docs: DataFrame, ledger: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger lacks of docs, a version of the texts, and return nothing."""
    address, text = _addressed(docs, text_col)
    BlobLedger(docs.sparkSession, ledger).update(docs.select(address.alias("blob"), text.alias("text")), rules)


def scan_secrets(
    docs: DataFrame, text_col: str = "text", keep=None, rules: Sequence[Rule] = RULES, ledger: str | None = None
) -> DataFrame:
    """docs' ``keep`` columns (default: all), blob (hex address) and secret_spans.

    secret_spans: array<struct<kind,start,end>> by start, then in the order of the rules.
    ledger: the folder of the ledger; without one, a new ledger in the shared folder.
    """
    spark = docs.sparkSession
    book = BlobLedger(spark, ledger or scratch_path(spark, "ledger"))
    address, text = _addressed(docs, text_col)
    book.update(docs.select(address.alias("blob"), text.alias("text")), rules)
    place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    found = (
        book.rows()
        .where(F.col("rule").isin([r.version for r in rules]) & (F.size("spans") > 0))
        .groupBy(F.col("blob").alias("found_blob"), "rule")
        .agg(F.first("spans").alias("spans"))  # a pair scanned by two runs at once stands twice
        .groupBy("found_blob")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
        .select(
            "found_blob",
            F.transform(
                F.array_sort(
                    F.transform(
                        "spans", lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))
                    )
                ),
                lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
            ).alias("spans"),
        )
    )
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("blob", "secret_spans")]
    paths = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), address.alias("address"))
    joined = paths.join(found, F.col("address") == F.col("found_blob"), "left")
    return joined.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        F.lower(F.hex("address")).alias("blob"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("secret_spans"),
    )


def said(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
