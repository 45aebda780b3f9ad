"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source are laid out, in seeded order of its documents, along several shards of
about ``shard_words`` words; every shard's stream is cut into blocks of B words. Sources get whole
blocks by highest quotients of their targets, shards get whole blocks of their source's quota by
highest quotients of their sizes, and a shard takes its quota as full passes over all its blocks
plus a run of consecutive blocks (the stream taken as a ring) from a seeded start. As documents
stand in seeded order this is a seeded choice of documents, and all but two per shard stay whole.

Scale: one row per source reaches the driver. A source's shards are dealt into groups of at most
``GROUP_SHARDS``; its quota goes to its groups by highest quotients and a group's to its shards, so
no window holds more than the groups of a source or the shards of a group, and documents are laid
out shard by shard: a hot source is many windows. A quota is found among six seats around the
proportional share.

Defined cases: null or empty text has size 0, is kept and takes nothing; null source is a source of
its own, ordered last; repeated rows each count; null ids are ordinary values; an empty table gives
an empty table; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parqlane.llm.common import SEED, WORD, materialise

CAP = 3
BLOCK_WORDS = 64
SHARD_WORDS, GROUP_SHARDS = 1 << 20, 4096
#: Seats looked at below and above the proportional share of a shard.
BELOW, ABOVE = 2, 3


def cyclic_weights(names: Sequence[str | None]) -> list[int]:
    """1, 2, 3, repeating, in code point order with null last."""
    place = {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}
    return [place[n] % 3 + 1 for n in names]


def capped_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    exact = [Fraction(w) for w in weights]
    while open_:
        total = sum(exact[i] for i in open_)
        over = {i for i in open_ if not total or left * exact[i] > Fraction(cap) * sizes[i] * total}
        if not over:
            for i in open_:
                target[i] = float(left * exact[i] / total)
            break
        for i in over:
            target[i] = float(Fraction(cap) * sizes[i])
            left -= Fraction(cap) * sizes[i]
        open_ -= over
    return target


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients vote / (2k + 1); ties go to the earlier party, caps are kept."""
    exact = [Fraction(v) for v in votes]
    total = sum(exact)
    if not total:
        return [0] * len(votes)
    # A quotient at the proportional divisor misplaces half a seat a party at most, which moves
    # the divisor by that part of all seats: so many seats are certain.
    share = [v * seats / total for v in exact]
    sure = [int(s) - 2 - int(s * len(votes) / max(1, seats)) for s in share]
    got = [min(c, max(0, s)) for s, c in zip(sure, caps, strict=True)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(exact, got, caps, strict=True)) if v and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-exact[i] / (2 * got[i] + 1), i))
    return got


def _plan(totals, weigh, cap, block_words, shard_words):
    names, sizes = [r[0] for r in totals], [int(r[1] or 0) for r in totals]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    names, sizes = [names[i] for i in order], [sizes[i] for i in order]
    targets = capped_targets(sizes, weigh(names), cap)
    block = max(1, min([block_words, *(int(t) // 512 for t in targets if t > 0)]))
    quota = sainte_lague(targets, round(sum(targets) / block), [int(cap * s) // block for s in sizes])
    return block, [
        (i, n, s, t, q, max(1, -(-s // shard_words)))
        for i, (n, s, t, q) in enumerate(zip(names, sizes, targets, quota, strict=True))
    ]


def _apportioned(parts: DataFrame, within: list[str], own: str, cap: int) -> DataFrame:
    """parts (within, own, quota, whole, size, blocks) with q, their seats of the quota of what they are
    within (whole in size): seats certain below the proportional share, the rest by highest quotient."""
    share = F.col("quota") * F.col("size") / F.col("whole")
    base = F.greatest(F.lit(0), F.least(F.floor(share) - BELOW, cap * F.col("blocks"))).cast("long")
    parts, per = parts.withColumn("base", base), Window.partitionBy(*within)
    full, quotient = F.col("seat") >= cap * F.col("blocks"), F.col("size") / (2 * F.col("seat") + 1)
    best = F.row_number().over(per.orderBy(full, quotient.desc(), own, "seat"))
    seats = parts.withColumn("left", F.col("quota") - F.sum("base").over(per))
    seats = seats.withColumn("seat", F.explode(F.sequence(F.col("base"), F.col("base") + BELOW + ABOVE)))
    won = seats.withColumn("won", ((best <= F.col("left")) & ~full).cast("long"))
    return won.groupBy(*within, own, "size", "blocks", "base").agg((F.col("base") + F.sum("won")).alias("q"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
    weigh: Callable[[Sequence[str | None]], Sequence[float]] = cyclic_weights,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    prefix: str = "mix_",
) -> DataFrame:
    """One row per row of docs with ``keep`` (default: all columns) and, under ``prefix``:
    size, source_size, target, taken, passes, parts.

    passes: whole copies the mix takes; parts: word ranges [from, to) of one further, partial copy.
    The block shrinks below ``block_words`` where the smallest target holds fewer than 512 of them.
    """
    spark, added = docs.sparkSession, ["size", "source_size", "target", "taken", "passes", "parts"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {prefix + a for a in added}]
    sized = docs.select(
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
        F.col(f"`{source_col}`").alias("src"),
        F.coalesce(F.regexp_count(f"`{text_col}`", F.lit(WORD)), F.lit(0)).cast("long").alias("n"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
        F.col(f"`{id_col}`").alias("id"),
    )
    sized = materialise(sized, "mix")
    totals = sized.groupBy("src").agg(F.sum("n").alias("n")).collect()
    block, rows = _plan(totals, weigh, cap, block_words, shard_words)
    kind = sized.schema["src"].dataType
    plan = spark.createDataFrame(
        rows,
        T.StructType(
            [
                T.StructField("s", T.IntegerType()),  # a number for each source: plain keys from here on
                T.StructField("p_src", kind),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("quota", T.LongType()),
                T.StructField("shards", T.LongType()),
            ]
        ),
    )
    plan = F.broadcast(plan) if len(rows) <= 10_000 else plan
    dealt = sized.join(plan, F.col("src").eqNullSafe(F.col("p_src"))).withColumn(
        "shard", F.pmod(F.shiftrightunsigned("h", 17), F.col("shards"))
    )

    # Sainte-Lague among the groups of a source's shards, then among the shards of a group.
    shards = dealt.where("n > 0").groupBy("s", "shard", "quota", "source_size").agg(F.sum("n").alias("size"))
    shards = shards.select(
        "s", F.floor(F.col("shard") / GROUP_SHARDS).alias("grp"), "shard", "quota", F.col("source_size").alias("whole"), "size",
        F.ceil(F.col("size") / block).cast("long").alias("blocks"),
    )
    shards = materialise(shards, "shards")
    groups = shards.groupBy("s", "grp", "quota", "whole").agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks"))
    groups = _apportioned(groups, ["s"], "grp", cap).select(F.col("s").alias("g_s"), F.col("grp").alias("g"), F.col("q").alias("quota"), F.col("size").alias("whole"))
    own = shards.drop("quota", "whole").join(groups, (F.col("s") == F.col("g_s")) & (F.col("grp") == F.col("g"))).drop("g_s", "g")
    seats = _apportioned(own, ["s", "grp"], "shard", cap).select(F.col("s").alias("q_s"), F.col("shard").alias("q_shard"), "q", "blocks")
    along = Window.partitionBy("s", "shard").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    laid = (
        dealt.withColumn("to", F.sum("n").over(along))
        .join(seats, (F.col("s") == F.col("q_s")) & (F.col("shard") == F.col("q_shard")), "left")
        .withColumn("passes", F.coalesce(F.expr("q div blocks"), F.lit(0)))
        .withColumn("run", F.coalesce(F.expr("q % blocks"), F.lit(0)))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), "blocks"))
    )

    def part(first, last):
        lo = F.greatest(first * block, F.col("to") - F.col("n")) - (F.col("to") - F.col("n"))
        hi = F.least(last * block, F.col("to")) - (F.col("to") - F.col("n"))
        return F.struct(lo.cast("long").alias("from"), hi.cast("long").alias("to"))

    end = F.col("start") + F.col("run")
    parts = F.filter(
        F.array(part(F.lit(0), end - F.col("blocks")), part(F.col("start"), end)),
        lambda p: (p["to"] > p["from"]),
    )
    laid = laid.withColumn("parts", F.when(F.col("run") > 0, parts).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")))
    taken = F.col("passes") * F.col("n") + F.aggregate(
        "parts", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"]
    )
    return laid.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("n").alias(f"{prefix}size"),
        F.col("source_size").alias(f"{prefix}source_size"),
        F.col("target").alias(f"{prefix}target"),
        taken.alias(f"{prefix}taken"),
        F.col("passes").alias(f"{prefix}passes"),
        F.col("parts").alias(f"{prefix}parts"),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: docs' columns, one row per whole copy taken and one per partial copy.

    A partial copy's text is the taken words joined by single spaces; documents without words give
    no row. ``chars_col``, where docs has it, is set to the length of the text.
    """
    free = "__mix_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = f"_{free}"
    mixed = mix(docs, text_col=text_col, prefix=free, **options)
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0))
    pieces = F.transform(f"{free}parts", lambda p: F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))
    part = F.when(
        F.col(f"{free}taken") > F.col(f"{free}passes") * F.col(f"{free}size"),
        F.array(F.array_join(F.flatten(pieces), " ")),
    ).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col(f"{free}size") > 0, F.array_repeat(F.col(f"`{text_col}`"), F.col(f"{free}passes").cast("int"))).otherwise(
        F.array().cast("array<string>")
    )
    out = mixed.withColumn(f"{free}text", F.explode(F.concat(whole, part)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(f"{free}text").alias(c))
        elif c == chars_col:
            columns.append(F.length(f"{free}text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
