"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is joins and pre-aggregated minima over the links; each round's links are written to the
shared folder, so nothing of the graph reaches the driver but a count and a checksum, and a lost
executor costs at most one round. Rounds grow with the logarithm of the component sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parqlane.llm.common import discard, materialise


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links, written, and their number and checksum, counted on the way."""
    seen = Observation()
    out = materialise(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return out, (seen.get["n"], seen.get["sum"])


#: Links a file of a round's table holds at least, so that small graphs make few files.
LINKS_PER_FILE = 500_000


def _with_minimum(links: DataFrame, files: int) -> tuple[DataFrame, DataFrame | None]:
    """u, v, m, where m is the least of u and all its v; and what is to be discarded after use.

    With more than a file's links the minima are written, so that the join stands on shuffles alone:
    Spark can split a node with a large part of all links.
    """
    least = links.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    held = materialise(least.coalesce(files), "least") if files > 1 else None
    return links.join(least if held is None else held, F.col("u") == F.col("w")).select("u", "v", "m"), held


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root for every node of a link; root is the least node of its component.

    Nodes are longs; links with a null end and links of a node with itself say nothing and are left
    out; repeated links count once; no links give no rows.
    """
    now, state = _written(
        links.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
        .where(f"{left} IS NOT NULL AND {right} IS NOT NULL AND u != v")
        .distinct()
    )
    while state[0]:
        files = 1 + 2 * state[0] // LINKS_PER_FILE
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, held = _with_minimum(both, files)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct().coalesce(files), "links")
        small, least = _with_minimum(large, files)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        after, found = _written(small.coalesce(files))
        for done in (held, large, least, now):
            discard(done)
        was, state, now = state, found, after
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
