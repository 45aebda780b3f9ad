"""Line dedup by a segment-partition edit join.

A line (stripped of ASCII white space at its ends, ``least_chars`` characters at least) is split
into t + 1 segments; within t edits one of them stands unchanged in the other line, near its own
place. So each line is indexed under (its length, segment number, segment) and probes, for every
length up to t shorter, the substrings that the multi-match-aware rule leaves: of segment i only
starts within i of the left end's shift and within t - i of the right end's. Lines that meet under
a key are compared by a banded bit-parallel edit distance. Every link within t edits is found.

Links make classes (connected components). A class keeps its first line (by document id, nulls
last, then text hash and line number) and loses all others, exact and near.

Scale: a task emits each line's keys once, so a line that stands in a third of all documents gives
one row a task; only keys with two different lines go on, and only their lines' texts are fetched.
A key with more than ``CHUNK`` lines is split further by bags of characters: an edit changes two of
32 classes' counts at most, so of 2t + 1 parts of the classes one has the same counts in both lines of
a near pair, and each part's counts make a key of their own. What is still larger is dealt into chunks
whose pairs are separate groups. The lines of a group are walked breadth first: n lines give fewer
than n links. Ids of lines are 64-bit hashes of their text (a chance of n^2 / 2^65 that two of n lines
share one).

Defined cases: null text has no lines and stays null; of rows that agree in id the order of text and
row hashes decides which is first; a row that repeats another in every column loses all its lines that
take part; shorter lines stay; a document may become empty; an empty table gives an empty table;
columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parqlane.llm.common import SEED, materialise
from parqlane.llm.components import connected_components
from parqlane.llm.edit_distance import within

THRESHOLD, LEAST_CHARS, CHUNK, BROADCAST_ROWS = 2, 20, 1024, 200_000
#: Fixed: what is stripped, the white space of ASCII.
BLANKS = " \t\n\r\x0b\x0c"
#: Lines a task remembers so as not to emit their keys again; a line met again is emitted again.
_REMEMBERED = 1_000_000


def starts(segment: int, shift: int, at: int, most: int) -> range:
    """Starts to probe for a segment (from 0) that begins at ``at`` in a line ``shift`` shorter."""
    lo = max(at - segment, at + shift - (most - segment))
    return range(lo, min(at + segment, at + shift + (most - segment)) + 1)


def keys_of(line: str, most: int, least: int) -> tuple[list[tuple], list[tuple]]:
    """Index keys and further probe keys: (length, segment number, substring)."""
    size = len(line)
    bounds = [k * size // (most + 1) for k in range(most + 2)]
    index = [(size, k, line[bounds[k] : bounds[k + 1]]) for k in range(most + 1)]
    probe = []
    for shift in range(most + 1):
        other = size - shift
        if other < least:
            break
        for k in range(most + 1):
            at, end = k * other // (most + 1), (k + 1) * other // (most + 1)
            for s in starts(k, shift, at, most):
                if 0 <= s and s + end - at <= size and (shift or s != at):
                    probe.append((other, k, line[s : s + end - at]))
    return index, probe


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), SEED)


def _key_rows(most: int, least: int):
    """Batches of texts to (key, line): line is the hash with its lowest bit set for index keys."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            keys: list[int] = []
            lines: list[int] = []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(BLANKS)
                    if len(line) < least:
                        continue
                    own = _digest(line)
                    if own in seen:
                        continue
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(own)
                    index, probe = keys_of(line, most, least)
                    keys += [_digest(f"{size},{k},{part}") for size, k, part in index]
                    keys += [_digest(f"{size},{k},{part}") for size, k, part in probe]
                    lines += [own | 1] * len(index)
                    lines += [own & ~1] * len(probe)
                if len(keys) > 200_000:
                    yield _pairs(pa, keys, lines)
                    keys, lines = [], []
            yield _pairs(pa, keys, lines)

    return run


def _pairs(pa, a, b):
    made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(made, names=["key", "line"])


def _met(batches):
    """Rows (key, line) of the keys that hold two different lines and an index key.

    Rows come by key, index keys first, so of a key that goes on in the next batch two rows are kept
    at most; these may come out twice.
    """
    import pyarrow as pa

    keys, lines = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        lines = np.concatenate((lines, batch.column(1).to_numpy()))
        if not len(keys):
            continue
        start = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
        own = lines & ~np.int64(1)
        indexed = lines[start] & 1 == 1
        good = indexed & (np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start))
        rows = np.repeat(good, np.diff(np.append(start, len(keys))))
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(own[rows])], names=["key", "line"])
        last = start[-1]
        other = np.flatnonzero(own[last:] != own[last])[:1] + last
        kept = np.append(last, other) if indexed[-1] else np.empty(0, np.int64)
        keys, lines = keys[kept], lines[kept]


def _bags(texts: list[str]) -> np.ndarray:
    """How often each of 32 classes of characters stands in each text."""
    return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) & 31, minlength=32) for t in texts])


def bag_keys(text: str, most: int) -> list[bytes]:
    """What two texts within ``most`` edits have one of in common: the counts of a part of the classes."""
    counts, n = _bags([text])[0].astype("<i4"), 2 * most + 1
    return [bytes([k]) + counts[k * 32 // n : (k + 1) * 32 // n].tobytes() for k in range(n)]


def _split_by_bags(most: int):
    """Batches of (key, line, text) to (key, line) under finer keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, lines = [], []
            for key, line, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = [xxhash.xxh64_intdigest(k, key & 0xFFFFFFFFFFFFFFFF) for k in bag_keys(text, most)]
                keys += own
                lines += [line] * len(own)
            made = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([made, pa.array(lines, pa.int64())], names=["key", "line"])

    return run


def walk(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the texts within ``most`` edits of each other.

    An edit adds a character at most and takes one away at most, so bags of characters that differ by
    more in one direction (lengths included) rule a pair out before it is compared.
    """
    bags = _bags(texts).astype(np.int32)
    rest, out = np.arange(len(texts)), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            more = bags[rest] - bags[one]
            may = (np.maximum(more, 0).sum(1) <= most) & (np.maximum(-more, 0).sum(1) <= most)
            found = [k for k in np.flatnonzero(may) if within(texts[one], texts[rest[k]], most)]
            if found:
                near = rest[found]
                out += [(int(one), int(k)) for k in near]
                todo += near.tolist()
                rest = np.delete(rest, found)
    return out


def _links_of_groups(most: int):
    def run(batches):
        import pyarrow as pa

        now, lines, texts = None, [], []

        def found():
            got = walk(texts, most) if len(texts) > 1 else []
            a, b = [lines[i] for i, _ in got], [lines[j] for _, j in got]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for group, line, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if group != now:
                    if len(texts) > 1:
                        yield found()
                    now, lines, texts = group, [], []
                lines.append(line)
                texts.append(text)
        if len(texts) > 1:
            yield found()

    return run


def _lines(docs: DataFrame, text_col: str, least: int, *columns) -> DataFrame:
    """columns, pos, line and its hash (lowest bit cleared) of every line that takes part."""
    out = docs.select(*columns, F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "raw"))
    out = out.withColumn("text", F.btrim("raw", F.lit(BLANKS))).where(F.length("text") >= least)
    return out.withColumn("line", F.xxhash64("text").bitwiseAND(F.lit(-2))).drop("raw")


def line_links(docs: DataFrame, text_col: str = "text", most: int = THRESHOLD, least: int = LEAST_CHARS, chunk: int = CHUNK) -> DataFrame:
    """a, b: links of different lines (hashes) within ``most`` edits, enough for the classes."""
    least = max(least, most + 1)  # a segment needs a character
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    rows = texts.mapInArrow(_key_rows(most, least), "key long, line long").repartition("key")
    rows = rows.sortWithinPartitions("key", F.col("line").bitwiseAND(F.lit(1)).desc())
    members = materialise(rows.mapInArrow(_met, "key long, line long").distinct(), "met")
    wanted = members.select(F.col("line").alias("w")).distinct()
    if members.count() <= BROADCAST_ROWS:  # checked; otherwise the lines are shuffled
        wanted = F.broadcast(wanted)
    held = _lines(docs, text_col, least).join(wanted, F.col("line") == F.col("w"), "left_semi")
    held = held.groupBy(F.col("line").alias("t")).agg(F.first("text").alias("text"))
    heavy = materialise(members.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > chunk), "heavy")
    if many := heavy.count():
        small = F.broadcast(heavy) if many <= BROADCAST_ROWS else heavy
        dense = members.join(small, F.col("key") == F.col("k")).join(held, F.col("line") == F.col("t")).select("key", "line", "text")
        finer = dense.mapInArrow(_split_by_bags(most), "key long, line long")
        members = materialise(members.join(small, F.col("key") == F.col("k"), "left_anti").unionByName(finer), "finer")
    chunks = members.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("line"), F.col("chunks")).cast("int")
    groups = (
        members.join(chunks, F.col("key") == F.col("k"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "line")
        .join(held, F.col("line") == F.col("t"))
        .select("group", "line", "text")
    )
    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(_links_of_groups(most), "a long, b long")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=None, most: int = THRESHOLD, least: int = LEAST_CHARS,
    chunk: int = CHUNK,
) -> DataFrame:
    """docs' ``keep`` columns (default: all) and

    n_lines, n_dropped (long); kept_text: the text without the lines of which an earlier document or
    line holds a copy; kept_in: the ids, in order, of the documents that hold those first copies.
    """
    added = ("n_lines", "n_dropped", "kept_text", "kept_in")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("full"))
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind]  # maps have no order, and so no hash
    rows = rows.withColumns({"h": F.xxhash64(F.lit(SEED), *hashed), "g": F.xxhash64(F.lit(SEED + 1), *hashed)})
    least_used = max(least, most + 1)
    place = _lines(rows, "full", least_used, "id", F.xxhash64("full").alias("th"), "h", "g")
    place = materialise(place.select("line", "id", "th", "h", "g", "pos"), "lines")
    links = line_links(rows, "full", most, least, chunk)
    # What is joined is written first, so that Spark can split the rows of a very common line or class.
    classes = materialise(connected_components(links, "a", "b"), "classes")
    named = place.join(classes, F.col("line") == F.col("node"), "left").select(
        F.coalesce("root", "line").alias("cls"), "id", "th", "h", "g", "pos"
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "h", "g", "pos")
    firsts = named.groupBy("cls").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select(F.col("cls").alias("c"), "first"), "firsts")
    dropped = (
        named.join(firsts, F.col("cls") == F.col("c"))
        .where(order != F.col("first"))
        .groupBy(F.col("h").alias("d_h"), F.col("g").alias("d_g"))
        .agg(F.collect_set("pos").alias("gone"), F.array_sort(F.collect_set("first.id")).alias("kept_in"))
    )
    # Rows that agree in every column meet before their texts move; all but one of them are copies.
    own = [f"k{i}" for i in range(len(keep))]
    once = rows.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in (*own, "id", "full")), F.count("*").alias("copies"))
    out = once.join(dropped, (F.col("h") == F.col("d_h")) & (F.col("g") == F.col("d_g")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    lines, none = F.split("full", "\n"), F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")
    every = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.length(F.btrim(F.get(lines, i), F.lit(BLANKS))) >= least_used)
    copied = (F.col("copy") > 1) & F.col("full").isNotNull()
    out = out.withColumns({"gone": F.when(copied, every).otherwise(F.col("gone")), "kept_in": F.when(copied, F.when(F.size(every) > 0, F.array_compact(F.array("id"))).otherwise(none)).otherwise(F.col("kept_in"))})
    kept = F.when(F.col("gone").isNull(), F.col("full")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    )
    return out.select(
        *(F.col(c).alias(name) for c, name in zip(own, keep)),
        F.when(F.col("full").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
        F.coalesce("kept_in", none).alias("kept_in"),
    )
