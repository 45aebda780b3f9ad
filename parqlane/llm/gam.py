"""Quality scores by a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Training goes round the features in turn;
each visit fits a shallow tree (up to four leaves) on that feature's bins to the logistic loss's
gradients and adds it to the feature's lookup table. Then the pairs of features whose joint bins
explain most of what is left get tables in the same way, from trees of one cut a side. A score is
the logistic of a sum of table entries, so scoring is a few lookups a document, and a table shows
what each feature adds.

Training takes labelled rows only, at most ``FIT_ROWS`` of them, those with the smallest seeded hash
of the id; the features of these rows alone reach the driver. Every row is scored, task by task.

Defined cases: null text counts as empty and is scored like any text; labels other than 0 and 1 and
null labels or ids aren't used; a repeated label row counts again; without rows of both labels
every score is the smoothed share of label 1; an empty table gives an empty table; columns named
like an output are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parqlane.llm.common import SEED, map_columns, smallest

FIT_ROWS, THRESHOLD = 20_000, 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "spaces", "newlines", "other_ascii_space", "exclamation", "stops", "commas",
    "marks", "symbols", "bars", "quotes", "brackets", "slashes", "control", "non_ascii", "entropy", "distinct_words", "top_word",
    "distinct_lines", "short_words", "long_words", "capital_words", "log_line_words", "repeated_next",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" ", "newlines": b"\n", "other_ascii_space": b"\t\r\x0b\x0c",
    "exclamation": b"!", "stops": b".", "commas": b",", "marks": b"?;:", "symbols": b"#$%&*+=@^~", "bars": b"|", "quotes": b"\"'`",
    "brackets": b"()[]{}<>", "slashes": b"/\\_-", "control": bytes([*range(9), *range(14, 32), 127]), "non_ascii": bytes(range(128, 256)),
}
_SUMS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _SUMS[list(_members), _k] = 1


def features(text: str | None) -> list[float]:
    """FEATURES of one text; all are 0 or finite for any text."""
    text = text or ""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = max(1, len(data)), text.split(), [x for x in text.split("\n") if x.strip()]
    share = (counts @ _SUMS) / n
    p = counts[counts > 0] / n
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    top = Counter(words).most_common(1)
    distinct = len(set(words))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        lengths.mean() if len(words) else 0.0,
        *share,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        distinct / w,
        top[0][1] / w if top else 0.0,
        len(set(lines)) / max(1, len(lines)),
        float((lengths <= 3).mean()) if len(words) else 0.0,
        float((lengths >= 13).mean()) if len(words) else 0.0,
        sum(map(str.isupper, words)) / w,
        np.log1p(len(words) / max(1, len(lines))),
        sum(a == b for a, b in zip(words, words[1:])) / w,
    ]


@dataclass
class Model:
    """edges: cuts of each feature; tables: entries by bin; pairs: (a, b, coarse cuts of both, entries)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            out += table[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; place 0 if there is none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((hl >= least) & (hr >= least), gain, 0.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 1e-9 else (0.0, 0)


def _tree(g, h, ridge, least) -> np.ndarray:
    """What a tree of up to four leaves adds to each bin."""
    leaves = [(0, len(g))]
    for _ in range(2):
        cut = []
        for lo, hi in leaves:
            at = _best_cut(g[lo:hi], h[lo:hi], ridge, least)[1]
            cut += [(lo, lo + at), (lo + at, hi)] if at else [(lo, hi)]
        leaves = cut
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _cross(g, h, ridge, least) -> tuple[float, np.ndarray]:
    """Gain and entries of the best cut of both sides of a grid of bins."""
    best = (0.0, np.zeros_like(g))
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))

    def quarters(c):
        a, b = c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1]
        return a, b, c[-1:, 1:-1] - a, c[-1, -1] - c[-1:, 1:-1] - b

    if min(g.shape) < 2:
        return best
    gq, hq = quarters(cg), quarters(ch)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gq, hq)) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where(np.min(np.stack(hq), axis=0) >= least, gain, 0.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 1e-9:
        return best
    out = np.zeros_like(g)
    for (rows, columns), a, b in zip(
        ((slice(i + 1), slice(j + 1)), (slice(i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(j + 1)), (slice(i + 1, None), slice(j + 1, None))),
        gq, hq,
    ):
        out[rows, columns] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds=120, rate=0.1, bins=32, pairs=8, coarse=8, pair_rounds=60, ridge=1.0, least=2.0) -> Model:
    """Deterministic; y holds 0 and 1."""
    n, ones = len(y), float(y.sum())
    model = Model(float(np.log((ones + 1) / (n - ones + 1))))
    if not 0 < ones < n:
        return model
    cuts = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    model.edges = [cuts(x[:, k], bins) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    places = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    raw = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for place, table in zip(places, model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(place, g, len(table)), np.bincount(place, h, len(table)), ridge, least)
            table += step
            raw += step[place]

    few = [cuts(x[:, k], coarse) for k in range(x.shape[1])]
    seats = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(few)]

    def grid(a, b, v):
        shape = (len(few[a]) + 1, len(few[b]) + 1)
        return np.bincount(seats[a] * shape[1] + seats[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted((-_cross(grid(a, b, g), grid(a, b, h), ridge, least)[0], a, b) for a, b in combinations(range(x.shape[1]), 2))
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain < 0]
    added = {ab: np.zeros((len(few[ab[0]]) + 1, len(few[ab[1]]) + 1)) for ab in chosen}
    for _ in range(pair_rounds):
        for (a, b), table in added.items():
            g, h = slopes()
            step = rate * _cross(grid(a, b, g), grid(a, b, h), ridge, least)[1]
            table += step
            raw += step[seats[a], seats[b]]
    model.pairs = [(a, b, few[a], few[b], table) for (a, b), table in added.items()]
    return model


def held_out(id_col):
    """The fold that no label is learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", fit_rows=FIT_ROWS, seed=SEED) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    usable = usable.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    chosen = smallest(usable, fit_rows, F.xxhash64(F.lit(seed), "id"), "id", "y")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))  # at most fit_rows ids
    made = map_columns(rows, ["text"], lambda: lambda texts: [[[float(v) for v in features(t)] for t in texts]], [("x", "array<double>")], ["id", "y"])
    got = made.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "y", "x").limit(fit_rows).toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", keep=None, name: str = "score") -> DataFrame:
    """docs' ``keep`` columns (default: all) and the score, 0 to 1."""

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))]

    return map_columns(docs, [text_col], make, [(name, "double")], keep)
