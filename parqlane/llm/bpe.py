"""Byte-level BPE in linear time: encoding, decoding and token counts at every prefix.

Tokens are byte strings, kept as Latin-1 text in an Aho-Corasick automaton. A sequence of tokens is
what the merges would give exactly if each adjacent pair is compatible, that is, if the merges of
the two tokens' bytes give these two tokens. So

* encoding walks from the longest match at each position, takes a shorter prefix token where the
  pair is not compatible, and steps back where none is left; each position is given up at most once;
* counting finds for each prefix the one token that can end it (compatible with the last token of
  what stands before it), so the count at each prefix is one more than at an earlier prefix.

A text is cut where one plain space stands between two characters that aren't white space; no match
of the byte-level pattern reaches over such a place. The pieces repeat, so their results are memoised,
within a bound; a piece that isn't in the memo is computed, so the bound changes nothing but time.
With another pattern, or with a special string that holds white space, texts aren't cut.

Counts at every prefix are stored as steps, the difference that each character makes: one signed byte
a character (four where one doesn't do), after a byte that tells how many. ``counts_of`` gives the
counts again, and ``counts_at`` and ``fitting`` answer questions about cuts and budgets from the
column, without the text and without encoding anything.

Both operators go row by row, without shuffle. Defined cases: null text counts as empty; repeated rows
repeat; an empty table gives an empty table; columns of docs named like an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from array import array
from itertools import accumulate, chain, pairwise
from operator import sub

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from parqlane.llm.common import map_columns

MEMO_ENTRIES = 300_000
MEMO_PAIRS = 2_000_000
MEMO_CHARS = 200
LIMIT = 512
MEMO_MATCHES = 100_000
#: White space but for single spaces, whose count is that of any match's first character.
_WIDE_SPACE = regex.compile(r"\s{2,}|[^\S ]")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def plain(word: str) -> bool:
    """Letters of the first Latin blocks only, on which all Unicode versions agree."""
    return word.isalpha() and max(word) < "\u0250"


class Irregular(Exception):
    """White space other than single spaces stands at an end of a piece."""


class _Memo(dict):
    """Results of pieces; lead stands before each piece, and if there is one, pieces must be regular.

    When full, the memo becomes the old one, from which pieces that come again are taken over.
    """

    def __init__(self, compute, lead=""):
        self.compute, self.lead, self.old = compute, lead, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            if self.lead and (not piece or piece[0].isspace() or piece[-1].isspace()):
                raise Irregular
            value = self.compute(self.lead + piece)
            if len(piece) > MEMO_CHARS:
                return value
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class Vocabulary:
    """Tokens by id, ids in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None):
        self.ids = ranks
        self.tokens = dict(sorted((i, t) for t, i in ranks.items()))
        self.specials = specials or {}
        self.pattern = regex.compile(pattern)
        self.special_pattern = (
            re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        )
        self.automaton = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.latin = {t.decode("latin-1"): i for i, t in self.tokens.items()}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        self.longest_token = max(self.sizes.values())
        self.shorter = {i: self._longest_proper_prefix(t) for i, t in self.tokens.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.memo_pairs: dict[tuple[int, int], bool] = {}
        self.memo_counts: dict[str, list[int]] = {}
        for i, t in self.tokens.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self.compatible(a, b):
                    self.halves[i] = (a, b)
                    self.merged[a, b] = i
                    break
        self.memo_pairs.clear()

    def _longest_proper_prefix(self, token: bytes) -> int | None:
        for k in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:k])) is not None:
                return i
        return None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of a and b keep the border between them."""
        known = self.memo_pairs.get((a, b))
        if known is None:
            if len(self.memo_pairs) >= MEMO_PAIRS:
                self.memo_pairs.clear()
            known = self.memo_pairs[a, b] = self._border_stays(a, b)
        return known

    def _border_stays(self, a: int, b: int) -> bool:
        # Undo merges from the last: left and right stand at the border until rank `end` (merges at
        # equal rank run from the left, so an equal rank on the right side comes too late).
        left, right, end = a, b, float("inf")
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < end:
                return False
            parts_left, parts_right = self.halves.get(left), self.halves.get(right)
            if parts_left is None and parts_right is None:
                return True
            if parts_right is None or (parts_left is not None and left > right):
                end, left = left, parts_left[1]
            else:
                end, right = right + 1, parts_right[0]

    def _longest(self, text: str) -> int:
        """The longest token that the Latin-1 text starts with."""
        size = self.automaton.longest_prefix(text[: self.longest_token])
        while (i := self.latin.get(text[:size])) is None:
            size -= 1
        return i

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        text = piece.decode("latin-1")
        if (whole := self.latin.get(text)) is not None:
            return [whole]
        n, sizes, shorter, pairs, reach = len(text), self.sizes, self.shorter, self.memo_pairs, self.longest_token
        out: list[int] = []
        given_up: set[int] = set()
        at, token, last = 0, self._longest(text), None
        while at < n:
            after = at + sizes[token]
            if after not in given_up:
                fits = last is None or pairs.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    at, last = after, token
                    if at < n:
                        token = self._longest(text[at : at + reach])
                    continue
            token = shorter[token]
            while token is None:  # nothing can follow what ends here: take a shorter token before it
                given_up.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
                last = out[-1] if out else None
        return out

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of one match of the pattern."""
        n = len(piece)
        count, last = [0] * (n + 1), [None] * (n + 1)
        compatible = self.compatible
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - size
                before = last[start]
                if start == 0 or (before is not None and compatible(before, i)):
                    last[end], count[end] = i, count[start] + 1
        return count

    def split_specials(self, text: str):
        """(text, special id or None) in order."""
        if self.special_pattern is None or not text:
            return [(text, None)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.specials[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def encode_run(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part, special in self.split_specials(text):
            if special is not None:
                ids.append(special)
            else:
                for m in self.pattern.findall(part):
                    ids += self.encode_piece(m.encode())
        return tuple(ids)

    def count_run(self, text: str) -> int:
        total = 0
        for part, special in self.split_specials(text):
            if special is not None:
                total += 1
            else:
                for m in self.pattern.findall(part):
                    b = m.encode()
                    total += 1 if b in self.ids else self.piece_counts(b)[-1]
        return total

    def run_counts(self, text: str) -> list[int]:
        """Token counts of the first 0, 1, ... characters of a text that stands between safe cuts."""
        out, part, borders = [0], "", [(0, 0)]
        for piece, special in self.split_specials(text):
            base = out[-1]
            if special is None:
                counts, borders = self._plain_counts(piece)
                out += [base + c for c in counts[1:]]
                part, before = piece, base
                continue
            # Prefixes that end inside a special string hold a part of it as plain text. It can only
            # change the matches from the last border that stands.
            at, count = borders[-1]
            out += [before + count + self.count_run(part[at:] + piece[:k]) for k in range(1, len(piece))]
            out.append(base + 1)
            part, before, borders = "", base + 1, [(0, 0)]
        return out

    def _plain_counts(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """run_counts of a text without special strings, and (place, tokens before it) of the borders
        of matches that stand whatever follows the text."""
        out, borders, n, base = [0], [(0, 0)], len(text), 0
        for match in self.pattern.findall(text):  # the matches cover the text
            counts, at = self.counts_of_match(match), len(out) - 1
            if borders[-1][0] <= n - 3 and at:  # no contraction, the longest look ahead, is cut
                borders.append((at, base))
            if match[0] == "'" and len(match) > 1 and match[1].isalpha():  # a cut contraction isn't one
                out += [base + self.count_run(match[:k]) for k in range(1, len(match))]
                out.append(base + counts[-1])
            else:
                out += [base + c for c in counts]
            base += counts[-1]
        # A prefix that ends in white space has its last white space in one match.
        for m in _WIDE_SPACE.finditer(text):
            before = out[m.start()]
            for k, c in enumerate(self.counts_of_match(m[0]), m.start() + 1):
                out[k] = before + c
        return out, borders

    def counts_of_match(self, match: str) -> list[int]:
        """Token counts of the first 1, 2, ... characters of one match of the pattern."""
        known = self.memo_counts.get(match)
        if known is None:
            known = self.piece_counts(match.encode())
            if match.isascii():
                del known[0]
            else:
                known = [known[k] for k in accumulate(len(c.encode()) for c in match)]
            if len(match) <= MEMO_CHARS:
                if len(self.memo_counts) >= MEMO_MATCHES:
                    self.memo_counts.clear()
                self.memo_counts[match] = known
        return known


def as_steps(counts) -> bytes:
    """Differences of neighbours, a signed byte each; OverflowError if one doesn't fit."""
    return array("b", map(sub, counts[1:], counts)).tobytes()


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts of the first 0, 1, ... characters from the stored steps."""
    made = np.frombuffer(steps, f"<i{steps[0]}", offset=1)
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(made, dtype=np.int64)))


def fit_of(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(steps) <= max(0, budget))[-1])


#: The pattern that byte-level tokenizer files imply when they ask for "use_regex". Fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """A vocabulary with memos of the pieces between safe cuts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: Whether texts may be cut at single spaces, and words of letters taken as one match.
        self.cuts = vocabulary.pattern.pattern == BYTE_LEVEL_PATTERN and not any(re.search(r"\s", x) for x in vocabulary.specials)
        self.first = _Memo(vocabulary.encode_run)
        self.rest = _Memo(self._encode_word, " ")
        self.first_steps = _Memo(lambda text: as_steps(vocabulary.run_counts(text)))
        self.rest_steps = _Memo(self._word_steps, " ")
        ids = [*vocabulary.tokens, *vocabulary.specials.values()]
        self.said = [str(i) for i in range(max(ids) + 1)]
        self.bytes = [vocabulary.tokens.get(i, b"") for i in range(max(ids) + 1)]
        for text, i in vocabulary.specials.items():
            self.bytes[i] = text.encode()

    # A word of plain letters is one match of the pattern; so is a mark after it.
    def _encode_word(self, text):
        word = text[1:]
        if plain(word):
            return tuple(self.vocabulary.encode_piece(text.encode()))
        if word[-1] in ".,;:!?" and plain(word[:-1]):
            return (*self.rest[word[:-1]], self.vocabulary.latin[word[-1]])
        return self.vocabulary.encode_run(text)

    def _word_steps(self, text):
        word = text[1:]
        if plain(word):
            return as_steps([0, *self.vocabulary.counts_of_match(text)])
        if word[-1] in ".,;:!?" and plain(word[:-1]):
            return self.rest_steps[word[:-1]] + b"\1"
        return as_steps(self.vocabulary.run_counts(text))

    def _each(self, text: str, first: _Memo, rest: _Memo) -> list:
        if not text:
            return []
        if not self.cuts:
            return [first.compute(text)]
        head, *tail = text.split(" ")
        try:
            if not head or head[-1].isspace():
                raise Irregular
            return [first[head], *map(rest.__getitem__, tail)]
        except Irregular:
            head, *tail = _SAFE_CUT.split(text)
            return [first[head], *(rest[x] if x in rest else rest.compute(" " + x) for x in tail)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._each(text, self.first, self.rest)))

    def decimal(self, ids) -> str:
        """The ids as decimal numbers joined by single spaces."""
        return " ".join(map(self.said.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def steps(self, text: str) -> bytes:
        """The counts at every prefix, as steps."""
        try:
            return b"\1" + b"".join(self._each(text, self.first_steps, self.rest_steps))
        except OverflowError:
            wide = []
            for k, piece in enumerate(_SAFE_CUT.split(text) if self.cuts else [text]):
                wide += [b - a for a, b in pairwise(self.vocabulary.run_counts(" " * (k > 0) + piece))]
            return b"\4" + np.array(wide, "<i4").tobytes()

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of the first 0, 1, ... len(text) characters."""
        return counts_of(self.steps(text)).tolist()

    def count(self, text: str) -> int:
        steps = self.steps(text)
        return int(np.frombuffer(steps, f"<i{steps[0]}", offset=1).sum(dtype=np.int64))


@functools.lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str) -> Coder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return Coder(Vocabulary(ranks, pattern))


def printable_bytes() -> dict[str, int]:
    """The characters by which byte-level tokenizer files write bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def from_json(path: str) -> Coder:
    """From a tokenizers file of a byte-level BPE model without normaliser or added prefix space."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or file["normalizer"] or not pre.get("use_regex", True):
        raise ValueError("only plain byte-level models are handled")
    byte = printable_bytes()
    specials = {x["content"]: x["id"] for x in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in specials}
    order = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in file["model"]["merges"]]
    if order != sorted(order) or len(set(order)) != len(order):
        raise ValueError("ids are not in the order of the merges")
    return Coder(Vocabulary(ranks, BYTE_LEVEL_PATTERN, specials))


def encode_and_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    keep=None,
    outputs=("n_tokens", "token_ids", "decoded"),
) -> DataFrame:
    """docs' ``keep`` columns (default: all) and the outputs asked for.

    n_tokens long; token_ids array<int>; decoded binary (the ids decoded again); ids_sha256 and
    decoded_sha256, the hex digests of the ids in decimal joined by spaces and of decoded. Null
    text counts as empty: no ids, empty bytes.
    """
    kinds = {"n_tokens": "long", "token_ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}

    def make():
        coder = from_ranks(path, pattern)

        def work(texts):
            made = {k: [] for k in outputs}
            for text in texts:
                ids = coder.encode(text or "")
                decoded = coder.decode(ids) if "decoded" in made or "decoded_sha256" in made else None
                for k, column in made.items():
                    if k == "n_tokens":
                        column.append(len(ids))
                    elif k == "token_ids":
                        column.append(ids)
                    elif k == "decoded":
                        column.append(decoded)
                    elif k == "ids_sha256":
                        column.append(hashlib.sha256(coder.decimal(ids).encode()).hexdigest())
                    else:
                        column.append(hashlib.sha256(decoded).hexdigest())
            return [made[k] for k in outputs]

        return work

    return map_columns(docs, [text_col], make, [(k, kinds[k]) for k in outputs], keep)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text", keep=None) -> DataFrame:
    """docs' ``keep`` columns (default: all), n_bytes, n_tokens, over_limit, fit_chars and prefix_steps.

    prefix_steps: the exact token count at every prefix, as steps (binary); all else comes from it.
    fit_chars: length of the longest prefix of at most ``limit`` tokens. Special strings in texts
    count as the file's special tokens. Null text counts as empty: 0 tokens.
    """
    fields = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"), ("fit_chars", "long"), ("prefix_steps", "binary")]

    def make():
        coder = from_json(path)

        def work(texts):
            rows = []
            for text in texts:
                text = text or ""
                steps = coder.steps(text)
                n = int(np.frombuffer(steps, f"<i{steps[0]}", offset=1).sum(dtype=np.int64))
                rows.append((len(text.encode()), n, n > limit, fit_of(steps, limit) if n > limit else len(text), steps))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in fields]

        return work

    return map_columns(docs, [text_col], make, fields, keep)


def counts_at(counted: DataFrame, at_col: str, steps_col: str = "prefix_steps", name: str = "tokens_at", keep=None) -> DataFrame:
    """Token count of the first at_col characters of each text, from the stored steps.

    Null steps or places give null; a place beyond the text stands for its end, one below 0 for 0.
    """

    def make():
        def work(steps, places):
            return [[None if s is None or k is None else int(counts_of(s)[: max(0, k) + 1][-1]) for s, k in zip(steps, places)]]

        return work

    return map_columns(counted, [steps_col, at_col], make, [(name, "long")], keep)


def fitting(counted: DataFrame, budget: int, steps_col: str = "prefix_steps", name: str = "fit_chars", keep=None) -> DataFrame:
    """Characters of the longest prefix of each text within the budget, from the stored steps; null for null."""
    return map_columns(counted, [steps_col], lambda: lambda steps: [[None if s is None else fit_of(s, budget) for s in steps]], [(name, "long")], keep)
