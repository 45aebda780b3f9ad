"""Edit distance up to a threshold by a banded bit-parallel recurrence.

A column of the distance table is kept only in the 2t + 1 rows around the diagonal, as two bit
vectors of vertical steps (+1 and -1); a text character moves the band one row down. The distance is
followed along the band's lowest row and, at the end, walked up to the pattern's last row.
"""

from __future__ import annotations


def _common(a: str, b: str, most: int, end: bool) -> int:
    """Length of the common start (or end) of a and b, up to ``most``, by halving."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        same = a[len(a) - mid :] == b[len(b) - mid :] if end else a[:mid] == b[:mid]
        lo, hi = (mid, hi) if same else (lo, mid - 1)
    return lo


def _banded(pattern: str, text: str, most: int) -> int:
    m, n = len(pattern), len(text)
    width = 2 * most + 1
    full, low = (1 << width) - 1, 1 << (width - 1)
    plus = full >> (most + 1) << (most + 1)  # column 0: rows 1..most step up, rows above are flat
    minus, score = 0, most  # the lowest row of column 0 is row `most`
    for j in range(1, n + 1):
        # Bit k of the band stands for row j - most + k.
        match, first, sign = 0, j - most, text[j - 1]
        for k in range(max(0, 1 - first), min(width, m - first + 1)):
            if pattern[first + k - 1] == sign:
                match |= 1 << k
        # The steps of column j - 1, moved so that bit k again stands for row j - most + k.
        plus_in, minus_in = (plus >> 1) | low, minus >> 1
        x = match | minus_in
        diagonal = ((((match & plus_in) + plus_in) ^ plus_in) | x) & full
        across_up = (minus_in | ~(plus_in | diagonal)) & full
        across_down = plus_in & diagonal
        score += not diagonal & low
        # Row r's step in column j needs the horizontal step of row r - 1; above the band it is +1.
        up, down = (across_up << 1 | 1) & full, (across_down << 1) & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
    for row in range(n + most, m, -1):
        bit = 1 << (row - (n - most))
        score -= bool(plus & bit) - bool(minus & bit)
    return score


def within(a: str, b: str, most: int) -> bool:
    """Whether a and b are at most ``most`` single-character edits apart."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    least = min(len(a), len(b))
    start = _common(a, b, least, False)
    end = _common(a, b, least - start, True)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= most
    return _banded(a, b, most) <= most
