"""Word segmentation and Indel similarity: the two text functions that need a loop over characters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def best_split(text: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of most probable words; an unknown word, however long, counts the less the longer it is."""
    longest = max(map(len, counts), default=0)
    ten, unknown = math.log(10), math.log(10 / total)
    best, ahead = [(0.0, 0)], (0.0, 0)  # ahead: the start from which an unknown word up to here costs least
    for end in range(1, len(text) + 1):
        options = [(ahead[0] + unknown - ten * end, ahead[1])]
        for start in range(max(0, end - longest), end):
            if (n := counts.get(text[start:end])) is not None:
                options.append((best[start][0] + math.log(n / total), start))
        best.append(max(options))
        ahead = max(ahead, (best[end][0] + ten * end, end))
    out, end = [], len(text)
    while end:
        out.append(text[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


@F.pandas_udf(StringType())
def segment(text: pd.Series, counts: pd.Series, total: pd.Series) -> pd.Series:
    """Words of a compact text, joined by spaces, by the counts of its pieces (a map) and of all words."""
    split = lambda x, c, t: " ".join(best_split(x, dict(c or {}), max(1, int(t)))) if x else x
    return pd.Series([split(*row) for row in zip(text, counts, total, strict=True)], dtype=object)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table as the bits of one number, 0 where the length grows."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for y in b:
        if found := row & places.get(y, 0):
            row = (row + found | row - found) & full
    return len(a) - row.bit_count()


def window_ratio(a: str, b: str, diagonals: list[int] | None = None, edits: int = 0) -> float:
    """The best Indel ratio of ``a`` with a window of the longer ``b``: as long as ``a``, or shorter at either end. Empty texts are like nothing.

    With ``diagonals`` only windows that begin within ``edits`` of one of them are looked at, and with them those that stick out at the front.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << m) - 1
    if diagonals is None:
        starts = range(1 - m, n)
    else:
        starts = {s for d in diagonals for s in range(max(1 - m, d - edits), min(n - 1, d + edits) + 1)}
        if min(diagonals) <= edits:
            starts |= set(range(max(1 - m, -edits), 0))
    best = 0.0
    for start in starts:
        row, low, high = full, max(0, start), min(n, start + m)
        for y in b[low:high]:
            if found := row & places.get(y, 0):
                row = (row + found | row - found) & full
        best = max(best, 2.0 * (m - row.bit_count()) / (m + high - low))
    return best


def partial_likeness(a: str, b: str) -> float:
    """The shorter text against the best window of the longer one; equal lengths both ways."""
    if len(a) > len(b):
        a, b = b, a
    return max(window_ratio(a, b), window_ratio(b, a)) if len(a) == len(b) else window_ratio(a, b)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``partial_likeness`` of two texts, once for each distinct pair of a batch; null if one is."""
    seen: dict[tuple, float | None] = {}
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else partial_likeness(*pair)
    return pd.Series([seen[pair] for pair in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def partial_ratio_near(a: pd.Series, b: pd.Series, diagonals: pd.Series, edits: pd.Series) -> pd.Series:
    """``window_ratio`` of a shorter text near the places where pieces of it were found."""
    return pd.Series([window_ratio(x, y, list(map(int, d)), int(e)) for x, y, d, e in zip(a, b, diagonals, edits, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - insertions and deletions over both lengths; 1 for two empty texts."""

    def ratio(x, y):
        if x is None or y is None:
            return None
        return 2.0 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])
