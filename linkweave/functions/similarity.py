"""String similarities for pairs, in Arrow batches: ratios of 0 to 100, Jaro-Winkler of 0 to 1.

ratio is twice the longest common subsequence over both lengths, found bit-parallel on Python integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 100.0
    return 200.0 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer of its length, cut at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, known, best = len(a), set(a), 0.0
    for s in range(1 - n, len(b)):
        w = b[max(s, 0) : s + n]
        edge = w[-1] if s + n <= len(b) else w[0]
        if edge in known and 200.0 * min(n, len(w)) / (n + len(w)) > best:
            best = max(best, ratio(a, w))
            if best == 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 100.0
    left, right, shared = (" ".join(sorted(s)) for s in (x - y, y - x, both))
    if not shared:
        return ratio(left, right)
    first, second = f"{shared} {left}", f"{shared} {right}"
    return max(ratio(first, second), ratio(shared, first), ratio(shared, second))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    for i, c in enumerate(a):
        free = places.get(c)
        while free and free[-1] < i - reach:  # behind the window for every later i too
            free.pop()
        if free and free[-1] <= i + reach:
            taken[free.pop()] = True
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def of_columns(kernel: Callable[[str, str], float]):
    """A column function of two string columns; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen = lru_cache(maxsize=1 << 14)(kernel)
        return pd.Series([seen(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


core_ratio, core_partial, core_tsort, core_tset, core_jw = map(of_columns, (ratio, partial_ratio, token_sort_ratio, token_set_ratio, jaro_winkler))
