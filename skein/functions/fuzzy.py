"""String similarity in Arrow batches: what no built-in expresses."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, 0 to 1; null if either side is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over the sum of lengths."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    # Bit-parallel longest common subsequence (Hyyrö, 2004).
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    size = len(short)
    best = max((indel_ratio(short, long[i : i + size]) for i in range(len(long) - size + 1)), default=0.0)
    ends = [long[:i] for i in range(1, size)] + [long[-i:] for i in range(1, size)]
    return max([best, *(indel_ratio(short, e) for e in ends)])


def _tokens(a: str, b: str, ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(first, second), *((ratio(both, first), ratio(both, second)) if both else (0.0,)))


def weighted_ratio(a: str, b: str) -> float:
    """Weighted composite, 0 to 100: plain, sorted tokens and token sets; for texts of very unlike length also parts."""
    if not a or not b:
        return 0.0
    scale = max(len(a), len(b)) / min(len(a), len(b))
    ends = indel_ratio(a, b)
    ordered = (" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if scale < 1.5:
        return max(ends, 0.95 * max(indel_ratio(*ordered), _tokens(a, b, indel_ratio)))
    part = 0.9 if scale <= 8 else 0.6
    return max(ends, part * partial_ratio(a, b), 0.95 * part * max(partial_ratio(*ordered), 100.0 if set(a.split()) & set(b.split()) else partial_ratio(a, b)))
