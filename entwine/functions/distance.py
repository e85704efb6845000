"""Jaro-Winkler similarity.  Spark has no such function, so it is an Arrow UDF over distinct pairs.

``classic`` halves transpositions and always adds the prefix; two empty strings are 1.
``threshold`` rounds half the transpositions down and adds the prefix only above 0.7; two
empty strings are 0.  Both compare characters; ``in_bytes`` compares the bytes of UTF-8 instead,
as DuckDB's function does, so that an accented letter counts twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: str, b: str, classic: bool = True, in_bytes: bool = False) -> float:
    if in_bytes and not (a.isascii() and b.isascii()):
        a, b = (x.encode("utf-8", "surrogatepass").decode("latin-1") for x in (a, b))  # one character for each byte
    if not a and not b:
        return 1.0 if classic else 0.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, int] = {}  # of each character, its places in b as bits
    for j, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << j
    left, free, window = [], -1, (1 << reach + 1) - 1
    for i, ch in enumerate(a):
        near = places.get(ch, 0) & free & window
        if near:
            free ^= near & -near
            left.append(ch)
        window = window << 1 | 1 if i < reach else window << 1
    m = len(left)
    if not m:
        return 0.0
    taken = [ch for j, ch in enumerate(b) if not free >> j & 1]
    odd = sum(x != y for x, y in zip(left, taken, strict=True))
    moved = odd / 2 if classic else odd // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return score + 0.1 * prefix * (1 - score) if classic or score > 0.7 else score


def _over(classic: bool, in_bytes: bool):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else similarity(*pair, classic, in_bytes)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    # else Spark evaluates it once for a filter on its result and once more for the result
    return run.asNondeterministic()


def jaro_winkler(a: Column, b: Column, classic: bool = True, in_bytes: bool = False) -> Column:
    """Null where either is null."""
    return _over(classic, in_bytes)(a, b)
