"""Sequence similarity (SC-5, SC-6): the Ratcliff/Obershelp ratio.

The longest block two texts have in common is matched, then the parts left of
it and right of it, and so on; the ratio is twice the matched characters over
all characters. Of equally long blocks the one that starts first in the first
text counts, and there the one that starts first in the second.

Blocks are found by substring search, the length by bisection (a text that
shares a block of n characters shares one of every smaller size), so the work
is done by the runtime's own search and not character by character. Both
functions are not symmetric: from 200 characters of the second text on, the
standard library drops its popular characters ("autojunk"); such texts go to
``difflib``. This is the reference's behaviour and is kept.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: length from which the standard library drops popular characters.
AUTOJUNK = 200


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the block that counts."""
    short, long, swapped = (a, b, False) if len(a) <= len(b) else (b, a, True)
    least, most = 0, len(short)
    while least < most:
        n = (least + most + 1) // 2
        if any(short[i:i + n] in long for i in range(len(short) - n + 1)):
            least = n
        else:
            most = n - 1
    if not least:
        return 0, 0, 0
    starts = range(len(short) - least + 1)
    if not swapped:
        i = next(i for i in starts if short[i:i + least] in long)
        return i, long.find(short[i:i + least]), least
    i, j = min((i, j) for j in starts if (i := long.find(short[j:j + least])) >= 0)
    return i, j, least


def matched(a: str, b: str) -> int:
    """Characters in matched blocks."""
    total, parts = 0, [(a, b)]
    while parts:
        x, y = parts.pop()
        i, j, n = longest_block(x, y)
        if n:
            total += n
            parts += [(x[:i], y[:j]), (x[i + n:], y[j + n:])]
    return total


def ratio(a: str, b: str) -> float:
    """``2 * matched / all characters``, 1.0 for two empty texts."""
    if len(b) >= AUTOJUNK:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def name_score(a: str, b: str) -> int:
    """100 times the ratio as a whole number (half to even), 0 for an empty side."""
    return int(round(100 * ratio(a, b))) if a and b else 0


def _ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    return np.array([np.nan if x is None or y is None else ratio(x, y) for x, y in zip(a.tolist(), b.tolist())], np.float64)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SC-5: :func:`ratio` of two columns, compared as given (lower-case them
    first for the reference's score)."""
    return pd.Series(_ratios(a, b))


@F.pandas_udf(T.IntegerType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SC-6: :func:`name_score` of two columns; a NULL side scores 0."""
    return pd.Series([name_score(x or "", y or "") for x, y in zip(a.tolist(), b.tolist())], dtype="int32")
