"""Repair of text that a scanner repeated or split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _same_for(a: np.ndarray, p: int, n: int, step: int) -> int:
    """How many positions from ``p`` on, going by ``step``, hold the token that lies ``n`` after them."""
    length, size = 0, 8
    while True:
        if step > 0:
            x, y = a[p + length:p + length + size], a[p + n + length:p + n + length + size]
            x = x[:len(y)]
        else:
            lo, hi = max(p - length - size + 1, 0), max(p - length + 1, 0)
            x, y = a[lo:hi][::-1], a[lo + n:hi + n][::-1]
        other = np.flatnonzero(x != y)
        if len(other):
            return length + int(other[0])
        length += len(x)
        if len(x) < size:
            return length
        size *= 2


def _first_repeat(a: np.ndarray, n: int, lo: int = 0, hi: int | None = None) -> int | None:
    """The leftmost place between ``lo`` and ``hi`` from which ``n`` tokens are said twice.

    Such a run holds one multiple of ``n``, so only these are looked at, and only equal ones are followed to both sides.
    """
    last = len(a) - 2 * n if hi is None else min(hi, len(a) - 2 * n)
    first = -(-lo // n) * n
    x, y = a[first:last + n:n], a[first + n:last + 2 * n:n]
    for k in np.flatnonzero(x[:len(y)] == y):
        p = first + int(k) * n
        before = _same_for(a, p - 1, n, -1) if p else 0
        start = max(p - before, lo)
        if start <= last and p - start + _same_for(a, p, n, 1) >= n:
            return start
    return None


def collapse(tokens: list[str]) -> list[str]:
    """Remove adjacent equal runs of tokens, shortest runs first and leftmost first, until none is left.

    After a run of n tokens is removed only spans that reach over the copy that stays are new, so shorter runs are looked
    for there alone. Without repeats the work is that of a sum of N / n over all n.
    """
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(t, len(codes)) for t in tokens], np.int64)
    kept = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.arange(0)
    a, n, lo = a[kept], 2, 0
    while n <= len(a) // 2:
        hit = _first_repeat(a, n, lo)
        if hit is None:
            n, lo = n + 1, 0
            continue
        while hit is not None:
            a, kept = np.delete(a, slice(hit, hit + n)), np.delete(kept, slice(hit, hit + n))
            lo = max(hit - 2 * n, 0)
            at, size, hit = hit, n, None
            for m in range(size // 2 + 1, size):
                hit = _first_repeat(a, m, max(at + size + 1 - 2 * m, 0), at - 1)
                if hit is not None:
                    n = m
                    break
    return [tokens[i] for i in kept]


@F.pandas_udf(StringType())
def _collapse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else " ".join(collapse(v.split())))


def clean_ocr(txt: Column) -> Column:
    """Join drop capitals (``E LECTRIC`` -> ``ELECTRIC``), then remove stuttered runs of words.

    The runs need a fixpoint over word spans, which no built-in expresses.
    """
    return _collapse(F.regexp_replace(txt, r"\b([A-Z])\s+([A-Z]+)\b", "$1$2"))
