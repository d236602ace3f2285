"""Hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

from txnrisk.llm.common import code_points

_WHITE = np.zeros(0x3001, dtype=bool)
_WHITE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket numbers below 2**bits of all n-grams of the lower-cased text, repeats included.

    White space counts as spaces, and a space stands at either end; a text shorter than n has no n-gram
    of that order, an empty one has none at all.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = code_points(f" {text.lower()} ")
    points = np.where(_WHITE[np.minimum(points, 0x3000)], 32, points).astype(np.uint64)
    out, rolling = [], points
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(points) < n:
                break
            rolling = rolling[:-1] * _STEP + points[n - 1 :]
        if n in orders:
            out.append((((rolling + np.uint64(n)) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
