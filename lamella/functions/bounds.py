"""Key bounds as predicates that reach the Parquet scan: only comparisons with literals, never a function of the key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.functions.model import to_bytes


def successor(prefix: bytes) -> bytes | None:
    """The least key above every key that begins with ``prefix``; None if there is no such key."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def bounds(start: str | bytes | None = None, end: str | bytes | None = None, prefix: str | bytes | None = None) -> tuple[bytes | None, bytes | None]:
    """[low, high) of a seek, a half-open range or a prefix; they may be combined."""
    low = to_bytes(start) if start is not None else None
    high = to_bytes(end) if end is not None else None
    if prefix is not None:
        p = to_bytes(prefix)
        low = max(low, p) if low is not None else p
        stop = successor(p)
        high = min(high, stop) if high is not None and stop is not None else high if stop is None else stop
    return low or None, high


def within(low: bytes | None, high: bytes | None, key: str = "key") -> Column:
    """low <= key < high, either side open if None."""
    test = F.lit(True)
    if low is not None:
        test = F.col(key) >= F.lit(bytearray(low))
    if high is not None:
        below = F.col(key) < F.lit(bytearray(high))
        test = test & below if low is not None else below
    return test


def touches(low: bytes | None, high: bytes | None, least: bytes | None, most: bytes | None) -> bool:
    """Whether a table whose keys run from ``least`` to ``most`` can have a key in [low, high)."""
    if least is None or (low is not None and high is not None and low >= high):
        return False
    return not ((high is not None and least >= high) or (low is not None and most < low))
