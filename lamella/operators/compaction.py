"""Size-tiered choice of layers to merge."""

from __future__ import annotations


def pick_tier(sizes: list[int], cap: int) -> tuple[int, int] | None:
    """[first, last) of the layers to merge, ``sizes`` from the oldest to the newest; None if no tier is worth it.

    From the newest layer on, the next older one joins while it is at most four times what has been gathered; a tier needs
    two layers. With ``cap`` layers or more all are merged.
    """
    n = len(sizes)
    if n >= cap:
        return (0, n) if n > 1 else None
    if n < 2:
        return None
    first, gathered = n - 1, sizes[-1]
    while first > 0 and sizes[first - 1] <= 4 * gathered:
        first -= 1
        gathered += sizes[first]
    return (first, n) if n - first >= 2 else None


def tier_or_all(sizes: list[int], threshold: int) -> tuple[int, int] | None:
    """What a store merges once it has ``threshold`` layers: a tier, or all layers where there is none."""
    if len(sizes) < 2:
        return None
    return pick_tier(sizes, 2 * max(threshold, 2)) or (0, len(sizes))
