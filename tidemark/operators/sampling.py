"""Sizes of a stratified draw."""

from __future__ import annotations


def proportional_sizes(pools: dict[str, int], total: int) -> dict[str, int]:
    """Rows per stratum in proportion to its pool, by largest remainder; one at least where ``total`` allows it.

    No stratum gets more than its pool. Ties go to the name that sorts first. With fewer rows than strata the largest
    strata get one each.
    """
    pools = {k: n for k, n in pools.items() if n > 0}
    want = min(max(total, 0), sum(pools.values()))
    if not want:
        return {}
    largest = sorted(pools, key=lambda k: (-pools[k], k))
    if want < len(pools):
        return dict.fromkeys(largest[:want], 1)
    whole = sum(pools.values())
    sizes = {k: max(1, want * n // whole) for k, n in pools.items()}
    while sum(sizes.values()) > want:  # the floors of one may overshoot
        sizes[min((k for k in sizes if sizes[k] > 1), key=lambda k: (-sizes[k], k))] -= 1
    by_rest = sorted(pools, key=lambda k: (-(want * pools[k] % whole), k))
    while (short := want - sum(sizes.values())) > 0:
        for k in [k for k in by_rest if sizes[k] < pools[k]][:short]:
            sizes[k] += 1
    return sizes
