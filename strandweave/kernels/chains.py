"""Longest increasing subsequences by weight."""

from __future__ import annotations

import bisect


class _MaxTree:
    """Largest (weight, position) over a prefix of ranks."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            self.best[rank] = max(self.best[rank], value)
            rank += rank & -rank

    def under(self, rank: int) -> tuple[float, int]:
        out = (0.0, -1)
        while rank > 0:
            out = max(out, self.best[rank])
            rank -= rank & -rank
        return out


def heaviest_increasing(order: list[int], weight: list[float], repeats: str = "first") -> tuple[float, list[int]]:
    """(total, positions) of the heaviest strictly increasing subsequence; of equal totals the one that ends last.

    ``repeats`` says what a value that comes again does: "first" ignores it, "heavier" lets the heavier of both count, at
    the later place, "error" raises. O(n log n), by a tree of prefix maxima over the ranks of the values.
    """
    keep: dict[int, int] = {}
    for k, v in enumerate(order):
        if v not in keep:
            keep[v] = k
        elif repeats == "error":
            raise ValueError(f"{v} comes twice")
        elif repeats == "heavier":
            old = keep.pop(v)
            keep[v] = k if weight[k] > weight[old] else old
    places = list(keep.values())
    ranks = sorted(keep)
    tree, total, back = _MaxTree(len(ranks)), {}, {}
    best = (0.0, -1)
    for n, k in enumerate(places):
        r = bisect.bisect_left(ranks, order[k])
        before, at = tree.under(r)
        total[n], back[n] = before + weight[k], at
        tree.put(r, (total[n], n))
        best = max(best, (total[n], n))
    out, n = [], best[1]
    while n >= 0:
        out.append(places[n])
        n = back[n]
    return best[0], out[::-1]


def signed_chains(order: list[int], weight: list[float], repeats: str = "first") -> tuple[tuple[float, list[int]], tuple[float, list[int]]]:
    """Heaviest chains of the positive values, and of the negative ones (which increase where the block runs backwards)."""
    forward = [k for k, v in enumerate(order) if v > 0]
    reverse = [k for k, v in enumerate(order) if v < 0]
    out = []
    for at in (forward, reverse):
        total, chain = heaviest_increasing([order[k] for k in at], [weight[k] for k in at], repeats)
        out.append((total, [at[k] for k in chain]))
    return out[0], out[1]


def best_rotation(order: list[int], weight: list[float]) -> float:
    """The largest share of all weight that a chain of any rotation has, in either direction."""
    total = sum(weight)
    share = 0.0
    for k in range(len(order)):
        o, w = order[k:] + order[:k], weight[k:] + weight[:k]
        share = max(share, *(x[0] / total for x in signed_chains(o, w)))
    return share
