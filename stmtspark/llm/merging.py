"""Exact BPE contraction of one long word with a heap of (rank, position)."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def contract(symbols: list, pair: Callable[[object, object], tuple[int, object] | None]) -> list:
    """Contract the leftmost pair of minimum rank until none is left.

    ``pair(a, b)`` gives (rank, merged symbol), or None where a and b do not merge.
    """
    n = len(symbols)
    symbols = list(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def at(i: int) -> tuple[int, object] | None:
        return pair(symbols[i], symbols[after[i]]) if after[i] < n else None

    heap = [(m[0], i) for i in range(n) if (m := at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i] or (m := at(i)) is None or m[0] != rank:
            continue
        j = after[i]
        symbols[i], alive[j], after[i] = m[1], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (m := at(k)) is not None:
                heapq.heappush(heap, (m[0], k))
    return [x for x, a in zip(symbols, alive, strict=True) if a]
