"""Maximum-weight one-to-one assignment."""

from __future__ import annotations

import numpy as np


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of greatest total weight, min(rows, columns) of them:
    shortest augmenting paths over reduced costs, one row at a time."""
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights).astype(float)
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        distance, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, reached, last = start, 0.0, -1
        while True:
            step = reached + cost[row] - row_price[row] - column_price
            better = ~done & (step < distance)
            distance[better], via[better] = step[better], last
            column = int(np.where(done, np.inf, distance).argmin())
            reached, done[column], last = distance[column], True, column
            if owner[column] < 0:
                break
            row = owner[column]
        shift = np.where(done, reached - distance, 0.0)
        column_price -= shift
        row_price[start] += reached
        held = done & (owner >= 0)
        row_price[owner[held]] += shift[held]
        while last >= 0:  # hand the columns along the path on
            previous = via[last]
            owner[last] = start if previous < 0 else owner[previous]
            last = previous
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)
