"""Parts of a batch that are worked on at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def runs(at: np.ndarray, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """The runs [first, end) of consecutive rows that have ``most`` entries together, or one row with more; row i has those from ``at[i]`` to ``at[i + 1]``. No run has more than ``rows``."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(int(np.searchsorted(at, at[first] + most, side="right")) - 1, first + 1)
        end = min(end, n if rows is None else first + rows)
        yield first, end
        first = end
