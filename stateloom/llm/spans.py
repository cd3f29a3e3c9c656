"""Sets of text intervals that answer overlap questions in logarithmic time."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort


class Taken:
    """Intervals that don't overlap, half-open; overlapping ones given at the start are merged."""

    def __init__(self, intervals=()):
        self._at: list[tuple[int, int]] = []
        for i, j in sorted(intervals):
            if self._at and i < self._at[-1][1]:
                self._at[-1] = (self._at[-1][0], max(j, self._at[-1][1]))
            else:
                self._at.append((i, j))

    def overlaps(self, i: int, j: int) -> bool:
        k = bisect_left(self._at, (j, j))
        return k > 0 and self._at[k - 1][1] > i

    def add(self, i: int, j: int) -> None:
        """Add an interval that overlaps none."""
        insort(self._at, (i, j))


class Held:
    """Intervals, of which those inside another one are forgotten: starts and ends both rise."""

    def __init__(self):
        self._starts: list[int] = []
        self._ends: list[int] = []

    def covers(self, i: int, j: int) -> bool:
        """Whether i..j lies inside a single interval."""
        k = bisect_right(self._starts, i)
        return k > 0 and self._ends[k - 1] >= j

    def add(self, i: int, j: int) -> None:
        """Add an interval that lies inside none."""
        k = bisect_left(self._starts, i)
        m = bisect_right(self._ends, j, k)
        self._starts[k:m], self._ends[k:m] = [i], [j]
