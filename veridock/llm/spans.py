"""Finds in a text that don't overlap."""

from __future__ import annotations

from bisect import bisect_left


class Spans:
    """Spans without overlap, in order; what comes first stays."""

    def __init__(self):
        self.starts: list[int] = []
        self.found: list[tuple[str, int, int]] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.found[k - 1][2] <= start

    def add(self, kind: str, start: int, end: int) -> bool:
        """Whether the span was free and is now taken."""
        if not self.free(start, end):
            return False
        k = bisect_left(self.starts, end)
        self.starts.insert(k, start)
        self.found.insert(k, (kind, start, end))
        return True
