"""Ternary search trees over sorted sequences of numbers, with figures gathered bottom-up."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


def by_medians(n: int) -> Iterator[int]:
    """0..n-1 with the median of every range before the rest of it: sorted keys put in in this order stay balanced."""
    ranges = [(0, n)]
    while ranges:
        after = []
        for a, b in ranges:
            if a < b:
                mid = (a + b) // 2
                yield mid
                after += [(a, mid), (mid + 1, b)]
        ranges = after


class TernaryTree:
    """A forest of prefix trees; the children of a node are a binary search tree by their number.

    Nodes are numbered as they are made, so a node's parent has a smaller
    number: going through the numbers backwards meets children first, and no
    step needs recursion however deep a tree is.
    """

    def __init__(self):
        self.code, self.less, self.more, self.down, self.parent = [], [], [], [], []

    def __len__(self) -> int:
        return len(self.code)

    def root(self) -> int:
        return self._new(-1, -1)

    def _new(self, code: int, parent: int) -> int:
        self.code.append(code)
        self.parent.append(parent)
        for links in (self.less, self.more, self.down):
            links.append(-1)
        return len(self.code) - 1

    def child(self, node: int, code: int) -> int:
        """The child of ``node`` with ``code``, made if there is none."""
        at = self.down[node]
        if at < 0:
            self.down[node] = new = self._new(code, node)
            return new
        while (here := self.code[at]) != code:
            side = self.less if code < here else self.more
            if side[at] < 0:
                side[at] = new = self._new(code, node)
                return new
            at = side[at]
        return at

    def insert(self, root: int, sequence: Sequence[int]) -> list[int]:
        """The nodes along ``sequence``, the root first."""
        path = [root]
        for code in sequence:
            path.append(self.child(path[-1], code))
        return path

    def up(self, node: int) -> Iterable[int]:
        """A node and all above it."""
        while node >= 0:
            yield node
            node = self.parent[node]
