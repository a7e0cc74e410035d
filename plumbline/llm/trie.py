"""A prefix tree over sorted sets and its overlap join."""

from __future__ import annotations

import numpy as np


class Node:
    """A run of tokens that all sets below share, and the sizes of those sets."""

    __slots__ = ("run", "children", "sets", "least", "most")

    def __init__(self, run: np.ndarray, size: int):
        self.run, self.children, self.sets, self.least, self.most = run, {}, [], size, size

    def widen(self, size: int) -> None:
        self.least, self.most = min(self.least, size), max(self.most, size)


class Trie:
    """Sets as sorted sequences in one order; sequences with a common beginning share its nodes."""

    def __init__(self):
        self.root = Node(np.empty(0, np.uint64), 1 << 62)
        self.root.most = 0

    def add(self, name: int, tokens: np.ndarray) -> None:
        node, at, size = self.root, 0, len(tokens)
        node.widen(size)
        while at < size:
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = Node(tokens[at:], size)
                node, at = child, size
                break
            n = min(len(child.run), size - at)
            differs = child.run[:n] != tokens[at : at + n]
            same = int(differs.argmax()) if differs.any() else n
            if same < len(child.run):  # the run ends here and goes on in a node of its own
                rest = Node(child.run[same:], 0)
                rest.children, rest.sets, rest.least, rest.most = child.children, child.sets, child.least, child.most
                child.run, child.children, child.sets = child.run[:same], {int(rest.run[0]): rest}, []
            child.widen(size)
            node, at = child, at + same
        node.sets.append(name)

    def similar(self, tokens: np.ndarray, percent: int, wanted=lambda name: True) -> list[int]:
        """The sets with ``100 * intersection >= percent * union``.

        The overlap of a run is counted once for all sets below it. A node is left when even
        taking all that remains, of the query or of the largest set below, the smallest set
        below could not be similar enough.
        """
        size, found = len(tokens), []
        stack = [(child, 0, 0, 0) for child in self.root.children.values()]
        while stack:
            node, overlap, depth, passed = stack.pop()
            if 100 * node.most < percent * size or 100 * size < percent * node.least:
                continue
            need = percent * (size + node.least)
            if (100 + percent) * (overlap + min(size - passed, node.most - depth)) < need:
                continue
            at = np.searchsorted(tokens, node.run)
            inside = at < size
            overlap += int((tokens[at[inside]] == node.run[inside]).sum())
            depth += len(node.run)
            passed = int(np.searchsorted(tokens, node.run[-1], side="right"))
            for name in node.sets:
                if (100 + percent) * overlap >= percent * (size + depth) and wanted(name):
                    found.append(name)
            if node.children and (100 + percent) * (overlap + min(size - passed, node.most - depth)) >= need:
                stack.extend((child, overlap, depth, passed) for child in node.children.values())
        return found
