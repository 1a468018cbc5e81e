"""A compressed radix (Patricia) trie over byte strings that can put subtrees on disk."""
from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, owner: list | None = None) -> None:
        self.edge, self.owner, self.children = edge, owner, None


class OwnerTrie:
    """Maps byte strings to [smallest rank, id, rows, tag]; holds about ``limit`` bytes in memory.

    Over the limit, the heaviest subtree below the first branching is written to a temporary file and
    leaves the tree; later strings of its prefix follow it there.  ``terminals`` reads such files
    back one by one, each into a trie of its own, and deletes them.
    """

    def __init__(self, limit: int = 64 << 20) -> None:
        self.limit, self.held = limit, 0
        self.root = Node(b"")
        self.spilled: dict[bytes, str] = {}

    def insert(self, key: bytes, rank: object, owner: object, rows: int, tag: object = None) -> None:
        for prefix, path in self.spilled.items():
            if key.startswith(prefix):
                with open(path, "ab") as out:
                    pickle.dump((key, rank, owner, rows, tag), out)
                return
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                node.children = node.children or {}
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + 200
                node, at = child, len(key)
                continue
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            n = _common(edge, key[at:at + len(edge)])
            middle = Node(edge[:n])
            child.edge = edge[n:]
            middle.children = {edge[n]: child}
            node.children[key[at]] = middle
            self.held += 200
            node, at = middle, at + n
        own = node.owner
        if own is None:
            node.owner = [rank, owner, rows, tag]
        else:
            own[2] += rows
            if rank < own[0]:
                own[0], own[1] = rank, owner
        if self.held > self.limit:
            self._spill()

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None:
                yield prefix, node.owner
            for child in (node.children or {}).values():
                stack.append((child, prefix + child.edge))

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + 200
            stack += (node.children or {}).values()
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.children and len(node.children) == 1 and node.owner is None:
            node = next(iter(node.children.values()))
            prefix += node.edge
        if not node.children or (len(node.children) == 1 and node.owner is None):
            return
        child = max(node.children.values(), key=self._weight)
        self.held -= self._weight(child)
        del node.children[child.edge[0]]
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as out:
            for key, own in self._walk(child, prefix + child.edge):
                pickle.dump((key, *own), out)
        self.spilled[prefix + child.edge[:1]] = path

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """(string, [rank, id, rows, tag]) of every distinct string; empties the trie."""
        yield from self._walk(self.root, b"")
        self.root, self.held = Node(b""), 0
        files, self.spilled = self.spilled, {}
        try:
            for path in files.values():
                part = OwnerTrie(self.limit)
                with open(path, "rb") as rows:
                    while True:
                        try:
                            part.insert(*pickle.load(rows))
                        except EOFError:
                            break
                os.remove(path)
                yield from part.terminals()
        finally:
            for path in files.values():
                if os.path.exists(path):
                    os.remove(path)
