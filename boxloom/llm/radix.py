"""An adaptive radix tree over keys of whole bytes.

Inner nodes grow through four layouts of 4, 16, 48 and 256 children, and hold the bytes that all keys below them
share (path compression). A key may end at an inner node, so that keys may begin one another.
"""

from __future__ import annotations

from collections.abc import Iterator

#: The end of a node where no key ends.
NONE = -1


class _Listed:
    """Children beside a list of their bytes, in order."""

    size = 0
    __slots__ = ("bytes", "below")

    def __init__(self):
        self.bytes, self.below = bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.below[at] if at >= 0 else None

    def put(self, byte: int, child) -> bool:
        """Add or replace a child; False if there is no room."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.below[at] = child
            return True
        if len(self.bytes) == self.size:
            return False
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.below.insert(at, child)
        return True

    def items(self) -> Iterator[tuple]:
        return zip(self.bytes, self.below)


class Four(_Listed):
    size = 4
    __slots__ = ()


class Sixteen(_Listed):
    size = 16
    __slots__ = ()


class FortyEight:
    """A place for each of 256 bytes that names one of at most 48 children."""

    size = 48
    __slots__ = ("place", "below")

    def __init__(self):
        self.place, self.below = bytearray(256), []

    def get(self, byte: int):
        at = self.place[byte]
        return self.below[at - 1] if at else None

    def put(self, byte: int, child) -> bool:
        at = self.place[byte]
        if at:
            self.below[at - 1] = child
            return True
        if len(self.below) == self.size:
            return False
        self.below.append(child)
        self.place[byte] = len(self.below)
        return True

    def items(self) -> Iterator[tuple]:
        return ((byte, self.below[at - 1]) for byte, at in enumerate(self.place) if at)


class Full:
    """A child for each of 256 bytes."""

    size = 256
    __slots__ = ("below",)

    def __init__(self):
        self.below = [None] * 256

    def get(self, byte: int):
        return self.below[byte]

    def put(self, byte: int, child) -> bool:
        self.below[byte] = child
        return True

    def items(self) -> Iterator[tuple]:
        return ((byte, child) for byte, child in enumerate(self.below) if child is not None)


LAYOUTS = (Four, Sixteen, FortyEight, Full)


class Node:
    """Bytes shared below, after the byte that led here; which key ends here; children, if any."""

    __slots__ = ("shared", "end", "children")

    def __init__(self, shared: bytes, end: int = NONE):
        self.shared, self.end, self.children = shared, end, None

    def add(self, byte: int, child: Node) -> None:
        """Add or replace a child, in the next larger layout if this one is full."""
        if self.children is None:
            self.children = Four()
        while not self.children.put(byte, child):
            grown = LAYOUTS[LAYOUTS.index(type(self.children)) + 1]()
            for b, c in self.children.items():
                grown.put(b, c)
            self.children = grown

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children by byte, in order."""
        return iter(()) if self.children is None else self.children.items()


class Tree:
    """Keys, each with the number it was added under."""

    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, number: int) -> int:
        """Add ``key`` under ``number`` unless it is there already; the number it is under."""
        node, at = self.root, 0
        while True:
            shared = node.shared
            if not key.startswith(shared, at):
                same = _same(shared, key, at)
                low = Node(shared[same + 1 :], node.end)
                low.children = node.children
                node.shared, node.end, node.children = shared[:same], NONE, None
                node.add(shared[same], low)
                shared = node.shared
            at += len(shared)
            if at == len(key):
                if node.end == NONE:
                    node.end = number
                return node.end
            child = node.children.get(key[at]) if node.children is not None else None
            if child is None:
                node.add(key[at], Node(key[at + 1 :], number))
                return number
            node, at = child, at + 1


def _same(shared: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``shared`` the key has from ``at`` on, less than all of them."""
    low, high = 0, min(len(shared), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(shared[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low
