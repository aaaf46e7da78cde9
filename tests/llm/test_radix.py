from __future__ import annotations

import random

from boxloom.llm.radix import NONE, FortyEight, Four, Full, Sixteen, Tree


def walked(tree):
    """Keys with their numbers, in the tree's order, and the layouts met."""
    out, layouts, stack = [], set(), [(b"", tree.root)]
    while stack:
        before, node = stack.pop()
        key = before + node.shared
        if node.end != NONE:
            out.append((key, node.end))
        if node.children is not None:
            layouts.add(type(node.children))
            below = list(node.items())
            assert [b for b, _ in below] == sorted({b for b, _ in below})
            assert len(below) > 1 or node.end != NONE or not before and node is tree.root
        stack += [(key + bytes([b]), child) for b, child in reversed(list(node.items()))]
    return out, layouts


def test_keys_come_back_in_order():
    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice([2, 5, 17, 49, 256])
        keys = [bytes(rng.randrange(letters) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 400))]
        tree, known = Tree(), {}
        for k, key in enumerate(keys):
            assert tree.add(key, k) == known.setdefault(key, k)
        assert walked(tree)[0] == sorted(known.items())


def test_layouts_grow_with_children():
    for n, layout in ((2, Four), (4, Four), (5, Sixteen), (16, Sixteen), (17, FortyEight), (48, FortyEight), (49, Full), (256, Full)):
        tree = Tree()
        order = list(range(n))
        random.Random(n).shuffle(order)
        for b in order:
            tree.add(bytes([b]) + b"tail", b)
        assert walked(tree) == ([(bytes([b]) + b"tail", b) for b in range(n)], {layout})


def test_paths_are_compressed():
    tree = Tree()
    tree.add(b"x" * 100_000, 0)
    tree.add(b"x" * 100_000 + b"y", 1)
    tree.add(b"x" * 50_000 + b"z", 2)
    tree.add(b"", 3)
    nodes, stack = 0, [tree.root]
    while stack:
        node = stack.pop()
        nodes += 1
        stack += [c for _, c in node.items()]
    assert nodes == 5 and [n for _, n in walked(tree)[0]] == [3, 0, 1, 2]
