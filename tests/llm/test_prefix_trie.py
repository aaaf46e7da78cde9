from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from boxloom.llm import entry, prefix_trie
from tests.oracle import SF_DIR

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def order_key(turn, role, text):
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:24]
    return (turn is not None, turn or 0, digest, len(text.encode()))


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: order_key(*t))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """All nodes of the sequences ``convs``, by conversation."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted(
        ((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
          hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items()), key=str,
    )


def got(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, rows):
    made = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, family string, id int")
    return got(prefix_trie.conversation_trie(made))


def conversations(seed, count, texts=4):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", "", None]), rng.choice([f"text {rng.randrange(texts)}", "é" * rng.randrange(3), None]))
            for c in range(count) for t in range(rng.randrange(0, 14))]


def test_against_brute_force(spark):
    rows = conversations(1, 300)
    assert run(spark, rows) == brute(rebuild(rows))


def test_nulls_ties_repeated_rows_and_odd_ids(spark):
    rows = [(c, t, "user", f"t{t % 3}") for c in (-11, -10, -7, -5, -3, 0, 2, 4, 2**62, 2**62 + 1) for t in range(10)]
    rows += [(7, None, "user", "null first"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, None, None, None), (7, None, "", "")]
    rows += [(None, 1, "user", "of no conversation"), (10, 5, "ab", "c"), (15, 5, "a", "bc"), (22, -3, "x", "y" * 100_000), (22, 3, "x", "y" * 100_001)]
    assert run(spark, rows) == brute(rebuild(rows))


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    rows = [(c, 0, "u", "x"), (c, 1, "u", "y")]
    assert run(spark, rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute(rebuild(rows))


def paths(spark, convs):
    ids = {c: b"".join(hashlib.md5(repr(t).encode()).digest()[:12] + len(t[1].encode()).to_bytes(4, "big") for t in turns) for c, turns in convs.items()}
    return spark.createDataFrame([(c, bytearray(p)) for c, p in ids.items()], "conv_id long, path binary")


@pytest.mark.parametrize("block", [1, 2, 7, 10_000])
def test_blocks_of_any_size_give_the_same_nodes(spark, block):
    rng = random.Random(block)
    convs = {c: [("u", rng.choice("abc")) for _ in range(rng.randrange(0, 8))] for c in range(-200, 400)}
    convs |= {c: [("u", "hot")] * 5 for c in range(1000, 1400)}
    assert got(prefix_trie.trie(paths(spark, convs), block)) == brute(convs)


def test_long_conversations_in_blocks(spark):
    long = [("u", f"turn {k}") for k in range(1000)]
    convs = {k: long[: 1000 - 7 * k] for k in range(20)} | {100 + k: long[:500] + [("u", f"own {k}")] for k in range(20)}
    assert got(prefix_trie.trie(paths(spark, convs), 3)) == brute(convs)


def test_ids_of_many_copies_are_gathered_in_order(spark):
    convs = {c: [("u", "the same")] for c in range(-9000, 40_000, 2)}
    nodes = got(prefix_trie.trie(paths(spark, convs)))
    assert nodes == brute(convs) and len(nodes) == 2


def test_the_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(entry.QUERIES["op12_prefix_trie"](spark, SF_DIR)) == brute(rebuild(rows))
