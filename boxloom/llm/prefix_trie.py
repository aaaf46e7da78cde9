"""Prefix trie of conversations.

Each turn is an id of fixed width, big-endian, so that a conversation is a key of bytes, and sorted keys are the
trie's own order. Equal conversations are gathered first. The keys are then dealt out by ranges, which no first
turn, however common, can fill, and each task walks its range in blocks of bounded size: it adds a block's keys to
an adaptive radix tree and reads the trie's nodes from it at whole turns. Nodes on the way to a block's first or
last key may go on in another block and leave the task in parts; all others are whole. The parts are few: they
are merged by key, and their subtrees' sums run up the trie by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.radix import NONE, Tree
from boxloom.sources.durable import durable

#: Bytes of a turn's id: a digest of role and text, then the text's own bytes as a number.
WIDTH, SIZE_BYTES = 16, 4
#: Keys and bytes of keys that a block is closed at.
BLOCK_KEYS, BLOCK_BYTES = 16_384, 8 << 20
#: log2 of the ids that are gathered into one row.
CHUNK = 13
#: Conversations of so many consecutive ids share a head, of fewer turns than HEADS.
FAMILY, HEADS = 5, 9

NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, ends string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id) for every turn with a conv_id; ``id`` is hexadecimal, a null role or text counts as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    size = F.lpad(F.hex(F.octet_length(text)), 2 * SIZE_BYTES, "0")
    ident = F.concat(F.substring(digest, 1, 2 * (WIDTH - SIZE_BYTES)), F.lower(size))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", ident.alias("id"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation c, rebuilt: the head of c - c % FAMILY, then its own turns after as many.

    The head has crc32(c) % HEADS turns, or all that there are. ``path`` is the ids of the turns as bytes. Turns
    are in order of ``turn``, null first; turns that tie in it are in order of their ids, so that the order of
    rows never counts, and repeated rows are turns of their own.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turn_ids(conversations).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition(n, "family")
    own = turns.groupBy("family", "conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda t: t["id"]).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.col("own")), ignorenulls=True).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.array().cast("array<string>")
    ids = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return own.withColumn("head", head).select("conv_id", F.unhex(F.array_join(ids, "")).alias("path"))


@dataclass
class Block:
    """Distinct keys in order, each with the number, the least and the digest of the ids that end there."""

    keys: list[bytes] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    held: int = 0

    def add(self, key: bytes, count: int, least: int, ends: str) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.least.append(least)
        self.ends.append(ends)
        self.held += len(key)

    def full(self, keys: int, size: int) -> bool:
        return len(self.keys) >= keys or self.held >= size


def trie_nodes(tree: Tree) -> tuple[list[int], list[int], list[int]]:
    """Depth, parent and ending key of the trie's nodes, parents before their children; the root's parent is itself.

    Only depths of whole turns are nodes: one edge of the tree may pass several, and branches within a turn none.
    """
    depth, parent, end = [0], [0], [NONE]
    stack = [(tree.root, 0, len(tree.root.shared), 0)]
    while stack:
        node, above, below, at = stack.pop()
        for d in range(above // WIDTH + 1, below // WIDTH + 1):
            depth.append(d)
            parent.append(at)
            end.append(NONE)
            at = len(depth) - 1
        if node.end != NONE:
            end[at] = node.end
        stack += [(child, below, below + 1 + len(child.shared), at) for _, child in node.items()]
    return depth, parent, end


def prefix_keys(key: bytes) -> list[bytes]:
    """A digest of every prefix of whole turns, the empty one first."""
    running, out = hashlib.blake2b(digest_size=16), []
    out.append(running.digest())
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        out.append(running.digest())
    return out


def block_nodes(block: Block) -> pa.RecordBatch:
    """The nodes of a block's keys. Those of its first and last key have a ``key``, and numbers of the block alone.

    Their n_children, n_leaves and saved are of the whole nodes below them; a node whose parent has a key names
    that instead of the parent's conversation.
    """
    tree = Tree()
    for k, key in enumerate(block.keys):
        tree.add(key, k)
    depth, parent, end = trie_nodes(tree)
    n = len(depth)
    place = {e: i for i, e in enumerate(end) if e != NONE}
    name: list[bytes | None] = [None] * n
    for k in (0, len(block.keys) - 1):
        i = place[k]
        for digest in reversed(prefix_keys(block.keys[k])):
            name[i] = digest
            i = parent[i]
    counts = [0 if e == NONE else block.counts[e] for e in end]
    least = [None if e == NONE else block.least[e] for e in end]
    some = list(end)  # a key below each node
    kids, leaves, saved, size = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        key, d, p = block.keys[some[i]], depth[i], parent[i]
        size[i] = int.from_bytes(key[d * WIDTH - SIZE_BYTES : d * WIDTH], "big") if d else 0
        if name[i] is None:
            leaves[i] = leaves[i] or 1
            saved[i] += (counts[i] - 1) * size[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
        if i:
            counts[p] += counts[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            some[p] = some[i]
    known = [None if name[p] is not None else least[p] for p in parent]
    above = [name[p] if i else None for i, p in enumerate(parent)]
    ends = [None if e == NONE else block.ends[e] for e in end]
    columns = [name, above, depth, least, known, counts, kids, leaves, saved, size, ends]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in NODE.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], keys: int, size: int) -> Iterator[pa.RecordBatch]:
    """Nodes by blocks of the rows (path, ids), which come in order of path and of ids."""
    block, key, count, least, running = Block(), None, 0, 0, None
    for batch in batches:
        for path, ids in zip(batch.column(0), batch.column(1)):
            path, ids = path.as_py(), ids.as_py()
            if path != key:
                if key is not None:
                    block.add(key, count, least, running.hexdigest())
                    if block.full(keys, size):
                        yield block_nodes(block)
                        block = Block()
                key, count, least, running = path, 0, ids[0], hashlib.sha256()
            running.update((("," if count else "") + ",".join(map(str, ids))).encode())
            count += len(ids)
    if key is not None:
        block.add(key, count, least, running.hexdigest())
        yield block_nodes(block)


def _merged(parts: DataFrame) -> DataFrame:
    """Whole nodes of the parts that have a key."""
    met = durable(
        parts.groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("ends").alias("ends"),
        )
    )
    beside = met.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    own = met.join(beside, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    sums = own.select(
        "key",
        F.col("parent_key").alias("up"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    deepest = met.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        # Each node holds the sums of the nodes fewer than so many turns below it, and ``up``, the node as many turns above.
        sums = durable(sums)
        gained = sums.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))
        further = sums.where("up is not null").select("key", F.col("up").alias("via")).join(sums.select(F.col("key").alias("via"), F.col("up").alias("next")), "via").select("key", "next")
        sums = (
            sums.join(gained, "key", "left")
            .join(further, "key", "left")
            .select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("add_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("add_saved", F.lit(0))).alias("saved"))
        )
    return durable(own.drop("n_leaves", "saved", "more").join(sums.drop("up"), "key"))


def trie(paths: DataFrame, block_keys: int = BLOCK_KEYS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The trie's nodes for rows (conv_id, path), one for each conversation, ``path`` its turns' ids as bytes.

    Per node: conv_id (the least that begins with it; its first ``depth`` turns are the node), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A row with an
    empty path is a member of the root and ends there; without rows there is no node. One conversation's ids
    are one row: its texts are not. Blocks of other sizes give the same nodes.
    """
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = durable(paths.groupBy("path", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")))
    ranged = chunks.repartitionByRange(n, "path").sortWithinPartitions("path", "chunk").select("path", "ids")
    parts = durable(ranged.mapInArrow(lambda batches: _blocks(batches, block_keys, block_bytes), NODE))
    met = _merged(parts.where("key is not null"))
    whole = parts.where("key is null")
    names = met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    rows = [
        whole.where("parent_key is null").select("parent_conv_id", *columns),
        whole.where("parent_key is not null").join(names, "parent_key").select(F.col("above").alias("parent_conv_id"), *columns),
        met.join(names, "parent_key", "left").select(F.col("above").alias("parent_conv_id"), *columns),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations. Rows without a conv_id belong to none; other columns don't count."""
    return trie(rebuilt(conversations))


ORACLE = """
with recursive crc as (
  select c, c::varchar as text, 1 as k, 4294967295::bigint as r from (select distinct conv_id as c from conversations where conv_id is not null)
  union all
  select c, text, k + 1, list_reduce(list_prepend(xor(r, ascii(text[k])::bigint), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384::bigint else 0 end))
  from crc where k <= length(text)
), heads as (
  select c, c - c % 5 as b, xor(r, 4294967295::bigint) % 9 as h from crc where k > length(text)
), turns as (
  select conv_id as c, strlen(coalesce(text, '')) as size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:24] || printf('%08x', strlen(coalesce(text, ''))) as id, turn
  from conversations where conv_id is not null
), placed as (
  select c, id, size, row_number() over (partition by c order by turn nulls first, id) as pos from turns
), remade as (
  select h.c, p.pos, p.id, p.size from heads h join placed p on p.c = h.b and p.pos <= h.h
  union all
  select h.c, p.pos, p.id, p.size from heads h join placed p on p.c = h.c and p.pos > h.h
), chained as (
  select c, row_number() over w as d, string_agg(id, '') over w as key, size from remade window w as (partition by c order by pos rows unbounded preceding)
), members as (
  select c, d, key, size from chained union all select c, 0, '', 0 from heads
), deepest as (
  select c, max(d) as last from members group by c
), nodes as (
  select key, d, min(m.c) as conv_id, count(*) as n_convs, any_value(size) as size,
         coalesce(string_agg(m.c::varchar, ',' order by m.c) filter (e.last is not null), '') as ends
  from members m left join deepest e on m.c = e.c and m.d = e.last group by key, d
), kids as (
  select n.key, count(k.key) as n_children from nodes n left join nodes k on k.d = n.d + 1 and k.key[1:32 * n.d] = n.key group by n.key
), spread as (
  select n.key, k.n_children, (n.n_convs - 1) * n.size as own, unnest(range(0, n.d + 1)) as up from nodes n join kids k on k.key = n.key
), sums as (
  select key[1:32 * up] as key, count(*) filter (n_children = 0) as n_leaves, sum(own) as saved from spread group by 1
)
select n.conv_id::bigint as conv_id, n.d::bigint as depth, p.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs, k.n_children::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join kids k on k.key = n.key join sums s on s.key = n.key left join nodes p on p.d = n.d - 1 and p.key = n.key[1:32 * (n.d - 1)] and n.d > 0
"""
