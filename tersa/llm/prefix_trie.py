"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so a conversation is a key of 16 bytes for
each turn, and texts are never shuffled. Equal conversations become one key with its members' count and least id.
Keys are dealt to shards by ranges, so a first turn or a passage of turns that a third of all conversations
share is split like any other range. A task puts its shard's keys into an adaptive radix tree (nodes of 4, 16, 48 and
256 places, compressed paths) and walks it; bytes at a multiple of 16 are trie nodes, all other branchings are not.
A prefix that runs over a shard's edge is known by the neighbours' edge keys: such nodes give sums that add up over shards.

Assumed: the turn ids of one conversation fit a task's memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, arrow_map, workers_import_package

#: Bytes of a turn's id.
WIDTH = 16
#: Turns of a shard, on average.
SHARD_TURNS = 50_000
#: Conversation ids of one block of a node's member list.
MEMBER_BLOCK = 4096
#: Copies of a shared node's row in the join with its children, as the root may have very many.
SALTS = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


class _Small:
    """Up to 4 or 16 children: sorted bytes next to the children."""

    __slots__ = ("prefix", "leaf", "keys", "nodes", "room")

    def __init__(self, prefix: bytes, room: int = 4):
        self.prefix, self.leaf, self.keys, self.nodes, self.room = prefix, None, bytearray(), [], room

    def get(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.nodes[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node):
        """Add or replace a child; the node that holds it afterwards, as a full one grows."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            return (self._wider() if self.room == 4 else _Indexed(self)).put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def _wider(self):
        wide = _Small(self.prefix, 16)
        wide.leaf, wide.keys, wide.nodes = self.leaf, self.keys, self.nodes
        return wide

    def children(self):
        return list(self.nodes)


class _Indexed:
    """Up to 48 children: a place for each byte in an index of 256."""

    __slots__ = ("prefix", "leaf", "index", "nodes")
    room = 48

    def __init__(self, small: _Small):
        self.prefix, self.leaf, self.index, self.nodes = small.prefix, small.leaf, bytearray(256), list(small.nodes)
        for at, byte in enumerate(small.keys):
            self.index[byte] = at + 1

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node):
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == self.room:
            return _Full(self).put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def children(self):
        return [self.nodes[at - 1] for at in self.index if at]


class _Full:
    """A child for every byte."""

    __slots__ = ("prefix", "leaf", "nodes")
    room = 256

    def __init__(self, indexed: _Indexed):
        self.prefix, self.leaf = indexed.prefix, indexed.leaf
        self.nodes = [indexed.nodes[at - 1] if at else None for at in indexed.index]

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def children(self):
        return [n for n in self.nodes if n is not None]


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class AdaptiveRadixTree:
    """Keys to values. Keys may be prefixes of each other; a value sits at the node where its key ends.

    A node's compressed path begins with the byte that leads to it.
    """

    def __init__(self):
        self.root = _Small(b"")

    def insert(self, key: bytes, value) -> None:
        holder, node, at = None, self.root, 0
        while True:
            rest = key[at : at + len(node.prefix)]
            same = len(rest) if rest == node.prefix else shared_bytes(node.prefix, rest)
            if same < len(node.prefix):  # the path parts within the compressed bytes
                fork = _Small(node.prefix[:same])
                node.prefix = node.prefix[same:]
                fork.put(node.prefix[0], node)
                holder.put(fork.prefix[0], fork)
                node = fork
            at += same
            if at == len(key):
                node.leaf = value
                return
            below = node.get(key[at])
            if below is None:
                below = _Small(key[at:])
                below.leaf = value
                grown = node.put(key[at], below)
                if holder is None:
                    self.root = grown
                elif grown is not node:
                    holder.put(grown.prefix[0], grown)
                return
            holder, node = node, below


def aligned_nodes(tree: AdaptiveRadixTree, width: int):
    """(depth, index of the parent, a value below, the value that ends there) of each trie node, parents first.

    There is one entry for every depth of whole turns on a path, within compressed bytes too; branchings at other byte
    depths give none. A value below tells the path; the last is None where no key ends.
    """
    order, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children())
    below: dict[int, object] = {}
    for node in reversed(order):
        below[id(node)] = node.leaf if node.leaf is not None else below[id(node.children()[0])]
    yield 0, -1, below[id(tree.root)], tree.root.leaf
    count, stack = 1, [(tree.root, 0, 0)]  # a node, the byte depth where its path begins, the trie node above it
    while stack:
        node, at, above = stack.pop()
        end = at + len(node.prefix)
        for depth in range(at // width + 1, end // width + 1):
            yield depth, above, below[id(node)], node.leaf if depth * width == end else None
            above, count = count, count + 1
        stack.extend((child, end, above) for child in node.children())


def shard_nodes(keys: list, before: bytes | None, after: bytes | None) -> list[dict]:
    """The trie nodes of one shard. keys: sorted (key, words by turn, members, least member, hash of the members).

    ``before`` and ``after`` are the neighbouring shards' nearest keys. A node whose prefix one of them shares is
    open: it carries a hash of its prefix, and its sums are this shard's share. A shard owns the nodes that no earlier
    shard has; only the owner counts a node as a child, as a leaf or in the words that are not saved.
    """
    tree = AdaptiveRadixTree()
    for at, row in enumerate(keys):
        tree.insert(row[0], at)
    known = shared_bytes(before, keys[0][0]) // WIDTH if before is not None else -1  # depths that are not owned
    beyond = shared_bytes(after, keys[-1][0]) // WIDTH if after is not None else -1
    nodes = []
    for depth, parent, below, ends in aligned_nodes(tree, WIDTH):
        key, words = keys[below][0], keys[below][1]
        first = depth <= known and key[: depth * WIDTH] == before[: depth * WIDTH]
        last = depth <= beyond and key[: depth * WIDTH] == after[: depth * WIDTH]
        word = words[depth - 1] if depth else 0
        is_open = depth == 0 or first or last
        _, _, n, least, members = keys[ends] if ends is not None else (0, 0, 0, None, None)
        nodes.append({
            "node": hashlib.sha256(key[: depth * WIDTH]).digest() if is_open else None, "depth": depth, "parent": parent,
            "least": least, "n_convs": n, "n_children": 0, "n_leaves": 0, "ends_sha256": members,
            "own": not first, "continues": last, "word": word, "saved": 0,
        })
    for x in reversed(nodes):  # children come after their parents
        if x["own"] and not x["continues"] and x["n_children"] == 0:
            x["n_leaves"] = 1
        x["saved"] += x["n_convs"] * x["word"] - (x["word"] if x["own"] else 0)
        if x["parent"] >= 0:
            above = nodes[x["parent"]]
            above["n_convs"] += x["n_convs"]
            above["n_leaves"] += x["n_leaves"]
            above["saved"] += x["saved"]
            above["n_children"] += x["own"]
            above["least"] = x["least"] if above["least"] is None else min(above["least"], x["least"])
    for x in nodes:
        above = nodes[x["parent"]] if x["parent"] >= 0 else None
        x["parent_node"] = above["node"] if above else None
        x["parent_least"] = above["least"] if above and above["node"] is None else None
    return nodes


_NODE_SCHEMA = (
    "node binary, depth bigint, parent_node binary, parent_least bigint, least bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved bigint, ends_sha256 string"
)


def rebuilt(rows: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv_id, turns): each conversation's own turns behind the opening of its group's first conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"),
        F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    turns = F.sort_array(F.collect_list(turn))
    own = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, heads).alias("_head")
    )
    own = own.withColumn("_h", head).withColumn("_of", F.col("conv_id") - F.col("conv_id") % group)
    joined = own.join(first, F.col("_of") == F.col("_first"), "left")
    opening = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(opening, rest).alias("turns"))


def _members(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns: its key, words, members, least member and hash of the members."""
    key = F.coalesce(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""), F.lit(""))
    keyed = convs.select(
        "conv_id", F.unhex(key).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"),
        F.floor(F.col("conv_id") / MEMBER_BLOCK).alias("block"),
    )
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = keyed.groupBy(F.unhex(F.sha2("key", 256)).alias("seq"), "block").agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"), ids.alias("ids"),
    )
    blocks = blocks.repartition("seq").sortWithinPartitions("seq", "block")

    def fold(batches):
        """A sequence's blocks follow each other; its hash runs over them, so none is ever held whole."""
        names, last, out, digest = ("key", "words", "n", "least", "ends"), None, None, None

        def flush(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()))],
                names=list(names),
            )

        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["seq"] != last:
                    if out is not None:
                        done.append((*out, digest.hexdigest()))
                    last, out = row["seq"], [row["key"], row["words"], 0, row["least"]]
                    digest = hashlib.sha256(row["ids"].encode())
                else:
                    digest.update(b"," + row["ids"].encode())
                out[2] += row["n"]
            if len(done) >= 1000:
                yield flush(done)
                done = []
        if out is not None:
            done.append((*out, digest.hexdigest()))
        yield flush(done)

    return arrow_map(blocks, fold, "key binary, words array<int>, n bigint, least bigint, ends string")


def _build(shard: pa.Table, edge: pa.Table) -> pa.Table:
    rows = sorted(zip(*(shard.column(c).to_pylist() for c in ("key", "words", "n", "least", "ends"))), key=lambda r: r[0])
    bounds = edge.to_pylist()[0]
    nodes = shard_nodes(rows, bounds["before"], bounds["after"])
    schema = pa.schema([
        ("node", pa.binary()), ("depth", pa.int64()), ("parent_node", pa.binary()), ("parent_least", pa.int64()), ("least", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends_sha256", pa.string()),
    ])
    return pa.Table.from_pydict({f.name: [x[f.name] for x in nodes] for f in schema}, schema)


def prefix_trie(
    rows: DataFrame, scratch: Scratch, group: int = 20, heads: int = 4, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """The trie nodes of all rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    Conversation c is rebuilt from the first h turns of conversation c - c % group (h: crc32 of c's digits modulo
    ``heads``) and its own turns behind its first h. A node is a distinct sequence of first turns. Returned for each:
    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that need
    not be stored again in its subtree) and ends_sha256 (of the members that end there).

    Null turns come first; turns of one number are ordered by role and text hash. Null role or text is empty, a null
    conv_id is no conversation and its rows take no part. Repeated rows are turns of their own; a conversation without
    turns belongs to the root. No conversations: no nodes. Very long texts are hashed where they are read and never shuffled.
    Other columns are not read, whatever their names.
    """
    workers_import_package(rows.sparkSession)
    turns = rows.select("conv_id", "turn", "role", "text")
    convs = scratch.keep(rebuilt(turns, group, heads), "convs")
    n_turns = convs.agg(F.sum(F.size("turns"))).first()[0] or 0
    members = scratch.keep(_members(convs), "members")
    scratch.drop("convs")
    shards = max(1, -(-n_turns // shard_turns))
    dealt = members.repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id())
    dealt = scratch.keep(dealt, "shards")
    scratch.drop("members")
    edges = dealt.groupBy("shard").agg(F.min("key").alias("least_key"), F.max("key").alias("most_key"))
    in_order = Window.orderBy("shard")  # one row for each shard
    edges = edges.select(
        "shard", F.lag("most_key").over(in_order).alias("before"), F.lead("least_key").over(in_order).alias("after")
    )
    built = dealt.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_build, _NODE_SCHEMA)
    built = scratch.keep(built, "nodes")
    scratch.drop("shards")
    return _joined(built, scratch)


def _joined(built: DataFrame, scratch: Scratch) -> DataFrame:
    """Sums of nodes that several shards hold, and the parents of nodes below them."""
    open_nodes = built.where("node IS NOT NULL").groupBy("node").agg(
        F.first("depth").alias("depth"), F.max("parent_node").alias("parent_node"),
        F.lit(None).cast("bigint").alias("parent_least"), F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends_sha256").alias("ends_sha256"),
    )
    open_nodes = scratch.keep(open_nodes, "open")
    nodes = built.where("node IS NULL").unionByName(open_nodes)
    known = nodes.where("parent_node IS NULL").withColumn("parent_conv_id", F.col("parent_least"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    above = open_nodes.select(F.col("node").alias("_node"), F.col("least").alias("parent_conv_id"), salts.alias("_salt"))
    salt = F.pmod(F.xxhash64("least", "depth"), F.lit(SALTS)).cast("int")
    found = nodes.where("parent_node IS NOT NULL").withColumn("_at", salt)
    found = found.join(above, (F.col("parent_node") == F.col("_node")) & (F.col("_at") == F.col("_salt"))).drop("_node", "_salt", "_at")
    return known.unionByName(found).select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
