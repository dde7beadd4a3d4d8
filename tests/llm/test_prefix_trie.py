import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tersa.llm import prefix_trie
from tersa.llm.common import Scratch
from tersa.llm.prefix_trie import AdaptiveRadixTree, _Full, _Indexed, _Small, aligned_nodes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, least string, node string, shard int"


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: tuple(t for _, t in sorted(v)) for c, v in by.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), ())[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = own + sum(saved[x] for x in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, Scratch(spark, "trie"), **how).collect()), key=str)


def conversations(seed, n, texts):
    pick, out = random.Random(seed), []
    for c in range(n):
        for t in range(pick.choice((1, 1, 2, 3, 5, 9))):
            out.append((c, t, pick.choice(("user", "assistant")), pick.choice(texts)))
    return out


@pytest.mark.parametrize("shard_turns", [3, 40, 10**6])
def test_nodes_are_those_of_brute_force_however_keys_are_dealt(spark, shard_turns):
    rows = conversations(1, 150, ["a b", "c"]) + conversations(2, 30, ["x  y\tz", "é ü"])[:40]
    assert trie(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (1, 0, "", "u s"), (2, 5, "u", "s"), (3, 0, "us", " "),
        (20, 0, "system", "w " * 5000), (21, None, "a", "b"), (21, 0, "a", "b"), (40, 0, "user", "hello"), (45, 0, "q", "only"),
        (None, 0, "user", "nobody's"), (-3, 0, "user", "a"), (-23, 1, "user", "a"), (10**12 + 7, 0, "user", "far"),
    ]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, shard_turns=1) == brute(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(alone, 0, "user", "gone")]
    assert trie(spark, rows) == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_a_large_group_of_copies_and_a_common_first_turn(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MEMBER_BLOCK", 7)
    rows = [r for c in range(300) for r in ((c, 0, "user", "hi"), (c, 1, "user", "hi"), (c, 2, "user", "hi"), (c, 3, "user", "hi"))]
    rows += [r for c in range(300, 500) for r in ((c, 0, "user", "hi"), (c, 1, "assistant", f"t {c}"))]
    assert trie(spark, rows, shard_turns=60) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_tree_against_a_dict_of_prefixes(width):
    pick = random.Random(width)
    keys = {bytes(pick.randrange(256 if i % 2 else 3) for _ in range(width * pick.randrange(5))) for i in range(3000)}
    tree = AdaptiveRadixTree()
    for k in keys:
        tree.insert(k, k)
    seen, at = [], []
    for depth, parent, below, ends in aligned_nodes(tree, width):
        path = below[: depth * width]
        at.append(path)
        assert parent < 0 or at[parent] == path[:-width]
        seen.append((path, ends))
    assert sorted(p for p, _ in seen) == sorted({k[: d * width] for k in keys for d in range(len(k) // width + 1)})
    assert {p for p, e in seen if e is not None} == keys and all(e in (None, p) for p, e in seen)


def test_node_layouts_grow():
    node, kinds = _Small(b""), []
    for byte in range(255, -1, -1):
        node = node.put(byte, byte)
        kinds.append((type(node), node.room))
    assert [kinds[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [
        (_Small, 4), (_Small, 16), (_Small, 16), (_Indexed, 48), (_Indexed, 48), (_Full, 256), (_Full, 256)
    ]
    assert [node.get(b) for b in range(256)] == list(range(256)) == node.children()
