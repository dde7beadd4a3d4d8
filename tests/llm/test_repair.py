import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tersa.llm import repair
from tersa.llm.repair import Edits, Repair, damaged, less, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, fault string, _h int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            out.append((c, t, None, None))
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def fault_of(text, seen):
    words = re.findall(r"[^\x20\x09-\x0D]", text)
    return 1 if not words else 2 if seen else 3 if words[-1] not in ".!?" else 0


def cheapest(rows):
    """(cost, edits, repaired) by trying every string of edits: a search over (row, state) that keeps whole strings."""
    frontier = {(0, ""): (0, "", ())}  # (row, roles' state as text) -> best
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    gives = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}
    def inserted(best):
        for _ in range(4):
            for s, (c, e, r) in list(best.items()):
                to = gives[s][0]
                new = (c + 5, e + "I", r + ((gives[s], ""),))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best
    best = inserted(best)
    for role, text, fault in rows:
        after = {}
        for s, (c, e, r) in best.items():
            options = [(s, (c + 2, e + "D", r))]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                if role[:1] in states[s]:
                    options.append((states[s][role[:1]], (c + extra, e + "K", r + ((role, text),))))
                options.append((gives[s][0], (c + 1 + extra, e + "R", r + ((gives[s], text),))))
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows):
    """The same from all strings over K, R, D with up to two insertions at each place."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        for gaps in product(("", "I", "II"), repeat=len(rows) + 1):
            string = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            cost, roles, row, good = 0, "", 0, True
            for e in string:
                need = "a" if roles[-1:] == "u" else "u"
                if e == "I":
                    cost, roles = cost + 5, roles + need
                    continue
                role, _, fault = rows[row]
                row += 1
                if e == "D":
                    cost += 2
                    continue
                if fault in (1, 2):
                    good = False
                    break
                cost += (5 if fault == 3 else 0) + (e == "R")
                roles += need if e == "R" else role[:1]
            if good and GRAMMAR.fullmatch(roles) and (best is None or (cost, string) < best):
                best = (cost, string)
    return best


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role, text))
    out = []
    for c, talk in by.items():
        talk = [x for x in talk if x[1] is not None]
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        seen, judged = set(), []
        for t, role, text in talk:
            judged.append((role, text, fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        turns = [t for t, _, _ in talk if t is not None]
        initials = [r[:1] for r, _, _ in judged]
        cost, edits, kept = cheapest(judged)
        count = [sum(f == k for _, _, f in judged) for k in (1, 2, 3)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, edits, digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


ROLES = ("system", "user", "assistant", "assistant", "user", "tool", "", "User")


def random_rows(seed, n, length):
    pick = random.Random(seed)
    return [
        (c, t, pick.choice(ROLES), pick.choice(("Yes.", "no", "Well! ", " \n", "Yes.", f"It is {t}.", f"And {t}?")))
        for c in range(n) for t in range(pick.choice(range(1, length)))
    ]


def test_damaged_conversations_against_brute_force(spark):
    rows = random_rows(1, 200, 12)
    assert got(repair_conversations(damaged(table(spark, rows)))) == brute(brute_damage(rows))


def test_awkward_rows(spark):
    rows = [
        (1, None, "user", "First."), (1, None, "user", "First."), (1, 3, "assistant", None), (1, 9, None, "Odd."), (2, None, None, None),
        (None, 1, "user", "Nobody."), (None, None, "assistant", "Yes!"), (3, 0, "user", "w " * 40_000 + "."), (3, 1, "assistant", "x?\t\n"),
        (4, -5, "system", "é漢字."), (4, 7, "s", "漢。"), (4, 7, "a", "?"), (4, 7, "u", "?"), (5, 0, "assistant", "\x0b\x0c\x1c."), (5, 0, "user", "."),
    ]
    assert got(repair_conversations(table(spark, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]))) == brute(
        [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    )
    assert got(repair_conversations(damaged(table(spark, rows)))) == brute(brute_damage(rows))


def test_empty_table_and_dropped_rows(spark):
    assert got(repair_conversations(damaged(table(spark, [])))) == []
    gone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(repair_conversations(damaged(table(spark, [(gone, 0, "user", "Hi.")])))) == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


def test_a_conversation_that_holds_most_rows(spark, monkeypatch):
    pick = random.Random(7)
    rows = [(9, t, pick.choice(ROLES[:5]), pick.choice(("Yes.", f"Go {t}.", "no"))) for t in range(4000)] + random_rows(3, 20, 5)
    assert got(repair_conversations(table(spark, rows))) == brute(rows)


def run(rows, settle=repair.SETTLE):
    talk, edits = Repair(settle), ""
    for role, _, fault in rows:
        edits += talk.push(role[:1], fault)
    cost, rest = talk.finish()
    return cost, edits + rest


@pytest.mark.parametrize("seed", range(60))
def test_edits_are_the_least_of_all(seed):
    pick = random.Random(seed)
    rows = [(pick.choice("sauuaat"), "", pick.choice((0, 0, 0, 1, 2, 3))) for _ in range(seed % 4 + 1)]
    assert run(rows) == exhaustive(rows) == cheapest(rows)[:2]


@pytest.mark.parametrize("settle", [1, 3, 50])
def test_settled_edits_change_nothing(settle):
    pick = random.Random(settle)
    for _ in range(40):
        rows = [(pick.choice("suuaaat"), "", pick.choice((0, 0, 0, 1, 2, 3))) for _ in range(pick.randrange(60))]
        assert run(rows, settle) == cheapest(rows)[:2]


def chain(text):
    node = Edits("", None)
    for c in text:
        node = Edits(c, node)
    return node


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 1])
def test_order_of_strings_even_if_every_hash_collides(monkeypatch, modulus):
    monkeypatch.setattr(repair, "_MODULUS", modulus)
    pick = random.Random(modulus)
    texts = ["".join(pick.choice("DIKR") for _ in range(pick.randrange(9))) for _ in range(60)] + ["K" * 100 + x for x in ("", "D", "DK", "R")]
    nodes = [chain(t) for t in texts]
    for s, a in zip(texts, nodes):
        assert a.text() == s and all(a.first(i).text() == s[:i] for i in range(len(s) + 1))
        for t, b in zip(texts, nodes):
            assert less(a, b) == (s < t)
