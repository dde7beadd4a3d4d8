"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A dynamic programme over the rows of a conversation keeps, for each state of the role grammar ``(s?(ua)+)?``, the
cheapest edits that lead there and among those the ASCII-least. Edit strings are persistent: a node holds one edit, its
length, a rolling hash and binary-lifting ancestors, and shares everything before it. Two strings of equal cost are
compared at their longest common prefix, found by lifting both while hashes differ; equal hashes of different nodes
are verified edit by edit, so a collision cannot decide. What all states agree on is handed out at once, so memory holds
the undecided tail of a conversation, not the conversation.

Spark finds faults by columns and sorts each conversation's rows; a task streams over them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import arrow_map

BLANK, DUPLICATE, TRUNCATED, KEEP, REROLE, DELETE, INSERT = 1, 2, 3, "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row that stays costs besides.
STAYS_TRUNCATED = 5
#: States of the grammar: nothing yet, after s, after u, after a; by state, where an initial leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: The role that a rerole or an insertion gives in a state, and where it leads.
GIVES = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Undecided edits after which what all states agree on is looked for.
SETTLE = 512
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


class Edits:
    """A persistent edit string: one more edit behind a shared one."""

    __slots__ = ("edit", "length", "hash", "up")

    def __init__(self, edit: str, before: Edits | None):
        self.edit = edit
        if before is None:
            self.length, self.hash, self.up = 0, 0, ()
            return
        self.length = before.length + 1
        self.hash = (before.hash * _BASE + ord(edit)) % _MODULUS
        up, node, k = [before], before, 0
        while len(node.up) > k:  # the 2**k-th ancestor of the 2**k-th ancestor
            node = node.up[k]
            up.append(node)
            k += 1
        self.up = tuple(up)

    def first(self, length: int) -> Edits:
        """The prefix of that length."""
        node, rest = self, self.length - length
        while rest:
            k = rest.bit_length() - 1
            node, rest = node.up[k], rest - (1 << k)
        return node

    def text(self, after: int = 0) -> str:
        out, node = [], self
        while node.length > after:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def _parted(a: Edits, b: Edits) -> tuple[Edits, Edits]:
    """Of two strings of one length with different hashes: the prefixes that end at their first difference, if hashes tell."""
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    return a, b


def _really_equal(a: Edits, b: Edits) -> bool:
    while a is not b and a.length:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Edits, b: Edits) -> bool:
    """Whether string a comes before b; a proper prefix comes first."""
    if a is b:
        return False
    n = min(a.length, b.length)
    x, y = a.first(n), b.first(n)
    if x is not y:
        if x.hash == y.hash:
            if _really_equal(x, y):
                return a.length < b.length
        else:
            p, q = _parted(x, y)
            if _really_equal(p.up[0], q.up[0]):
                return p.edit < q.edit
        s, t = x.text(), y.text()  # a collision: the strings themselves decide
        return s < t if s != t else a.length < b.length
    return a.length < b.length


class Repair:
    """The dynamic programme over one conversation. ``push`` takes a row and gives the edits that are settled."""

    def __init__(self, settle: int = SETTLE):
        self.settle, self.due, self.given = settle, settle, 0
        start = Edits("", None)
        self.best: list[tuple[int, Edits] | None] = [(0, start), None, None, None]
        self._insert()

    def _offer(self, best, state: int, cost: int, before: Edits, edit: str) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        made = Edits(edit, before)
        if held is None or cost < held[0] or less(made, held[1]):
            best[state] = (cost, made)

    def _insert(self) -> None:
        """Insertions lead on; two of them reach every state that any number does."""
        for _ in range(2):
            for state, held in enumerate(list(self.best)):
                if held is not None:
                    self._offer(self.best, GIVES[state][1], held[0] + COST[INSERT], held[1], INSERT)

    def push(self, initial: str, fault: int) -> str:
        after: list[tuple[int, Edits] | None] = [None] * 4
        must_go, stays = fault in (BLANK, DUPLICATE), STAYS_TRUNCATED if fault == TRUNCATED else 0
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, edits = held
            self._offer(after, state, cost + COST[DELETE], edits, DELETE)
            if not must_go:
                if initial in STEPS[state]:
                    self._offer(after, STEPS[state][initial], cost + COST[KEEP] + stays, edits, KEEP)
                self._offer(after, GIVES[state][1], cost + COST[REROLE] + stays, edits, REROLE)
        self.best = after
        self._insert()
        if max(x[1].length for x in after if x is not None) > self.due:
            return self._settled()
        return ""

    def _settled(self) -> str:
        """The prefix on which all states agree; what lies behind it is linked anew, so that the prefix is freed."""
        live = [x[1] for x in self.best if x is not None]
        n = min(x.length for x in live)
        low, high, cut = 0, n, [x.first(n) for x in live]
        while low < high:  # the longest length at which all share one node
            middle = (low + high + 1) // 2
            if len({id(x.first(middle)) for x in cut}) == 1:
                low = middle
            else:
                high = middle - 1
        text = live[0].first(low).text()
        fresh: dict[int, Edits] = {id(live[0].first(low)): Edits("", None)}

        def again(node: Edits) -> Edits:
            path = []
            while id(node) not in fresh:
                path.append(node)
                node = node.up[0]
            made = fresh[id(node)]
            for x in reversed(path):
                made = Edits(x.edit, made)
                fresh[id(x)] = made
            return made

        self.best = [x and (x[0], again(x[1])) for x in self.best]
        self.due = max(x[1].length for x in self.best if x is not None) + self.settle
        return text

    def finish(self) -> tuple[int, str]:
        """The cost, and the edits that were not given yet."""
        cost, edits = min((self.best[s] for s in ACCEPTED if self.best[s] is not None), key=lambda x: x[0])
        for state in ACCEPTED:
            held = self.best[state]
            if held is not None and held[0] == cost and less(held[1], edits):
                edits = held[1]
        return cost, edits.text()


class _Conversation:
    """What is reported of one conversation, fed row by row."""

    def __init__(self):
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.repair, self.rows, self.audit, self.state = Repair(), deque(), [], 0
        self.hash, self.started = hashlib.sha256(), False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.rows.append((role, text))
        self._apply(self.repair.push(initial, fault))

    def _apply(self, edits: str) -> None:
        """Rows leave as soon as their edit is settled."""
        for edit in edits:
            row = self.rows.popleft() if edit != INSERT else ("", "")
            if edit == DELETE:
                continue
            if edit == KEEP:
                role, self.state = row[0], STEPS[self.state][row[0][:1]]
            else:
                role, self.state = GIVES[self.state]
            if self.started:
                self.hash.update(b"\n")
            self.hash.update(f"{role}:{row[1]}".encode())
            self.started = True
        self.audit.append(edits)

    def report(self) -> tuple:
        cost, edits = self.repair.finish()
        self._apply(edits)
        gaps = self.most - self.least + 1 - self.turns if self.most is not None else 0
        return (gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_SCHEMA = ", ".join(["conv_id bigint", *(f"{c} bigint" for c in _COLUMNS[:6]), "audit string", "repaired_sha256 string"])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; a conversation may run over any number of batches."""
    done, now, talk = [], None, None

    def flush():
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["conv_id", *_COLUMNS]
        )

    for batch in batches:
        for conv, turn, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if talk is None or conv != now:
                if talk is not None:
                    done.append((now, *talk.report()))
                now, talk = conv, _Conversation()
            if fault is not None:
                talk.add(turn, role, text, fault)
        if len(done) > 2000:
            yield flush()
            done.clear()
    if talk is not None:
        done.append((now, *talk.report()))
    yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage: role and text are null for a dropped row, and a repeated row comes twice."""
    space = F.lit(" ")
    kind = F.pmod(
        F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")),
        F.lit(20),
    )
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    return rows.select(
        "conv_id", "turn", F.when(kind != 0, role).alias("role"), F.when(kind != 0, text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (role null: only says that the conversation exists) with their digest and first fault, 0 for none."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.withColumn("digest", digest)
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(seen > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.withColumn("fault", F.when(F.col("role").isNotNull(), fault))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text).

    Returned for each conv_id: gaps in its turn numbers, rows that are blank, duplicate or truncated (the first that
    holds counts), illegal neighbours, the cost and the edits (K keep, R rerole, D delete, I insert) of the cheapest
    repair, and the hash of the repaired rows. A row whose role is null only says that the conversation exists.

    Null turns come first, rows of one turn by role and text hash, so repeated rows lie next to each other. Null conv_ids are
    one conversation. No rows: no edits, cost 0. Empty table: no rows. Roles that are none of the grammar's can be given
    another role or deleted. A very long text passes a task once; what is kept are rows whose edit is not settled.
    Other columns are not read, whatever their names.
    """
    wanted = rows.select("conv_id", "turn", "role", "text", *([c for c in ("copy",) if c in rows.columns]))
    if "copy" not in wanted.columns:
        wanted = wanted.withColumn("copy", F.lit(0))
    ordered = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    dealt = with_faults(wanted).repartition("conv_id").sortWithinPartitions(*ordered)
    return arrow_map(dealt.select("conv_id", "turn", "role", "text", "fault"), _repair, _SCHEMA)
