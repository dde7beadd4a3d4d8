"""Balanced label propagation: documents move to the shards of their neighbours, sizes stay even.

Neighbours are documents with one hub (here: equal texts). A round counts each hub's documents by shard and
lets the smaller parts of a hub wish for the shard that holds most of it. Quotas say how many wishes between
two shards are granted: as many as come back the other way, and as many more as there are unlinked documents
to send back in exchange. So no round changes a count by more than the exchange evens out. Rounds go on until no
wish can be granted. Hubs that hold much of a shard are placed first, each in as few shards as there is room.
Only DataFrame functions; the driver sees two numbers for each pair of shards, and the sizes of the large hubs.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, gapless, with_row
from tersa.sources.local import local_frame

SHARDS = 40
#: Hubs of at least one in so many of a shard's documents are placed by the driver, at most twice as many for each shard.
LARGE = 8


def _quotas(wishes: Counter, spare: Counter) -> tuple[dict, Counter]:
    """Grants by (from, to), and each shard's surplus of arrivals, at most its unlinked documents."""
    granted = {(s, t): min(n, wishes.get((t, s), 0)) for (s, t), n in wishes.items()}
    left, surplus = Counter(spare), Counter()
    for (s, t), n in sorted(wishes.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - granted[s, t], left[t])
        granted[s, t] += more
        left[t] -= more
        surplus[t] += more
        surplus[s] -= more
    return {k: n for k, n in granted.items() if n}, surplus


def _pack(sizes: list[tuple[int, int]], room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """hub -> (shard, documents): whole shards first, then the rests where they fit best; ``room`` is used up."""
    out, rests = {}, []
    for hub, left in sorted(sizes, key=lambda x: (-x[1], x[0])):
        out[hub] = []
        while left and left >= max(room):
            s = room.index(max(room))
            out[hub].append((s, room[s]))
            left, room[s] = left - room[s], 0
        rests.append((left, hub))
    for left, hub in sorted(rests, key=lambda x: (-x[0], x[1])):
        while left:
            fits = [s for s, r in enumerate(room) if r >= left]
            s = min(fits, key=lambda s: room[s]) if fits else room.index(max(room))
            n = min(left, room[s])
            out[hub].append((s, n))
            left, room[s] = left - n, room[s] - n
    return out


def _place(ends: list[int], turn: Column) -> Column:
    """How many of the ends lie at or below the turn."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in ends]), lambda b: b <= turn))


def _deal(known: DataFrame, many: DataFrame, n: int, shards: int) -> DataFrame:
    """(_row, hub, shard, placed): large hubs in as few shards as they can, then all others evenly in what is left."""
    spark, room = known.sparkSession, [n // shards + (s < n % shards) for s in range(shards)]
    large = many.where(LARGE * F.col("_n") >= n // shards)
    plan = _pack([(r.hub, r["_n"]) for r in large.collect()], room)  # at most 2 * LARGE * shards, or ``shards`` rows in all
    open_ = [s for s in range(shards) if room[s]] or [0]
    ends = list(accumulate(room[s] for s in open_))
    others = known
    if plan:
        text = lambda x: ",".join(map(str, x))
        rows = [(h, text(s for s, _ in x), text(accumulate(k for _, k in x))) for h, x in plan.items()]
        table = local_frame(spark, rows, "hub bigint, _to string, _ends string")
        table = F.broadcast(table.select("hub", *[F.split(c, ",").cast("array<bigint>").alias(c) for c in ("_to", "_ends")]))
        others = known.join(table.select("hub"), "hub", "left_anti")
        ranked = gapless(known.join(table, "hub"), n, ["_row"], ["hub"], "_rank")
        place = F.size(F.filter("_ends", lambda b: b <= F.col("_rank")))
        placed = ranked.select("_row", "hub", F.element_at("_to", place + 1).cast("int").alias("shard"), F.lit(True).alias("placed"))
    ranked = gapless(others, n, ["_row"], [], "_rank")
    shard = F.element_at(F.array(*[F.lit(s) for s in open_]), _place(ends, F.col("_rank")) + 1)
    dealt = ranked.select("_row", "hub", shard.alias("shard"), F.lit(False).alias("placed"))
    return dealt.union(placed) if plan else dealt


def _exchangeable(parts: DataFrame) -> bool:
    """Whether two hubs could exchange documents between two shards, whichever way ties fall."""
    own = parts.groupBy("hub").agg(F.max("size").alias("_top"), F.collect_list(F.struct("shard", "size")).alias("_all"))
    part = own.select("hub", "_top", "_all", F.explode("_all").alias("p"))  # at most ``shards`` parts a hub
    to = F.explode(F.filter("_all", lambda x: (x["size"] == F.col("_top")) & (x["shard"] != F.col("p.shard")))).alias("q")
    part = part.select("p", "_top", to)
    ways = part.groupBy(F.col("p.shard").alias("s"), F.col("q.shard").alias("t")).agg(
        F.count_if(F.col("p.size") < F.col("_top")).alias("less"), F.count_if(F.col("p.size") == F.col("_top")).alias("tied"))
    found = {(r.s, r.t): (r.less, r.tied) for r in ways.collect()}  # at most shards ** 2
    for (s, t), (less, tied) in found.items():
        back = found.get((t, s), (0, 0))[0]
        if tied > 1 or (less and (back or tied)) or (back and tied):
            return True
    return False


def _send_back(fillers: DataFrame, surplus: Counter, counts: Counter, spark) -> DataFrame:
    """Unlinked documents leave the shards with a surplus and fill those with a deficit."""
    leaving = [(t, n) for t, n in sorted(surplus.items()) if n > 0]
    bounds, targets, total = [], [], 0
    for t, n in sorted(surplus.items()):
        if n < 0:
            total -= n
            bounds.append(total)
            targets.append(t)
    if not leaving:
        return fillers.withColumn("to", F.col("shard"))
    rows, at = [], 0
    for t, n in leaving:
        rows.append((t, n, at))
        at += n
    out = local_frame(spark, rows, "_s int, _n bigint, _at bigint")
    ranked = gapless(fillers, sum(counts.values()), ["_row"], ["shard"], "_rank")
    ranked = ranked.join(out, ranked["shard"] == out["_s"], "left")
    turn = F.col("_at") + F.col("_rank")
    target = F.element_at(F.array(*[F.lit(t) for t in targets]), _place(bounds, turn) + 1)
    return ranked.select(
        *fillers.columns, F.when(F.col("_rank") < F.col("_n"), target).otherwise(F.col("shard")).cast("int").alias("to")
    )


def propagate(items: DataFrame, scratch: Scratch, shards: int = SHARDS) -> DataFrame:
    """(_row, shard): ``items`` has a distinct ``_row`` and a ``hub`` (null: no neighbours).

    Counts of shards differ by at most one. It ends when no wish can be granted. As every document that moves goes
    to a larger part of its hub, or to one as large, the parts' squares grow with each round that grants any.
    """
    spark = items.sparkSession
    n = items.count()
    many = items.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = scratch.keep(many, "hubs")  # written, so that Spark can split a hub that holds much in the join
    known = items.select("_row", "hub").join(many.select(F.col("hub").alias("_hub")), F.col("hub") == F.col("_hub"), "left")
    known = known.select("_row", F.col("_hub").alias("hub"))
    first = scratch.keep(_deal(known, many, n, shards), "state0")
    placed = first.where("placed").select("_row", "shard")
    state, before = first.where("not placed").drop("placed"), None
    # unlinked documents of each shard: at most ``shards`` numbers, kept up to date by what the rounds move
    spare = Counter({r.shard: r["count"] for r in state.where("hub is null").groupBy("shard").count().collect()})
    turn, idle = 0, False
    while True:
        turn += 1
        linked, fillers = state.where("hub is not null"), state.where("hub is null")
        parts = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("size"))
        # the largest part whose shard can still take in documents, ties by a hash that differs by round: flows
        # then go both ways, and a wish that could not be granted may turn round; after a round without a grant
        # any largest part, as documents can still be exchanged between full shards
        full = [s for s in range(shards) if not spare[s]]
        any_ = idle or len(full) in (0, shards)
        open_ = F.lit(True) if any_ else ~F.col("shard").isin(full)
        order = F.struct("size", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")
        best = parts.groupBy("hub").agg(F.max(F.when(open_, order)).alias("best"))
        wish = parts.join(best, "hub").where((F.col("best.shard") != F.col("shard")) & (order < F.col("best")))
        wish = scratch.keep(wish.select("hub", "shard", F.col("best.shard").alias("to"), "size"), f"wishes{turn}")
        flows = wish.groupBy("shard", "to").agg(F.sum("size").alias("size")).collect()  # at most shards ** 2
        granted, surplus = _quotas(Counter({(r.shard, r.to): r["size"] for r in flows}), spare)
        if not granted:
            if any_ and (not flows or not _exchangeable(parts)):
                break
            idle = True
            continue
        idle = False
        quota = local_frame(spark, [(s, t, k) for (s, t), k in granted.items()], "shard int, to int, _k bigint")
        movers = linked.join(wish.drop("size"), ["hub", "shard"], "left").select("_row", "hub", "shard", "to")
        wishing = movers.where("to is not null")
        ranked = gapless(wishing, n, ["_row"], ["shard", "to"], "_rank").join(quota, ["shard", "to"], "left")
        moved = ranked.select("_row", "hub", F.when(F.col("_rank") < F.col("_k"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        back = _send_back(fillers, surplus, spare, spark).select("_row", "hub", F.col("to").alias("shard"))
        stay = movers.where("to is null").select("_row", "hub", "shard")
        state = scratch.keep(stay.union(moved).union(back), f"state{turn}")
        scratch.drop(f"wishes{turn}", *[before] * bool(before))
        before = f"state{turn}"
        spare.subtract(surplus)
    return state.select("_row", "shard").union(placed)


def shard_documents(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row in a shard; slots are gapless from 0 in each.

    Links are equal texts, by their 64-bit hash (a collision would only place two texts together). Null texts
    have no bytes and no neighbours; empty texts are equal texts. Repeated rows are placed one by one. An empty
    table stays empty. Of a text, however long, only size, crc32 and hash go on. Other columns are not read, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    items = docs.select(
        key, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hub"),
    )
    items = scratch.keep(with_row(items), "items")
    placed = items.join(propagate(items.select("_row", "hub"), scratch, shards), "_row")
    placed = scratch.keep(placed.select("_row", key, "size", "text_crc32", "shard"), "placed")
    return gapless(placed, placed.count(), ["_row"], ["shard"], "slot").select(key, "size", "text_crc32", "shard", "slot")
