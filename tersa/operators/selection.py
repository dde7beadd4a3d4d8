"""Exact medians that never gather a column's values into one task.

``median``/``percentile`` keep every distinct value of a group in one aggregation buffer. ``grouped_medians`` selects
with pivots instead: a quantile sketch gives two splitters round the middle of each group, and one more pass counts what
lies outside and keeps what lies between, a few values in ten thousand. Both passes combine on the map side.

``exact_medians`` is for weighted values. A value is a 64-bit number that orders like it (its exponent, then its
mantissa). Four counting passes find 16 bits each, with at most 65 536 counters per group, however the values are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW_VALUES = 65_536
#: A splitter's rank is off by at most one row in so many; the bracket leaves room for four times that.
SKETCH_ACCURACY = 10_000
_MARGIN = 4 / SKETCH_ACCURACY
#: Equal parts of a bracket, so that no task sorts all that lies in it.
_PARTS = 1024
#: Hash buckets by which frequent values are found, and how many more than asked for are counted at once.
BUCKETS, SPARE_BUCKETS = 4096, 16
#: Values of so many bytes are grouped by themselves.
GROUP_BYTES = 256 << 20
_LEAST = -1022  # the exponent of zero and of all numbers below the normal ones


def shared(df: DataFrame, *keys: str) -> DataFrame:
    """Let several consumers of an aggregate share one shuffle.

    Catalyst would prune the columns that a consumer does not need, or push its filters below the
    grouping; the consumers' exchanges would then differ and the source would be scanned and
    shuffled once for each. Tying the keys to all other columns by a test that always holds keeps
    the exchanges equal, so that Spark re-uses the first.
    """
    others = [c for c in df.columns if c not in keys]
    always = F.xxhash64(*others) >= F.lit(-(2**63))
    return df.withColumns({k: F.when(always, F.col(k)) for k in keys})


def _with_order(values: DataFrame) -> DataFrame:
    """Adds ``order``: a bigint that orders as the finite doubles of ``v`` do, one for each of them.

    Powers of two and divisions by them are exact, so no two values share a number; the logarithm
    only guesses the exponent, which is then put right.
    """
    size = F.abs("v")
    guess = F.greatest(F.lit(_LEAST), F.least(F.lit(1023), F.floor(F.log2("size")).cast("int")))
    sized = values.withColumn("size", size).withColumn("guess", F.coalesce(guess, F.lit(_LEAST)))
    power = lambda e: F.pow(F.lit(2.0), e)
    right = (
        F.when((F.col("guess") > _LEAST) & (F.col("size") < power(F.col("guess"))), F.col("guess") - 1)
        .when(F.col("size") >= power(F.col("guess") + 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    exact = sized.withColumn("exponent", right).withColumn("part", F.col("size") / power(F.col("exponent")))
    # part lies in [1, 2), or in [0, 1) below the normal numbers
    fraction = ((F.col("part") - F.when(F.col("part") >= 1, 1.0).otherwise(0.0)) * float(2**52)).cast("bigint")
    step = F.when(F.col("part") >= 1, F.col("exponent") - _LEAST + 1).otherwise(0).cast("bigint")
    whole = F.shiftleft(step, 52) + fraction
    order = F.when(F.col("v") < 0, -whole - 1).otherwise(whole)
    return exact.withColumn("order", order).drop("size", "guess", "exponent", "part")


def _pick(counted: DataFrame, group: list[str], order: str, before: Column, keep: list[str]) -> DataFrame:
    """Rows of ``counted`` in which the running weight first reaches the wanted rank."""
    upto = F.sum("w").over(
        Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("upto", before + upto).withColumn("below", F.col("upto") - F.col("w"))
    hit = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    return ranked.where(hit).select(*keep, "below")


def _middle_ranks(total: Column) -> Column:
    return F.array_distinct(
        F.array(F.floor((total + 1) / 2).cast("bigint"), F.floor(total / 2 + 1).cast("bigint"))
    )


def _wanted_ranks(limits: DataFrame, key: str) -> DataFrame:
    """(key, rank): the one or two middle ranks of each key."""
    return limits.select(key, F.explode(_middle_ranks(F.col("total"))).alias("rank"))


def ordered_medians(values: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Like ``exact_medians``, for keys with few distinct values (about ``FEW_VALUES``): one pass."""
    counted = values.where(F.col("v").isNotNull()).groupBy(key, "v").agg(F.sum("w").alias("w"))
    ranked = counted.join(F.broadcast(_wanted_ranks(limits, key)), key)
    hit = _pick(ranked, [key, "rank"], "v", F.lit(0), [key, "v"])
    return hit.groupBy(key).agg(F.avg("v").alias("median"))


def exact_medians(values: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Median of ``v`` weighted by ``w`` per ``key``.

    ``values``: (key, v double, w bigint); NULLs are ignored. ``limits``: (key, total), one row per key;
    the number of keys must be small (profiled columns), as ``limits`` is broadcast.
    """
    known = _with_order(values.where(F.col("v").isNotNull()))
    # No group has a prefix at first; each pass adds 16 bits to the prefix of the wanted ranks.
    hit = _wanted_ranks(limits, key).withColumns({"prefix": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint")})
    for done in (64, 48, 32, 16):
        own = F.shiftright("order", done).alias("prefix") if done < 64 else F.lit(0).cast("bigint").alias("prefix")
        bits = F.shiftright("order", done - 16)
        # The top bits keep their sign, so that negative values come first.
        bits = bits if done == 64 else bits.bitwiseAND(F.lit(65535).cast("bigint"))
        inside = known.select(key, "v", "w", own, bits.alias("bits")).join(F.broadcast(hit), [key, "prefix"])
        counted = inside.groupBy(key, "rank", "prefix", "below", "bits").agg(F.sum("w").alias("w"), F.min("v").alias("v"))
        counted = counted.withColumnRenamed("below", "base")
        found = _pick(counted, [key, "rank"], "bits", F.col("base"), [key, "rank", "prefix", "bits", "v"])
        prefix = F.col("bits") if done == 64 else F.shiftleft("prefix", 16) + F.col("bits")
        hit = found.select(key, "rank", prefix.alias("prefix"), "below", "v")
        if done > 16:
            hit = hit.drop("v")
    return hit.groupBy(key).agg(F.avg("v").alias("median"))


def splitters(numbers: DataFrame, key: str) -> DataFrame:
    """(key, total, low, high): values whose ranks lie closely below and above each group's middle; one sketch a task."""
    around = F.percentile_approx("v", [0.5 - _MARGIN, 0.5 + _MARGIN], SKETCH_ACCURACY)
    found = numbers.groupBy(key).agg(F.count("v").alias("total"), around.alias("around"))
    return found.select(key, "total", F.col("around")[0].alias("low"), F.col("around")[1].alias("high"))


def bracketed(numbers: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """(key, total, part, v, w): the distinct values between the splitters with their counts.

    Parts cut the bracket into equal widths, in the order of the values; all that lies below or above is one row
    without a value, in the first or the last part.
    """
    placed = numbers.join(F.broadcast(bounds), key)  # one row of bounds for each key
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    placed = placed.withColumn("side", side).withColumn("v", F.when(F.col("side") == 0, F.col("v")))
    counted = placed.groupBy(key, "total", "low", "high", "side", "v").agg(F.count(F.lit(1)).alias("w"))
    # halves, so that the width of a bracket cannot overflow
    share = (F.col("v") / 2 - F.col("low") / 2) / F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))
    part = F.coalesce(F.least(F.floor(share * _PARTS), F.lit(_PARTS)), F.lit(0)) + F.col("side") * (_PARTS + 1)
    return shared(counted.select(key, "total", part.cast("int").alias("part"), "v", "w"), key, "part", "v")


def grouped_medians(numbers: DataFrame, key: str = "k") -> DataFrame:
    """(key, median): the exact medians of (key, v), NULLs ignored. Keys are few (columns): their splitters are broadcast.

    A middle outside its bracket would break the sketch's promise of accuracy; that is an error, not another value.
    """
    known = numbers.select(key, "v").where(F.col("v").isNotNull())
    values = bracketed(known, splitters(known, key), key)
    parts = values.groupBy(key, "total", "part").agg(F.sum("w").alias("w"))
    parts = parts.select(key, "part", "w", F.explode(_middle_ranks(F.col("total"))).alias("rank"))
    part = _pick(parts, [key, "rank"], "part", F.lit(0), [key, "rank", "part"])
    part = part.withColumnRenamed("below", "base")
    inside = values.select(key, "part", "v", "w").join(F.broadcast(part), [key, "part"])
    hit = _pick(inside, [key, "rank"], "v", F.col("base"), [key, "rank", "v"])
    sound = F.when(F.count_if(F.col("v").isNull()) == 0, F.avg("v"))
    broken = F.raise_error(F.lit("INEXACT_SKETCH: a median lies outside its bracket")).cast("double")
    return hit.groupBy(key).agg(sound.alias("median")).select(key, F.coalesce("median", broken).alias("median"))


def column_median(df: DataFrame, number: Column) -> DataFrame:
    """One row, one column ``median``: the exact median of a numeric expression."""
    return grouped_medians(df.select(F.lit(1).alias("k"), number.alias("v"))).agg(F.max("median").alias("median"))


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def frequent_values(values: DataFrame, k: int, key: str = "k", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, v, n, rank): the k most frequent non-null values of each key, the smaller value first on a tie; exact.

    If Spark estimates the values at ``group_bytes`` or less, they are grouped: no more than that can be shuffled. Else values are
    not shuffled. A first pass counts hash buckets, at most ``BUCKETS`` small rows a task; no value occurs more
    often than its bucket. Values of the fullest buckets are counted, and then those of other buckets only if their count
    reaches the k-th value found: where none does, the last pass is empty and Spark skips it. Keys are few (columns).
    """
    known = values.select(key, "v").where(F.col("v").isNotNull())
    best = Window.partitionBy(key).orderBy(F.desc("n"), "v")
    if _estimated_bytes(known) <= group_bytes:
        grouped = known.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
        return grouped.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    known = known.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(BUCKETS)).cast("int"))
    buckets = known.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "bucket"))
    buckets = shared(buckets, key, "bucket").withColumn("place", place)  # at most BUCKETS rows a key
    wanted = F.col("place") <= k + SPARE_BUCKETS

    def counted(chosen: DataFrame) -> DataFrame:
        inside = known.join(F.broadcast(chosen.select(key, "bucket")), [key, "bucket"], "left_semi")
        return inside.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))

    first = shared(counted(buckets.where(wanted)), key, "v")
    first = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    floors = first.where(F.col("rank") == k).select(F.col(key).alias("_key"), F.col("n").alias("least"))
    open_ = buckets.where(~wanted).join(F.broadcast(floors), F.col(key) == F.col("_key"), "left")
    rest = counted(open_.where(F.col("n") >= F.coalesce("least", F.lit(0))))
    found = first.drop("rank").unionByName(rest)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def most_frequent(df: DataFrame, value: Column) -> DataFrame:
    """One row, one column ``value``: the most frequent non-null value, smallest on a tie."""
    values = df.select(F.lit(0).alias("k"), value.alias("v"))
    if _estimated_bytes(values) <= GROUP_BYTES:
        counted = values.where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.orderBy(F.desc("n"), F.asc("v")).limit(1)
    else:
        top = frequent_values(values, 1, group_bytes=0)
    return top.agg(F.max("v").alias("value"))
