"""What differs between two versions of a table, by key, joining only what differs.

Every row falls into one of ``BRANCHES ** 2`` leaves by a hash of its key. Two levels of order-insensitive multiset hashes (row count,
xor and sum of row hashes) tell which branches, and within those which leaves, differ: two small tables, whatever the size of the
versions. Only rows of leaves that differ are grouped by key and joined; equal parts are read, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.sources.hygiene import row_hash

#: Branches of the tree, and leaves of each branch.
BRANCHES = 4096
_SIDES = ("before", "after")


def _placed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows under ``row`` with their branch, leaf and hash; any column names may be there."""
    kept = df.select(*[F.col(f"`{c}`") for c in columns])
    key = row_hash(kept.select(*[F.col(f"`{c}`") for c in keys]))
    place = F.pmod(F.xxhash64(key, F.lit("leaf")), F.lit(BRANCHES * BRANCHES))
    return kept.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.floor(place / BRANCHES).cast("int").alias("branch"),
        (place % BRANCHES).cast("int").alias("leaf"), row_hash(kept).alias("hash"),
    )


def _digest(rows: DataFrame, *by: str) -> DataFrame:
    """One multiset hash for each node; sums are 38 digits wide, so they cannot overflow."""
    return rows.groupBy(*by).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("hash").alias("xor"), F.sum(F.col("hash").cast("decimal(38,0)")).alias("sum")).alias("digest")
    )


def _differing(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    one, two = (_digest(side, *by).withColumnRenamed("digest", name) for side, name in ((before, "one"), (after, "two")))
    return one.join(two, list(by), "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(*by)


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(branch, leaf) of the leaves whose rows differ; only branches that differ are looked into."""
    branches = F.broadcast(_differing(before, after, "branch"))  # at most BRANCHES rows
    inside = [side.join(branches, "branch", "left_semi") for side in (before, after)]
    return _differing(*inside, "branch", "leaf")


def _by_key(rows: DataFrame, keys: list[str], columns: list[str], side: str) -> DataFrame:
    """One row a key: how many rows, and for each column a multiset hash of its values."""
    def total(name: str) -> Column:
        value = F.col("row").getField(name)
        return F.sum(F.xxhash64(value, value.isNull()).cast("decimal(38,0)"))

    values = F.array(*[total(c) for c in columns]).alias(f"{side}_values")
    whole = F.sum(F.col("hash").cast("decimal(38,0)")).alias(f"{side}_rows")
    named = [F.col("row").getField(k).alias(f"key{i}") for i, k in enumerate(keys)]
    names = [f"key{i}" for i in range(len(keys))]
    return rows.select("row", "hash", *named).groupBy(*names).agg(F.count(F.lit(1)).alias(f"{side}_n"), values, whole)


def compare_tables(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(the keys, status, changed_columns, rows_before, rows_after): the keys that differ between two versions of a table.

    status: ``added``, ``removed`` or ``changed``. A key that repeats is compared as the multiset of its rows, a null is a key like any other. Columns that only one
    version has are not compared; ``changed_columns`` names the others whose values differ (empty if the same values are
    only paired differently). Versions that are equal give no rows.
    """
    columns = [c for c in before.columns if c in set(after.columns)]
    for key in keys:
        if key not in columns:
            raise ValueError(f"INVALID_COLUMN: key '{key}' is not in both tables")
    if not keys:
        raise ValueError("INVALID_PARAMETER: a comparison needs a key")
    kinds = [{f.name: f.dataType for f in df.schema} for df in (before, after)]
    other = [c for c in columns if kinds[0][c] != kinds[1][c]]
    if other:
        raise ValueError(f"INVALID_COLUMN: {other} have another type in the other table")
    rest = [c for c in columns if c not in keys]
    sides = [_placed(df, keys, columns) for df in (before, after)]
    leaves = differing_leaves(*sides)
    one, two = (
        _by_key(side.join(leaves, ["branch", "leaf"], "left_semi"), keys, rest, name) for side, name in zip(sides, _SIDES)
    )
    names = [f"key{i}" for i in range(len(keys))]
    same = [one[k].eqNullSafe(two[k]) for k in names]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    both = one.join(two, condition, "full").select(
        *[F.when(F.col("before_n").isNotNull(), one[k]).otherwise(two[k]).alias(k) for k in names],
        *[f"{side}_{x}" for side in _SIDES for x in ("n", "values", "rows")],
    )
    differ = both.where(~F.col("before_n").eqNullSafe(F.col("after_n")) | ~F.col("before_rows").eqNullSafe(F.col("after_rows")))
    status = F.when(F.col("before_n").isNull(), "added").when(F.col("after_n").isNull(), "removed").otherwise("changed")
    changed = F.filter(
        F.transform(
            F.arrays_zip(F.array(*[F.lit(c) for c in rest]).alias("name"), F.col("before_values").alias("a"), F.col("after_values").alias("b")),
            lambda x: F.when(x["a"] != x["b"], x["name"]),
        ),
        lambda x: x.isNotNull(),
    ) if rest else F.array()
    none = F.array().cast("array<string>")
    return differ.select(
        *[F.col(k).alias(name) for k, name in zip(names, keys)], status.alias("status"),
        F.when(status == "changed", F.coalesce(changed.cast("array<string>"), none)).otherwise(none).alias("changed_columns"),
        F.coalesce("before_n", F.lit(0)).alias("rows_before"), F.coalesce("after_n", F.lit(0)).alias("rows_after"),
    )
