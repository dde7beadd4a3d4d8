"""Spelling clusters: the dictionary that ``normalize_category`` needs, proposed from the data.

Values whose words are the same but for case, accents, punctuation, order and repetition share a key. Keys one edit apart (a
letter changed, left out, added or swapped with its neighbour) are a typo of the more frequent one, if it is frequent enough and
the digits agree. Neighbours are found without comparing pairs: keys that agree but for one position share a masked key, whose most
frequent member stands for all; a key without a letter, or with two swapped, is looked up. As each key points to a more frequent one,
clusters are trees, and doubling their pointers a fixed number of times finds the roots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions.text import strip
from tersa.operators.catalog import BROADCAST_MAPPING, TEXT, column_kinds
from tersa.plans.steps import Step
from tersa.sources.checkpoints import has_checkpoint_folder, reliable_checkpoint

# fixed values: accented letters and what they are without accents
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
#: Keys shorter than this have no typos, longer ones are no labels.
LEAST_LENGTH, MOST_LENGTH = 5, 64
#: How many times more often than its typo a value occurs at least.
RATIO = 4
#: Doublings of a pointer: a path over which counts grow fourfold, or twofold, has fewer than 64 links.
_DOUBLINGS = 6


def spelling_key(value: Column | str) -> Column:
    """Lower-case words without accents and punctuation, sorted, each once."""
    value = F.col(value) if isinstance(value, str) else value
    plain = F.translate(F.lower(value), ACCENTED, PLAIN)
    words = F.split(F.trim(F.regexp_replace(plain, r"[\p{Z}\p{P}\p{S}\p{C}]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def _kept(df: DataFrame) -> DataFrame:
    """Written, where the session names a folder: what several steps read is then computed once."""
    return reliable_checkpoint(df) if has_checkpoint_folder(df.sparkSession) else df


def _edited(i: Column, put: Column | None, cut: int) -> Column:
    """The key with the characters from the i-th on replaced by ``put`` and ``cut`` of them left out."""
    parts = [F.substring(F.col("key"), F.lit(1), i - 1), *([put] if put is not None else []), F.substring(F.col("key"), i + cut, F.length("key"))]
    return F.concat(*parts)


def _neighbours(nodes: DataFrame, ratio: int) -> DataFrame:
    """(column_name, key, parent): each key's most frequent neighbour that is frequent enough."""
    digits = F.regexp_replace("key", "[^0-9]+", " ")
    keys = nodes.where(F.length("key").between(LEAST_LENGTH, MOST_LENGTH)).select("column_name", "key", "n", digits.alias("digits"))
    at = keys.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("key"))))
    block = ["column_name", "digits", "edited"]
    masked = at.withColumn("edited", _edited(F.col("i"), F.lit("\u0001"), 1)).drop("i")
    leaders = masked.groupBy(*block).agg(F.max(F.struct("n", "key")).alias("other"), F.count(F.lit(1)).alias("members"))
    changed = masked.join(leaders.where("members > 1").drop("members"), block)
    known = keys.select("column_name", "digits", F.col("key").alias("edited"), F.struct("n", "key").alias("other"))
    dropped = at.withColumn("edited", _edited(F.col("i"), None, 1)).drop("i").distinct().join(known, block)
    swap = F.concat(F.substring(F.col("key"), F.col("i") + 1, F.lit(1)), F.substring(F.col("key"), F.col("i"), F.lit(1)))
    swapped = at.where("i < length(key)").withColumn("edited", _edited(F.col("i"), swap, 2)).drop("i").join(known, block)
    one_way = changed.unionByName(swapped).unionByName(dropped).select("column_name", F.struct("n", "key").alias("a"), F.col("other").alias("b"))
    back = dropped.select("column_name", F.col("other").alias("a"), F.struct("n", "key").alias("b"))
    pairs = one_way.unionByName(back).where((F.col("a.key") != F.col("b.key")) & (F.col("b.n") >= F.col("a.n") * ratio))
    return pairs.groupBy("column_name", F.col("a.key").alias("key")).agg(F.max("b")["key"].alias("parent"))


def _roots(parents: DataFrame) -> DataFrame:
    """(column_name, key, parent): the same with each key's last ancestor."""
    for _ in range(_DOUBLINGS):
        above = parents.select("column_name", F.col("key").alias("parent"), F.col("parent").alias("above"))
        parents = parents.join(above, ["column_name", "parent"], "left").select(
            "column_name", "key", F.coalesce("above", "parent").alias("parent")
        )
    return parents


def propose_mappings(df: DataFrame, columns: list[str] | None = None, ratio: int = RATIO) -> DataFrame:
    """(column_name, value, canonical, n, canonical_n, kind): values that are another spelling (``spelling``) or a typo of a label.

    The label of a cluster is the most frequent spelling (stripped of spaces at both ends; the smallest on a tie) of its most frequent key,
    canonical_n the rows of that key. ``columns`` are text columns, all of them by default. Null, empty and wordless values have no
    label. Values are grouped with map-side combine; no group of neighbours is ever gathered.
    """
    if ratio < 2:
        raise ValueError("INVALID_PARAMETER: a ratio below 2 does not tell a value from its typo")
    kinds = column_kinds(df)
    names = [c for c, kind in kinds.items() if kind == TEXT] if columns is None else columns
    for name in names:
        if kinds.get(name) != TEXT:
            raise ValueError(f"INVALID_COLUMN: '{name}' is no text column")
    if not names:
        raise ValueError("INVALID_COLUMN: the table has no text column")
    cells = F.stack(F.lit(len(names)), *[x for c in names for x in (F.lit(c), F.col(f"`{c}`"))]).alias("column_name", "value")
    values = df.select(cells).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("label", strip(F.col("value"))).withColumn("key", spelling_key("label")).where("key <> ''")
    values = _kept(values)
    labels = values.groupBy("column_name", "key", "label").agg(F.sum("n").alias("n"))
    first = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    nodes = _kept(labels.groupBy("column_name", "key").agg(F.sum("n").alias("n"), first.alias("canonical")))
    roots = _roots(_kept(_neighbours(nodes, ratio))).withColumnRenamed("parent", "root")
    ends = nodes.select("column_name", F.col("key").alias("root"), "canonical", F.col("n").alias("canonical_n"))
    rooted = values.select("column_name", "value", "n", "key").join(roots, ["column_name", "key"], "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key")).join(ends, ["column_name", "root"])
    kind = F.when(F.col("key") == F.col("root"), "spelling").otherwise("typo")
    return rooted.where("value <> canonical").select("column_name", "value", "canonical", "n", "canonical_n", kind.alias("kind"))


def mapping_steps(proposed: DataFrame, most: int = BROADCAST_MAPPING) -> list[Step]:
    """One ``normalize_category`` step for each column of the proposals; more than ``most`` values of a column are an error."""
    sizes = {r.column_name: r["count"] for r in proposed.groupBy("column_name").count().collect()}
    too_many = [c for c, n in sizes.items() if n > most]
    if too_many:
        raise ValueError(f"TOO_MANY_VALUES: {', '.join(sorted(too_many))}: join the proposals instead of a step")
    found: dict[str, dict[str, str]] = {c: {} for c in sorted(sizes)}
    for r in proposed.select("column_name", "value", "canonical").orderBy("column_name", "value").collect():
        found[r.column_name][r.value] = r.canonical
    return [Step("normalize_category", c, {"mappings": m}) for c, m in found.items()]


def apply_proposals(df: DataFrame, proposed: DataFrame) -> DataFrame:
    """The table with every proposed value replaced by its label; a join for each column, so any number of values will do."""
    columns = [c for c, kind in column_kinds(df).items() if kind == TEXT]

    def replaced(table: DataFrame, column: str) -> DataFrame:
        mine = proposed.where(F.col("column_name") == column).select(F.col("value").alias("__from"), F.col("canonical").alias("__to"))
        joined = table.join(mine, F.col(f"`{column}`") == F.col("__from"), "left")
        return joined.withColumn(column, F.coalesce("__to", F.col(f"`{column}`"))).drop("__from", "__to")

    return reduce(replaced, columns, df).select(*[F.col(f"`{c}`") for c in df.columns])
