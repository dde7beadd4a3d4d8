"""Profiles that merge: what a part of a table says about its columns, kept small, so that an appended part is read alone.

A state has one row for each column of a part: counts, extremes, moments, first values, a HyperLogLog sketch of the distinct
values and a KLL sketch of the numbers. States of any number of parts add up to the profile of the whole table; only sketches
are estimates. A stored part is a partition of a Parquet table and can be profiled anew without touching the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.functions import dates
from tersa.operators.analysis import Analysis, classified
from tersa.operators.catalog import DATE, NUMBER, OTHER, TEXT
from tersa.operators.profile import profile_rows

#: Buckets of a distinct sketch as a power of two (standard error 0.8 %), size of a number sketch (rank error 0.3 %).
DISTINCT_BITS, QUANTILE_SIZE = 14, 1000
SAMPLES = 5
#: The row of a part that only says how many rows it has; it is there for an empty part too.
_TABLE = -1
_CLASSES = [f"class_{i + 1}" for i in range(len(dates.FORMAT_CLASSES))]
_SUMS = [
    "rows", "nulls", "filled", "markers", "parsed", "date_pool", "not_boolean", "excess_space", "all_caps", "dirty_numbers",
    "text_bytes", "negatives", "over_hundred", "numbers", "number_sum", *_CLASSES,
]
_FLAGS = ["has_at", "has_percent", "has_currency", "has_code", "number_marks", "sampled_marks"]


def profile_state(source: DataFrame | Analysis, part: str = "", order_by: str | None = None) -> DataFrame:
    """The state of one part: (part, position, column_name, kind, counts, lo, hi, mean, squares, sample_values, sketches).

    The row at position -1 counts the part's rows. Only the values of text columns with few of them are shuffled: for all
    else every task hands on one row a column.
    """
    df = source.df if isinstance(source, Analysis) else source
    analysis = Analysis(df, source.order_by if isinstance(source, Analysis) else order_by, approx=True)
    counted = []
    if analysis.has(TEXT, OTHER):
        counted.append(analysis._text_facts())
    if analysis.has(NUMBER, DATE):
        counted.append(analysis._typed_facts())
    facts = reduce(DataFrame.unionByName, counted).drop("unique_count")
    sketches = analysis.sketch_cells().groupBy("position").agg(
        F.hll_sketch_agg("value", DISTINCT_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double("number", F.lit(QUANTILE_SIZE)).alias("number_sketch"),
        F.avg("number").alias("mean"), (F.var_pop("number") * F.count("number")).alias("squares"),
    )
    names = F.array(*[F.lit(c) for c in analysis.columns])
    kinds = F.array(*[F.lit(k) for k in analysis.kinds])
    columns = (
        facts.join(sketches, "position").join(analysis.samples(SAMPLES), "position", "left")
        .withColumns({
            "part": F.lit(part), "column_name": F.element_at(names, F.col("position") + 1),
            "kind": F.element_at(kinds, F.col("position") + 1),
        })
    )
    table = df.agg(F.count(F.lit(1)).alias("rows")).withColumns({"part": F.lit(part), "position": F.lit(_TABLE)})
    return columns.unionByName(table, allowMissingColumns=True)


def merge_states(states: DataFrame, part: str = "") -> DataFrame:
    """One state of all the parts of ``states``, under the name ``part``.

    Parts must have the same columns: another name or kind at a position is an error. First values and first date
    formats are those of the first part by name that has some.
    """
    n, mean = F.col("numbers"), F.col("mean")
    same = F.count_distinct("column_name", "kind") <= 1
    name = F.when(same, F.min("column_name")).otherwise(F.raise_error(F.concat(
        F.lit("INCOMPATIBLE_PARTS: position "), F.first("position").cast("string"), F.lit(" is not one column in all parts")
    )).cast("string"))
    samples = F.array_sort(F.collect_list(F.when(F.col("sample_values").isNotNull(), F.struct("part", "sample_values"))))
    moments = F.collect_list(F.when(n > 0, F.struct(n.alias("n"), mean.alias("mean"), F.col("squares").alias("squares"))))
    merged = states.groupBy("position").agg(
        name.alias("column_name"), F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in _SUMS],
        *[F.bool_or(c).alias(c) for c in _FLAGS], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min_by("first_class", F.when(F.col("first_class").isNotNull(), F.col("part"))).alias("first_class"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
        samples.alias("samples"), moments.alias("moments"),
    )
    merged = merged.withColumn("mean", F.when(F.size("moments") > 0, _weighted_mean(F.col("moments"))))
    distinct = F.array_distinct(F.flatten(F.transform("samples", lambda s: s["sample_values"])))
    return merged.select(
        F.lit(part).alias("part"), "position", "column_name", "kind", *_SUMS, *_FLAGS, "lo", "hi", "first_class", "distinct_sketch",
        "number_sketch", "mean", F.when(F.size("moments") > 0, _all_squares(F.col("moments"), F.col("mean"))).alias("squares"),
        F.when(F.size("samples") > 0, F.slice(distinct, 1, SAMPLES)).alias("sample_values"),
    )


def _weighted_mean(moments: Column) -> Column:
    total = F.aggregate(moments, F.lit(0).cast("bigint"), lambda sum_, m: sum_ + m["n"])
    return F.aggregate(moments, F.lit(0.0), lambda sum_, m: sum_ + m["mean"] * (m["n"] / total))


def _all_squares(moments: Column, mean: Column) -> Column:
    """Squared distances from the common mean: each part's own, and its mean's distance for each of its rows."""
    return F.aggregate(moments, F.lit(0.0), lambda sum_, m: sum_ + m["squares"] + m["n"] * F.pow(m["mean"] - mean, F.lit(2.0)))


def profile_of_states(states: DataFrame, date_standard: str = "dominant") -> DataFrame:
    """The profile of all parts together, with the columns of ``profile``; what rests on sketches is estimated.

    Counts, extremes, mean, std and first values are exact; unique_count (and the types and warnings that rest on it) and
    median are estimates.
    """
    merged = merge_states(states).where(F.col("position") != _TABLE)
    counted = merged.withColumns({
        "unique_count": F.hll_sketch_estimate("distinct_sketch"),
        "median": F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("number_sketch", F.lit(0.5))),
        "std": F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1))).otherwise(F.lit(0.0)),
    })
    facts = classified(counted, date_standard)
    numeric = (F.col("inferred_type") == "numeric") & (F.col("numbers") > 0)
    return profile_rows(facts.withColumns({c: F.when(numeric, F.col(c)) for c in ("mean", "median", "std")}), True)


class ProfileStore:
    """The states of a table's parts, as a Parquet table partitioned by part in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, source: DataFrame | Analysis, part: str, order_by: str | None = None) -> None:
        """Profile a part and keep its state; a state of that part that is there already is replaced."""
        if not part:
            raise ValueError("INVALID_PARAMETER: a part needs a name")
        state = profile_state(source, part, order_by)
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def states(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("part", F.col("part").cast("string"))

    def parts(self) -> DataFrame:
        """(part, rows) of the parts that are kept."""
        return self.states().where(F.col("position") == _TABLE).select("part", "rows")

    def profile(self, date_standard: str = "dominant") -> DataFrame:
        return profile_of_states(self.states(), date_standard)
