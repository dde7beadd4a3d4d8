"""The value tables and the column facts that profile, quality and plans are derived from.

One scan turns the table into (column, value) cells and groups them: repeated values collapse
before the shuffle, so a value that fills a third of a column costs one row per task, and every
regex runs once per distinct value instead of once per row. All counts are then weighted sums
over those values, grouped by column. Typed columns (numbers, dates) keep their native values and
skip everything that only text can need.

``approx=True`` groups only the text columns that have few values: no wide shuffle, approximate distinct counts
and quantiles. It is the mode for tables with hundreds of high-cardinality columns.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.functions import dates, names, numbers, text
from tersa.functions import vocabulary as V
from tersa.operators.catalog import DATE, NUMBER, OTHER, TEXT, kind_of
from tersa.operators.selection import FEW_VALUES, exact_medians, grouped_medians, ordered_medians, shared
from tersa.sources.checkpoints import has_checkpoint_folder, reliable_checkpoint
from tersa.sources.files import row_number_in_files
from tersa.sources.local import local_frame

_NARROW_BYTES = 40
#: Hash buckets of a column's values whose first rows are kept to find the first values.
SAMPLE_BUCKETS = 4096
#: Approximate mode: distinct values of a column that is grouped take so many bytes at most.
FEW_BYTES = 16 << 20
#: Copies of a grouped number that one row stands for until sketches read them.
COPIES = 10_000


def weight(condition: Column) -> Column:
    """Rows that meet a condition, counted over the value table."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def seen(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def round2(x: Column) -> Column:
    return numbers.round_even(x, 2)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; 0 for an empty table."""
    return F.when(whole > 0, round2(part / whole * 100)).otherwise(F.lit(0.0))


class Analysis:
    """Lazy facts about one table.

    With ``materialize`` (the default if the session names a checkpoint folder) the distinct text values are
    written there when first asked for; facts, spelling variants and evidence then read them back
    instead of scanning and shuffling the table again.

    ``order_by`` names the column that defines row order; it decides which values count as the
    first ones. Without it the rows' order in the table's Parquet files does, however these are split; for
    other tables it is the order of the scan. ``date_standard`` is ``dominant`` (the most frequent
    format class of a column is its standard) or ``first`` (the class of its first value).
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: str | None = None,
        date_standard: str = "dominant",
        approx: bool = False,
        materialize: bool | None = None,
    ):
        if date_standard not in ("dominant", "first"):
            raise ValueError(f"INVALID_PARAMETER: unknown date standard '{date_standard}'")
        if not df.columns:
            raise ValueError("NO_COLUMNS_FOUND: the table has no columns")
        self.df = df
        self.order_by = order_by
        self.date_standard = date_standard
        self.approx = approx
        self.columns = df.columns
        self.kinds = [kind_of(f.dataType) for f in df.schema]
        self._has_decimals = any(isinstance(f.dataType, T.DecimalType) for f in df.schema)
        self._typed_keys = ["whole", "number", *["digits"] * self._has_decimals]
        if materialize is None:
            materialize = not approx and has_checkpoint_folder(df.sparkSession)
        self._materialize = materialize

    # --- cells ---------------------------------------------------------------------------------

    def _positions(self, *kinds: str) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in kinds]

    def _row(self) -> Column:
        return F.col(f"`{self.order_by}`") if self.order_by else row_number_in_files(self.df)

    def text_rows(self, positions: list[int] | None = None) -> DataFrame:
        """(row, position, text): one row per cell of the columns that are read as text, or of some of them."""
        parts = []
        for i in self._positions(TEXT, OTHER) if positions is None else positions:
            c = F.col(f"`{self.columns[i]}`")
            parts += [F.lit(i), c if self.kinds[i] == TEXT else c.cast("string")]
        return self._stack(parts, 2, "position", "text")

    def typed_rows(self) -> DataFrame:
        """(row, position, whole, number[, digits]): one row per cell of the number and date columns.

        Whole numbers and dates (as microseconds) travel as bigint, other numbers as double. If the table
        has decimals, their digits go besides: a double would make different ones equal.
        """
        parts = []
        for i in self._positions(NUMBER, DATE):
            field = self.df.schema[i]
            c = F.col(f"`{field.name}`")
            if self.kinds[i] == DATE:
                cell = [F.unix_micros(c.cast("timestamp")), F.lit(None).cast("double")]
            elif isinstance(field.dataType, T.IntegralType):
                cell = [c.cast("bigint"), F.lit(None).cast("double")]
            else:
                number = c.cast("double")
                cell = [F.lit(None).cast("bigint"), F.when(~F.isnan(number), number)]
            if self._has_decimals:
                digits = c if isinstance(field.dataType, T.DecimalType) else F.lit(None)
                cell.append(digits.cast("string"))
            parts += [F.lit(i), *cell]
        return self._stack(parts, 1 + len(self._typed_keys), "position", *self._typed_keys)

    def _stack(self, parts: list[Column], width: int, *names: str) -> DataFrame:
        stacked = F.stack(F.lit(len(parts) // width), *parts).alias(*names)
        return self.df.select(self._row().alias("row"), stacked)

    def _counted(self, cells: DataFrame, *value: str, grouped: bool) -> DataFrame:
        if not grouped:
            one = F.lit(1).cast("bigint").alias("n")
            return cells.select("position", *value, one, F.col("row").alias("first"))
        counted = cells.groupBy("position", *value).agg(
            F.count(F.lit(1)).alias("n"), F.min("row").alias("first")
        )
        return shared(counted, "position", *value)

    @cached_property
    def grouped_columns(self) -> list[int]:
        """The text columns whose equal values are grouped: all, or in approximate mode those of few and short values.

        These are found by one pass without any reading of the texts. Regexes then run once for each of their values.
        """
        columns = self._positions(TEXT, OTHER)
        if not self.approx or not columns:
            return columns
        size = self.text_rows().groupBy("position").agg(
            F.approx_count_distinct(F.xxhash64("text")).alias("values"), F.max(F.octet_length("text")).alias("longest")
        )
        few = (F.col("values") <= FEW_VALUES) & (F.col("values") * F.coalesce("longest", F.lit(0)) <= FEW_BYTES)
        return sorted(r.position for r in size.where(few).collect())

    def _text_parts(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The value tables of the grouped text columns and of the others."""
        rest = [i for i in self._positions(TEXT, OTHER) if i not in self.grouped_columns]
        return tuple(
            self._counted(self.text_rows(some), "text", grouped=grouped) if some else None
            for some, grouped in ((self.grouped_columns, True), (rest, False))
        )

    @cached_property
    def text_values(self) -> DataFrame:
        """(position, text, n, first): distinct text values with their count and first row.

        In approximate mode the cells of columns that are not grouped are rows of their own, with n = 1.
        """
        values = reduce(DataFrame.unionByName, [v for v in self._text_parts() if v is not None])
        return reliable_checkpoint(values) if self._materialize else values

    @cached_property
    def typed_values(self) -> DataFrame:
        """(position, whole, number, digits, n, first): the same for number and date columns."""
        return self._counted(self.typed_rows(), *self._typed_keys, grouped=not self.approx)

    @cached_property
    def text_cells(self) -> DataFrame:
        """Text values with everything that is read out of them, one projection per stage.

        The last stage is a generator: filters on what it yields are not pushed below it, where
        they would repeat the regexes.
        """
        return self._read_text(self.text_values)

    def _read_text(self, values: DataFrame) -> DataFrame:
        wordy = F.col("position").isin(self._positions(TEXT))
        t = F.col("t")
        return (
            values.withColumn("t", text.strip(F.col("text")))
            .withColumns({
                "low": F.lower("t"),
                "bare": F.when(wordy, numbers.bare_number_text(t)),
                "day": F.when(wordy, dates.read_stripped(t)),
            })
            .withColumn("number", numbers.number_from_bare(F.col("bare")))
            .select(
                "position", "text", "n", "first", "t", "low",
                F.inline(F.array(F.struct(
                    numbers.finite(F.col("number")).alias("number"),
                    dates.format_class(t, F.col("day")).alias("date_class"),
                    (F.col("low").isin(V.MISSING_MARKERS) | t.rlike(rf"^[-_—–{text.SPACE}]+$"))
                    .alias("marker"),
                    F.coalesce(t != "", F.lit(False)).alias("present"),
                ))),
            )
        )

    @cached_property
    def typed_cells(self) -> DataFrame:
        return self._read_typed(self.typed_values)

    def _read_typed(self, cells: DataFrame) -> DataFrame:
        """Adds ``filled`` and ``number`` (NULL for dates and infinities) to typed cells."""
        whole, number = F.col("whole"), F.col("number")
        if not self._has_decimals:
            cells = cells.withColumn("digits", F.lit(None).cast("string"))
        dated = F.col("position").isin(self._positions(DATE))
        return cells.withColumns({
            "filled": whole.isNotNull() | number.isNotNull(),
            "number": F.when(~dated, F.coalesce(whole.cast("double"), numbers.finite(number))),
            "real": number,
        })

    def typed_text(self) -> Column:
        """Text of a typed value, for samples."""
        dated = F.col("position").isin(self._positions(DATE))
        return (
            F.when(dated, F.timestamp_micros("whole").cast("string"))
            .otherwise(F.coalesce(F.col("whole").cast("string"), F.col("digits"), F.col("real").cast("string")))
        )

    def has(self, *kinds: str) -> bool:
        return bool(self._positions(*kinds))

    def materialize(self) -> Analysis:
        """Write the value tables to the session's checkpoint folder.

        Later results then read them back instead of scanning and shuffling the table again.
        """
        for name, kinds in (("text_values", (TEXT, OTHER)), ("typed_values", (NUMBER, DATE))):
            if self.has(*kinds):
                self.__dict__[name] = reliable_checkpoint(getattr(self, name))
        return self

    # --- facts ---------------------------------------------------------------------------------

    @cached_property
    def fact_rows(self) -> list[Row]:
        """Weighted counts, inferred type and semantic hint: one row per column of the table.

        These few rows are collected once. Everything after works on them as literals, so the
        later passes read only the columns and values that they need.
        """
        return self._fact_query.collect()

    @cached_property
    def _fact_query(self) -> DataFrame:
        parts = []
        if self.has(TEXT, OTHER):
            parts.append(self._text_facts())
        if self.has(NUMBER, DATE):
            parts.append(self._typed_facts())
        counted = reduce(DataFrame.unionByName, parts)
        if self.approx:
            counted = counted.drop("unique_count").join(F.broadcast(self._estimates()), "position")
        return self._classified(counted)

    @cached_property
    def facts(self) -> DataFrame:
        """The fact rows as a local DataFrame."""
        return local_frame(self.df.sparkSession, self.fact_rows, self._fact_query.schema)

    def _facts_where(self, condition: Column, *columns) -> DataFrame:
        """Selected facts, again as local rows (a handful, decided on the driver)."""
        chosen = self.facts.where(condition).select(*columns)
        return local_frame(self.df.sparkSession, chosen.collect(), chosen.schema)

    def _statistics(self) -> list[Column]:
        """Aggregates over ``number``, the same for text and typed columns."""
        number, n = F.col("number"), F.col("n")
        return [
            weight(number < 0).alias("negatives"),
            weight(number > 100).alias("over_hundred"),
            weight(number.isNotNull()).alias("numbers"),
            F.min("number").alias("lo"),
            F.max("number").alias("hi"),
            F.sum(number * n).alias("number_sum"),
        ]

    def _estimates(self) -> DataFrame:
        """Approximate mode: (position, unique_count, std, median), apart from the exact counts.

        Sketches run interpreted; in one aggregate with the counts they would slow all of them.
        """
        return self.sketch_cells().groupBy("position").agg(
            F.approx_count_distinct("value").alias("unique_count"),
            F.stddev_samp("number").alias("std"),
            F.percentile_approx("number", 0.5, 10000).alias("median"),
        )

    def sketch_cells(self) -> DataFrame:
        """(position, number, value): what sketches read. ``value`` is a hash, NULL for no value.

        A number comes once for each of its rows, grouped or not; a value that is no number may come once for all.
        """
        value = F.when(F.col("present"), F.xxhash64("text")).alias("value")
        grouped, rest = self._text_parts() if self.has(TEXT, OTHER) else (None, None)
        parts = []
        if rest is not None:
            parts.append(self._read_text(rest).select("position", "number", value))
        if grouped is not None:
            cells = self._read_text(grouped).select("position", "number", value, "n")
            parts.append(_copied(cells))
        if self.has(NUMBER, DATE):
            value = F.when(F.col("filled"), F.xxhash64(F.coalesce("whole", F.lit(0).cast("bigint")), "real", "digits"))
            parts.append(self.typed_cells.select("position", "number", value.alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def _text_facts(self) -> DataFrame:
        t, raw = F.col("t"), F.col("text")
        number, present, marker = F.col("number"), F.col("present"), F.col("marker")
        filled = raw.isNotNull()
        classes = [
            weight(F.col("date_class") == i + 1).alias(f"class_{i + 1}")
            for i in range(len(dates.FORMAT_CLASSES))
        ]
        sampled_symbols = text.contains_any(F.col("low"), V.PLANNER_NUMBER_SYMBOLS)
        planner_symbols = text.contains_any(raw, V.PLANNER_NUMBER_SYMBOLS)
        first_dated = F.when(F.col("date_class").isNotNull(), F.col("first"))
        return self.text_cells.groupBy("position").agg(
            F.sum("n").alias("rows"),
            weight(~present).alias("nulls"),
            weight(filled).alias("filled"),
            F.count_if(present).alias("unique_count"),
            weight(present & marker).alias("markers"),
            weight(present & number.isNotNull()).alias("parsed"),
            weight(present & ~F.lower(raw).isin(V.DATE_SAMPLE_ERROR_TOKENS)).alias("date_pool"),
            weight(present & ~text.is_boolean_token(raw)).alias("not_boolean"),
            seen(present & raw.contains("@")).alias("has_at"),
            seen(present & raw.contains("%")).alias("has_percent"),
            seen(present & text.contains_any(raw, V.CURRENCY_SYMBOLS)).alias("has_currency"),
            seen(present & text.is_code_token(t)).alias("has_code"),
            weight(filled & text.has_excess_whitespace(raw)).alias("excess_space"),
            weight(filled & text.is_all_caps(t)).alias("all_caps"),
            weight(filled & (marker | numbers.has_symbol(t) | number.isNull())).alias("dirty_numbers"),
            seen(filled & (marker | planner_symbols)).alias("number_marks"),
            seen(filled & (F.col("low").isin(V.SAMPLED_MARKERS) | sampled_symbols)).alias("sampled_marks"),
            F.coalesce(F.sum(F.octet_length("text") * F.col("n")), F.lit(0)).alias("text_bytes"),
            F.min_by("date_class", first_dated).alias("first_class"),
            *classes,
            *self._statistics(),
        )

    def _typed_facts(self) -> DataFrame:
        """Facts of typed columns straight from the rows: no value is shuffled.

        The distinct count is only bounded here (by the filled cells); the profile puts
        ``unique_counts`` in its place.
        """
        rows = self._read_typed(self.typed_rows().withColumn("n", F.lit(1).cast("bigint")))
        filled = F.col("filled")
        counted = rows.groupBy("position").agg(
            F.sum("n").alias("rows"),
            weight(~filled).alias("nulls"),
            weight(filled).alias("filled"),
            weight(filled).alias("unique_count"),
            weight(F.col("real").isNotNull() & F.col("number").isNull()).alias("dirty_numbers"),
            *self._statistics(),
        )
        zero, no = F.lit(0).cast("bigint"), F.lit(False)
        constants = {
            "markers": zero, "parsed": F.col("numbers"), "date_pool": F.col("filled"),
            "not_boolean": F.col("filled"), "has_at": no, "has_percent": no, "has_currency": no,
            "has_code": no, "excess_space": zero, "all_caps": zero, "number_marks": no,
            "sampled_marks": no, "text_bytes": F.col("filled") * 8,
            "first_class": F.lit(1), "class_1": F.col("filled"),
        }
        constants |= {f"class_{i}": zero for i in range(2, len(dates.FORMAT_CLASSES) + 1)}
        return counted.withColumns(constants)

    def _classified(self, counted: DataFrame) -> DataFrame:
        names_array = F.array(*[F.lit(c) for c in self.columns])
        kinds_array = F.array(*[F.lit(k) for k in self.kinds])
        slot = F.col("position") + 1
        named = counted.withColumns({"column_name": F.element_at(names_array, slot), "kind": F.element_at(kinds_array, slot)})
        return classified(named, self.date_standard)

    @cached_property
    def checked_facts(self) -> DataFrame:
        """The facts with ``case_variants``: the second small collect, shared by all quality results."""
        variants = {r.position: r.case_variants for r in self.case_variants().collect()}
        rows = [(*r, variants.get(r.position, 0)) for r in self.fact_rows]
        schema = T.StructType([*self._fact_query.schema, T.StructField("case_variants", T.LongType())])
        return local_frame(self.df.sparkSession, rows, schema)

    @cached_property
    def duplicates(self) -> DataFrame:
        """One row, counted once: rows, repeated rows and their share."""
        counted = duplicate_rows(self.df)
        return local_frame(self.df.sparkSession, counted.collect(), counted.schema)

    # --- derived per column ----------------------------------------------------------------------

    def unique_counts(self) -> DataFrame:
        """(position, exact_count): exact distinct counts of the typed columns."""
        return self.typed_cells.groupBy("position").agg(
            F.sum(F.when(F.col("filled"), 1).otherwise(0)).alias("exact_count")
        )

    def samples(self, k: int = 5) -> DataFrame:
        """(position, sample_values): the first k distinct non-blank values of each column.

        In approximate mode values are not grouped: only cells up to the row where the k-th value begins are.
        """
        parts = []
        if self.has(TEXT, OTHER):
            present = F.coalesce(text.strip(F.col("text")) != "", F.lit(False))
            parts.append(self.text_values.where(present).select("position", "text", "first", "n"))
        if self.has(NUMBER, DATE):
            shown = self.typed_text().alias("text")
            typed = self.typed_cells.where("filled").select("position", "whole", "real", "digits", "first", "n")
            parts.append(typed.select("position", shown, "first", "n"))
        values = reduce(DataFrame.unionByName, parts)
        window = Window.partitionBy("position").orderBy("first", "n", "text")
        return self._first_values(values, window, k) if self.approx else self._listed(values, window, k)

    def _first_values(self, values: DataFrame, window: Window, k: int) -> DataFrame:
        """The first k distinct values of ungrouped cells, in two passes that shuffle a fixed number of rows a task.

        The first pass finds the first row of each hash bucket of values. Whatever comes first in the k buckets that
        begin first has begun by the last of these rows, and all k values have; the second pass groups only the cells up to it.
        """
        bucket = F.pmod(F.xxhash64("text"), F.lit(SAMPLE_BUCKETS)).alias("bucket")
        begins = values.select("position", "first", bucket).groupBy("position", "bucket").agg(F.min("first").alias("first"))
        order = Window.partitionBy("position").orderBy("first")
        earliest = begins.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        limits = earliest.groupBy("position").agg(F.when(F.count("rank") == k, F.max("first")).alias("limit"))
        limits = limits.select(F.col("position").alias("_position"), "limit")  # one row a column
        near = values.join(F.broadcast(limits), F.col("position") == F.col("_position"))
        near = near.where(F.col("limit").isNull() | F.col("first").isNull() | (F.col("first") <= F.col("limit")))
        counted = near.groupBy("position", "text").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        return self._listed(counted, window, k)

    def _listed(self, values: DataFrame, window: Window, k: int) -> DataFrame:
        first = values.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        listed = F.array_sort(F.collect_list(F.struct("rank", "text")))["text"]
        return first.groupBy("position").agg(F.array_distinct(listed).alias("sample_values"))

    def _numbers(self, positions: list[int]) -> DataFrame:
        """(position, v, w): the numbers of some columns with their row counts."""
        parts = []
        chosen = F.col("position").isin(positions)
        if set(positions) & set(self._positions(TEXT)):
            parts.append(self.text_cells.where(chosen))
        if set(positions) & set(self._positions(NUMBER)):
            parts.append(self.typed_cells.where(chosen))
        columns = ["position", F.col("number").alias("v"), F.col("n").alias("w")]
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    def number_stats(self) -> DataFrame:
        """(position, mean, std, median) of the columns inferred as numeric."""
        numeric = (F.col("inferred_type") == "numeric") & (F.col("numbers") > 0)
        mean = (F.col("number_sum") / F.col("numbers")).alias("mean")
        if self.approx:
            std = F.coalesce("std", F.lit(0.0)).alias("std")
            return self._facts_where(numeric, "position", mean, std, "median")
        limits = self._facts_where(
            numeric, "position", F.col("numbers").alias("total"), mean
        )
        found = [r for r in self.fact_rows if r.inferred_type == "numeric" and r.numbers]
        if not found:
            return limits.select("position", "mean", F.col("mean").alias("std"), F.col("mean").alias("median"))
        spread = (
            self._numbers([r.position for r in found]).join(F.broadcast(limits), "position")
            .groupBy("position")
            .agg(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean"), 2)).alias("squares"))
        )
        typed = [r.position for r in found if self.kinds[r.position] == NUMBER]
        worded = [r for r in found if self.kinds[r.position] != NUMBER]
        parts = []
        if typed:
            cells = self._read_typed(self.typed_rows()).where(F.col("position").isin(typed))
            parts.append(grouped_medians(cells.select("position", F.col("number").alias("v")), "position"))
        for select, chosen in (
            (ordered_medians, [r.position for r in worded if r.unique_count <= FEW_VALUES]),
            (exact_medians, [r.position for r in worded if r.unique_count > FEW_VALUES]),
        ):
            if chosen:
                some = limits.drop("mean").where(F.col("position").isin(chosen))
                parts.append(select(self._numbers(chosen), some, "position"))
        medians = reduce(DataFrame.unionByName, parts)
        std = F.when(
            F.col("total") > 1, F.sqrt(F.col("squares") / (F.col("total") - 1))
        ).otherwise(F.lit(0.0))
        return (
            limits.join(spread, "position").join(medians, "position")
            .select("position", "mean", std.alias("std"), "median")
        )

    def case_variants(self) -> DataFrame:
        """(position, case_variants): stripped spellings minus spellings that differ without case.

        Exact in both modes. One shuffle on (column, lower-case value) serves both groupings, of
        spellings that each task has made distinct.
        """
        eligible = self._facts_where(wants_case_check(), "position")
        positions = [r.position for r in eligible.collect()]
        if not positions:
            return eligible.withColumn("case_variants", F.lit(0).cast("bigint"))
        spelled = (
            self.text_cells.where(F.col("position").isin(positions) & F.col("text").isNotNull())
            .select("position", "low", "t")
        )
        spellings = spelled.distinct() if self.approx else spelled.repartition("position", "low").distinct()
        extra = spellings.groupBy("position", "low").agg((F.count(F.lit(1)) - 1).alias("extra"))
        return extra.groupBy("position").agg(F.sum("extra").alias("case_variants"))


def _copied(cells: DataFrame) -> DataFrame:
    """Each row with a number ``n`` times, the others once.

    A row stands for ``COPIES`` of them at most while they are dealt to tasks, so that a frequent number is not one task's work.
    """
    last = F.when(F.col("number").isNotNull(), F.col("n") - 1).otherwise(F.lit(0).cast("bigint"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"), F.lit(COPIES).cast("bigint"))).alias("start")
    dealt = cells.withColumn("last", last).select("*", starts).repartition(cells.sparkSession.sparkContext.defaultParallelism)
    copies = F.least(F.col("last") - F.col("start") + 1, F.lit(COPIES)).cast("int")
    each = dealt.select("position", "number", "value", F.explode(F.array_repeat(F.lit(True), copies)).alias("copy"))
    return each.drop("copy")


# --- decisions on fact rows ------------------------------------------------------------------------


def classified(counted: DataFrame, date_standard: str = "dominant") -> DataFrame:
    """Adds the date standard, the inferred type and the semantic hint to counted facts with column_name and kind."""
    class_counts = F.array(*[F.col(f"class_{i + 1}") for i in range(len(dates.FORMAT_CLASSES))])
    top = F.array_max("class_counts")
    standard = (
        F.coalesce("first_class", F.lit(1))
        if date_standard == "first"
        else F.array_position("class_counts", top).cast("int")
    )
    labelled = (
        counted.withColumn("class_counts", class_counts)
        .withColumn("standard_class", standard)
        .withColumn("standard_dates", F.element_at("class_counts", F.col("standard_class")))
        .drop(*[f"class_{i + 1}" for i in range(len(dates.FORMAT_CLASSES))], "class_counts", "first_class")
    )
    return labelled.withColumn("inferred_type", infer_type()).withColumn("semantic_hint", semantic_hint())


def infer_type() -> Column:
    present = F.col("rows") - F.col("nulls")
    plain = present - F.col("markers")
    distinct = F.col("unique_count") + F.when(F.col("nulls") > 0, 1).otherwise(0)
    numeric = ((plain > 0) & (F.col("parsed") == plain)) | (F.col("parsed") >= present * 0.5)
    dated = (F.col("date_pool") > 0) & (F.col("standard_dates") > F.col("date_pool") * 0.6)
    few = (distinct < F.col("rows") * 0.25) & (distinct <= 30)
    return (
        F.when(present == 0, "text")
        .when(F.col("kind") == NUMBER, "numeric")
        .when((F.col("parsed") > 0) & numeric, "numeric")
        .when((F.col("kind") == DATE) | dated, "datetime")
        .when(F.col("not_boolean") == 0, "boolean")
        .when(few, "categorical")
        .otherwise("text")
    )


def semantic_hint() -> Column:
    name = F.col("column_name")
    return (
        F.when(F.col("rows") == F.col("nulls"), "unknown")
        .when(F.col("has_at") | names.has_word(name, ["email"]), "email")
        .when(F.col("has_percent") | names.is_percent_name(name), "percentage")
        .when(F.col("has_currency") | names.has_word(name, V.CURRENCY_WORDS), "currency")
        .when(names.has_word(name, V.DATE_WORDS) | (F.col("inferred_type") == "datetime"), "date")
        .when(F.col("has_code") | names.is_id_name(name, V.ID_WORDS_PROFILE), "id")
        .when(names.has_word(name, V.PHONE_WORDS), "phone")
        .when(names.has_word(name, V.NAME_WORDS), "name")
        .when(names.has_word(name, V.LOCATION_WORDS), "location")
        .otherwise("unknown")
    )


def wants_case_check() -> Column:
    """Text-like columns that are not identifiers."""
    identifier = (F.col("semantic_hint") == "id") | names.is_id_name(
        F.col("column_name"), V.ID_WORDS_QUALITY
    )
    wordy = F.col("inferred_type").isin("text", "categorical") | (F.col("semantic_hint") == "name")
    return ~identifier & wordy


# --- whole-row facts -------------------------------------------------------------------------------


def _encoded(kind: T.DataType, c: Column) -> Column:
    """Text that is equal where grouping finds the values equal: 0.0 and -0.0 are, and nested fields are named."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def row_key(df: DataFrame) -> list[Column]:
    """Columns that identify a row's content.

    A few fixed-width columns stand for themselves; anything wider is represented by the SHA-256
    of an unambiguous encoding, so 32 bytes per row are shuffled instead of the whole row.
    """
    widths = {
        T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
        T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.BooleanType: 1,
    }
    sizes = [widths.get(type(f.dataType)) for f in df.schema]
    columns = [F.col(f"`{c}`") for c in df.columns]
    if None not in sizes and sum(sizes) <= _NARROW_BYTES:
        return [c.alias(f"k{i}") for i, c in enumerate(columns)]
    parts = []
    for field, c in zip(df.schema, columns):
        s = _encoded(field.dataType, c)
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return [F.unhex(F.sha2(F.concat(*parts), 256)).alias("k0")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: row_count, duplicates_count (rows beyond the first of each kind), percentage."""
    key = row_key(df)
    groups = df.select(*key).groupBy(*[f"k{i}" for i in range(len(key))]).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_count"),
    )
    return total.withColumn(
        "duplicates_percentage", percentage(F.col("duplicates_count"), F.col("row_count"))
    )
