"""Run a cleaning plan as one lazy DataFrame, with a per-step audit.

Consecutive row steps are fused: the n-th stage of every column goes into the n-th projection, so
a plan of hundreds of steps is a handful of projections. Only steps that need an aggregate of the
current table (mean, median, mode) or that remove rows start a new segment.

The audit is lazy: one ordinary aggregate for each segment. ``Execution.watched`` counts on the write instead. All flags behind
the last step that removes rows ride to the end of the plan and are observed there, in the stage that writes: Spark takes the
metrics of a result task once, however often it is retried or a map stage before it is run again. Segments before such
a step keep their aggregate. What a dedup drops is the difference of its neighbours' row counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from time import perf_counter

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tersa.operators import catalog
from tersa.plans.steps import Step, numbered, plan_from_json
from tersa.sources.checkpoints import has_checkpoint_folder, reliable_checkpoint
from tersa.sources.files import write_clean
from tersa.sources.hygiene import count_empty_rows, drop_empty_rows, empty_row_counts, fingerprint
from tersa.sources.local import local_frame

AUDIT_COLUMNS = (
    "position int, step_id string, operation string, column string, status string, "
    "rows bigint, modified bigint, converted bigint, invalid bigint, message string"
)


@dataclass
class Watched:
    """The clean table, to be written once and whole, and its audit, to be asked for after that.

    ``audit`` waits for the write; it reads what the write counted, and aggregates only what lies before a dedup.
    """

    frame: DataFrame
    audit: Callable[[], DataFrame]


@dataclass
class Execution:
    """Outcome of a plan: everything is lazy until written or shown."""

    source: DataFrame
    frame: DataFrame
    audit: DataFrame
    applied: list[Step]
    skipped: list[Step]
    errors: list[tuple[Step, str]] = field(default_factory=list)
    _watch: Callable[[], Watched] | None = None

    def watched(self) -> Watched:
        """The table with counters for the audit on it; each call gives a table for one write."""
        if self._watch is None:
            raise ValueError("INVALID_PARAMETER: a stream is written without an audit")
        return self._watch()

    @property
    def status(self) -> str:
        return "completed_with_errors" if self.errors else "completed"

    def summary(self, written: DataFrame | None = None) -> DataFrame:
        """One row: sizes, fingerprints, step counts and status, before and after.

        ``written``: the clean table as read back, so that the plan does not run again.
        """
        clean = self.frame if written is None else written
        before, after = fingerprint(self.source), fingerprint(clean)
        b = before.select(F.struct("*").alias("b")).scalar()
        a = F.struct("*")
        return after.select(a.alias("a"), b.alias("b")).select(
            F.col("b.row_count").alias("rows_before"),
            F.col("a.row_count").alias("rows_after"),
            F.lit(len(self.source.columns)).cast("bigint").alias("columns_before"),
            F.lit(len(self.frame.columns)).cast("bigint").alias("columns_after"),
            F.lit(len(self.applied)).cast("bigint").alias("applied_steps"),
            F.lit(len(self.skipped)).cast("bigint").alias("skipped_steps"),
            F.lit(len(self.errors)).cast("bigint").alias("failed_steps"),
            _hash_text("b").alias("fingerprint_before"),
            _hash_text("a").alias("fingerprint_after"),
            F.lit(self.status).alias("status"),
        )


def _hash_text(side: str) -> Column:
    return F.concat_ws(
        "-", F.coalesce(F.hex(f"{side}.hash_xor"), F.lit("0")),
        F.coalesce(F.col(f"{side}.hash_sum"), F.lit("0")),
    )


class _Segment:
    """Row and schema steps that share projections over one base table.

    ``link`` makes the base from the table of the segment before; it is None where rows were removed in between.
    """

    def __init__(self, base: DataFrame, hidden: set[str] = frozenset(), link: Callable[[DataFrame], DataFrame] | None = None):
        self.base, self.link = base, link
        self.names = {c: c for c in base.columns if c not in hidden}  # visible name -> physical column
        self.kinds = catalog.column_kinds(base)
        self.layers: list[dict[str, Column]] = []
        self.flags: list[dict[str, Column]] = []
        self.depth: dict[str, int] = {}
        self.audited: list[tuple[int, Step, list[str]]] = []
        self.total = ""  # the name of its totals in the audit

    @classmethod
    def mapped(cls, df: DataFrame, position: int, step: Step, kind: str, params: dict) -> _Segment:
        """A segment that begins with a large dictionary: the value before rides along for the count."""
        saved = f"__before_{position}"
        link = lambda table: catalog.map_large_category(table, step.target, params["mappings"], saved)
        segment = cls(link(df), {saved}, link)
        changed = catalog.get_operation(step.operation).changed
        flag = changed(F.col(saved), F.col(f"`{step.target}`"), kind, params)
        segment.flags[segment._layer(0)][f"__modified_{position}"] = flag
        segment.audited.append((position, step, ["modified"]))
        return segment

    def visible_kinds(self) -> dict[str, str]:
        return {name: self.kinds[phys] for name, phys in self.names.items()}

    def _layer(self, i: int) -> int:
        while len(self.layers) <= i:
            self.layers.append({})
            self.flags.append({})
        return i

    def add(self, position: int, step: Step, params: dict) -> None:
        op = catalog.get_operation(step.operation)
        target = step.target
        if op.shape == "schema":
            phys = self.names[target]
            if step.operation == "drop_column":
                del self.names[target]
            else:
                self.names = {
                    (params["new_name"] if n == target else n): p for n, p in self.names.items()
                }
            self.audited.append((position, step, []))
            return
        phys = self.names[target]
        kind = self.kinds[phys]
        c = F.col(f"`{phys}`")
        stages = op.stages(kind, params) or [lambda x: x]
        start = self.depth.get(phys, 0)
        last = start + len(stages) - 1
        before = c
        if len(stages) > 1:
            # The value before the step rides along until the last stage has run.
            saved = f"__before_{position}"
            self.flags[self._layer(start)][saved] = c
            before = F.col(saved)
        for i, stage in enumerate(stages):
            self.layers[self._layer(start + i)][phys] = stage(c)
        after = stages[-1](c)
        flags = {"modified": op.changed(before, after, kind, params)}
        if step.operation == "convert_datetime":
            flags["converted"] = after.isNotNull()
            flags["invalid"] = before.isNotNull() & after.isNull()
        for name, flag in flags.items():
            self.flags[last][f"__{name}_{position}"] = flag
        self.depth[phys] = last + 1
        self.kinds[phys] = op.result_kind(kind, params)
        self.audited.append((position, step, list(flags)))

    def _project(self, with_flags: bool, base: DataFrame | None = None) -> DataFrame:
        df = self.base if base is None else base
        for layer, flags in zip(self.layers, self.flags):
            df = df.withColumns({**layer, **flags} if with_flags else layer)
        return df

    def frame(self) -> DataFrame:
        df = self._project(with_flags=False)
        return df.select(*[F.col(f"`{p}`").alias(n) for n, p in self.names.items()])

    def counts(self) -> dict[str, str]:
        """What the steps count: name in the totals -> flag column."""
        return {f"{f}_{position}": f"__{f}_{position}" for position, _, flags in self.audited for f in flags}

    def totals(self) -> DataFrame:
        """One row: the segment's rows and what its steps counted; reads only the columns they touch."""
        counted = [F.count_if(flag).alias(name) for name, flag in self.counts().items()]
        return self._project(with_flags=True).agg(F.count(F.lit(1)).alias("rows"), *counted)

    def flagged(self, base: DataFrame, carried: list[str]) -> DataFrame:
        """The segment's table over another base, with its flags and those that the base carries."""
        df = self._project(with_flags=True, base=base)
        visible = [F.col(f"`{p}`").alias(n) for n, p in self.names.items()]
        return df.select(*visible, *carried, *self.counts().values())

    def entries(self, totals: Column) -> list[Column]:
        """The audit entries of the segment's steps, read from its totals."""
        return [
            _audit_entry(position, step, "applied", totals["rows"], {f: totals[f"{f}_{position}"] for f in flags})
            for position, step, flags in self.audited
        ]


class _Audit:
    """Collects audit entries; every segment is aggregated once, whatever reads its row count."""

    def __init__(self, spark):
        self.spark, self.totals, self.entries = spark, {}, []

    def total(self, name: str, row: DataFrame) -> Column:
        self.totals[name] = row.select(F.struct("*")).scalar()
        return F.col(name)

    def literal(self, position: int, step: Step, status: str, message: str) -> None:
        empty = F.lit(None).cast("bigint")
        entry = _audit_entry(position, step, status, empty, {"modified": empty})
        self.entries.append(entry.withField("message", F.lit(message)))

    def frame(self, observed: dict[str, Column] | None = None) -> DataFrame:
        """The entries; ``observed`` totals take the place of the aggregates of that name."""
        if not self.entries:
            return local_frame(self.spark, [], AUDIT_COLUMNS)
        one = local_frame(self.spark, [(1,)], "one int")
        return one.withColumns({**self.totals, **(observed or {})}).select(F.inline(F.array(*self.entries)))


def _literal_struct(values: dict) -> Column:
    return F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in values.items()])


def _watch(audit: _Audit, tail: list[_Segment], unpurged: DataFrame | None) -> Watched:
    """``tail``: the segments behind the last step that removes rows; ``unpurged``: the first one's table with its empty rows."""
    at_source, at_end = Observation(), Observation()
    df = tail[0].base
    if unpurged is not None:
        df = drop_empty_rows(unpurged.observe(at_source, *empty_row_counts(unpurged)))
    carried: list[str] = []
    for segment in tail:
        df = segment.flagged(segment.link(df) if segment.link else df, carried)
        carried += segment.counts().values()
    visible = [c for c in df.columns if c not in carried]
    if carried or audit.entries:
        df = df.observe(at_end, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in carried])

    def entries() -> DataFrame:
        if not audit.entries:
            return audit.frame()
        found = at_end.get
        observed = {} if unpurged is None else {"__purge": _literal_struct(at_source.get)}
        for segment in tail:
            counts = {name: found[flag] for name, flag in segment.counts().items()}
            if segment.total:
                observed[segment.total] = _literal_struct({"rows": found["rows"], **counts})
        return audit.frame(observed)

    return Watched(df.select(*[F.col(f"`{c}`") for c in visible]), entries)


def _audit_entry(position: int, step: Step, status: str, rows: Column, counts: dict) -> Column:
    none = F.lit(None).cast("bigint")
    modified = counts.get("modified", rows if status == "applied" else none)
    values = {
        "position": F.lit(position),
        "step_id": F.lit(step.step_id),
        "operation": F.lit(step.operation),
        "column": F.lit(step.target),
        "status": F.lit(status),
        "rows": rows.cast("bigint"),
        "modified": modified.cast("bigint"),
        "converted": counts.get("converted", none).cast("bigint"),
        "invalid": counts.get("invalid", none).cast("bigint"),
        "message": _message(step, modified, rows, counts),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def range_label(parameters: dict) -> str:
    low, high = parameters.get("min_value"), parameters.get("max_value")
    return f"[{'-inf' if low is None else low}, {'inf' if high is None else high}]"


def _message(step: Step, modified: Column, rows: Column, counts: dict) -> Column:
    where = f"{step.operation} · {step.target or 'tabla'}"
    n = modified.cast("string")
    if step.operation == "clamp_range":
        return F.concat(F.lit(f"{where}: "), n, F.lit(f" celda(s) llevadas a {range_label(step.parameters)}"))
    if step.operation == "convert_datetime":
        bad = counts["invalid"].cast("string")
        return F.concat(
            F.lit(f"{where}: "), counts["converted"].cast("string"), F.lit(" fecha(s) leídas, "),
            bad, F.lit(" con formato inválido irrecuperable"),
        )
    if step.operation == "remove_duplicates":
        return F.concat(F.lit(f"{where}: "), n, F.lit(" fila(s) repetidas fuera, quedan "), rows.cast("string"))
    if step.operation == "drop_empty_rows":
        return F.concat(F.lit(f"{where}: "), n, F.lit(" fila(s) completamente vacías descartadas"))
    return F.concat(F.lit(f"{where}: "), n, F.lit(" celda(s) cambiadas"))


def execute_plan(
    df: DataFrame,
    steps: list[Step],
    order_by: str | None = None,
    purge_empty_rows: bool = False,
    compare: str = "value",
    checkpoint: bool = False,
) -> Execution:
    """Fold the non-rejected steps over the table, in order.

    A step that cannot be applied is recorded and the others go on. ``compare='text'`` counts a
    converted number as modified whenever its text changes. ``checkpoint=True`` cuts the lineage
    after each step that removes rows, so that the audit of later steps does not repeat the
    shuffle; it uses the session's checkpoint directory.
    """
    audit = _Audit(df.sparkSession)
    applied, skipped, errors = [], [], []
    source = df
    if purge_empty_rows:
        purge = Step("drop_empty_rows", step_id="STEP-000")
        counted = audit.total("__purge", count_empty_rows(df))
        audit.entries.append(_audit_entry(0, purge, "applied", counted["rows_kept"], {"modified": counted["rows_purged"]}))
        df = drop_empty_rows(df)
    segment = _Segment(df)
    tail, shuffled = [segment], False
    dedup: tuple[int, Step, Column] | None = None  # waits for the row count of the segment after it

    def close(current: _Segment, counted: bool = False) -> DataFrame:
        nonlocal dedup
        if counted or dedup or current.audited:
            current.total = f"__segment_{len(audit.totals)}"
            totals = audit.total(current.total, current.totals())
            if dedup:
                position, step, before = dedup
                dropped = {"modified": before - totals["rows"]}
                audit.entries.append(_audit_entry(position, step, "applied", totals["rows"], dropped))
                dedup = None
            audit.entries.extend(current.entries(totals))
            current.rows = totals["rows"]
        return current.frame()

    plan = list(enumerate(numbered(steps), 1))
    fills: dict[int, Column] = {}
    for position, step in plan:
        if step.status == "rejected":
            skipped.append(step)
            audit.literal(position, step, "omitted", f"{step.operation}: paso rechazado")
            continue
        try:
            op = catalog.get_operation(step.operation)
            params = {k: v for k, v in step.parameters.items() if k != "column"}
            op.check(segment.visible_kinds(), step.target, params)
            if step.operation == "convert_numeric":
                params["compare"] = compare
            if op.shape == "frame":
                before = close(segment, counted=True)
                after = catalog.remove_duplicates(before, params.get("subset_columns"), order_by)
                if checkpoint:
                    after = reliable_checkpoint(after)
                dedup = (position, step, segment.rows)
                segment = _Segment(after)
                tail = [segment]
            elif catalog.needs_statistic(step.operation, params):
                if position not in fills:  # a barrier for this step and those after it that it can serve
                    together = _statistic_steps(plan, position, segment.visible_kinds())
                    current = close(segment)
                    wanted = [(s.target, segment.visible_kinds()[s.target], p) for _, s, p in together]
                    extra, values = catalog.fill_statistics(current, wanted, f"__statistics_{position}")
                    fills |= dict(zip([i for i, _, _ in together], values))
                    link = lambda table, extra=extra: table.withColumns(extra)
                    segment = _Segment(link(current), set(extra), link)
                    tail.append(segment)
                params["__fill__"] = fills[position]
                segment.add(position, step, params)
            elif step.operation == "normalize_category" and len(params["mappings"]) > catalog.SMALL_MAPPING:
                current = close(segment)
                kind = segment.visible_kinds()[step.target]
                segment = _Segment.mapped(current, position, step, kind, params)
                shuffled |= len(params["mappings"]) > catalog.BROADCAST_MAPPING
                tail.append(segment)
            else:
                segment.add(position, step, params)
            applied.append(step)
        except (ValueError, PySparkException) as exc:
            errors.append((step, str(exc)))
            audit.literal(position, step, "error", str(exc))
    frame = close(segment)
    if df.isStreaming:  # a stream has no totals to read: its audit is empty
        return Execution(source, frame, local_frame(df.sparkSession, [], AUDIT_COLUMNS), applied, skipped, errors)
    # empty rows are counted at the source, which is in the stage that writes only if nothing is shuffled on the way
    purged = source if purge_empty_rows and tail[0].base is df and not shuffled else None
    return Execution(source, frame, audit.frame(), applied, skipped, errors, lambda: _watch(audit, tail, purged))


def _statistic_steps(plan: list, position: int, kinds: dict[str, str]) -> list[tuple[int, Step, dict]]:
    """The statistic steps from ``position`` on that follow each other on different, sound columns."""
    found, seen = [], set()
    for i, step in plan[position - 1 :]:
        if step.status == "rejected":
            continue
        params = {k: v for k, v in step.parameters.items() if k != "column"}
        if not catalog.needs_statistic(step.operation, params) or step.target in seen:
            break
        try:
            catalog.get_operation(step.operation).check(kinds, step.target, params)
        except ValueError:
            continue  # its own turn reports it
        found.append((i, step, params))
        seen.add(step.target)
    return found


def fit_plan(df: DataFrame, steps: list[Step], order_by: str | None = None) -> list[Step]:
    """The plan with the statistics of its mean, median and mode fills on this table written into their steps.

    A fitted plan is plain JSON and looks at one row at a time: on other rows, or on a stream, it fills with the values that it was fitted
    with. Steps that cannot be applied stay as they are. Each group of fills that share a barrier is one round of jobs.
    """
    fitted = numbered(steps)
    for position, step in enumerate(fitted, 1):
        params = {k: v for k, v in step.parameters.items() if k != "column"}
        if step.status == "rejected" or not catalog.needs_statistic(step.operation, params):
            continue
        current = execute_plan(df, fitted[: position - 1], order_by=order_by).frame
        kinds = catalog.column_kinds(current)
        together = _statistic_steps(list(enumerate(fitted, 1)), position, kinds)
        if not together or together[0][0] != position:
            continue
        wanted = [(s.target, kinds[s.target], p) for _, s, p in together]
        extra, values = catalog.fill_statistics(current, wanted)
        found = local_frame(df.sparkSession, [(1,)], "one int").withColumns(extra).select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
        types = [f.dataType.simpleString() for f in found.schema]
        row = found.select(*[F.col(c).cast("string") for c in found.columns]).first()
        for (at, other, _), value, kind in zip(together, row, types):
            fitted[at - 1] = replace(other, parameters={**other.parameters, "fitted": value, "fitted_type": kind})
    return fitted


def run_plan(
    df: DataFrame, steps: list[Step], path: str, format: str = "parquet", **options
) -> tuple[Execution, DataFrame]:
    """Execute a plan, write the clean table and sum up the run.

    Returns the execution and one summary row, with the path, the start and the seconds taken. The write counts for the
    execution's audit. Steps that
    remove rows are checkpointed if the session names a folder, so that writing and auditing do
    not shuffle the table again.
    """
    options.setdefault("checkpoint", has_checkpoint_folder(df.sparkSession))
    started, clock = datetime.now(timezone.utc), perf_counter()
    done = execute_plan(df, steps, **options)
    watched = done.watched()
    write_clean(watched.frame, path, format)
    seconds = round(perf_counter() - clock, 3)
    done.audit = watched.audit()
    reader = df.sparkSession.read
    written = reader.parquet(path) if format == "parquet" else reader.option("header", True).csv(path)
    summary = done.summary(written).withColumns({
        "path": F.lit(path), "started_at": F.lit(started), "seconds": F.lit(seconds),
    })
    return done, summary


def replay_plan(df: DataFrame, plan_json: str, order_by: str | None = None) -> Execution:
    """Run an approved plan, kept as JSON, on new data through the same operators."""
    return execute_plan(df, plan_from_json(plan_json), order_by=order_by)
