"""Replay an approved plan on a stream.

Steps that look at one row at a time run as they are: text, case, category, date, number and range steps, constant
fills, renames and drops, and fills whose statistic a fitted plan carries (``fit_plan``). Duplicates are dropped with state that
a watermark bounds. Other steps are refused before the stream starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tersa.operators import catalog
from tersa.plans.execute import execute_plan
from tersa.plans.steps import Step, plan_from_json


def stateless(step: Step) -> bool:
    op = catalog.get_operation(step.operation)
    return op.shape != "frame" and not catalog.needs_statistic(step.operation, step.parameters)


def _refuse(steps: list[Step], watermark: tuple[str, str] | None) -> None:
    bad = [s.operation for s in steps if not stateless(s) and not (s.operation == "remove_duplicates" and watermark)]
    if bad:
        hint = "" if watermark or "remove_duplicates" not in bad else " (duplicates need a watermark)"
        raise ValueError(f"INVALID_PARAMETER: not possible on a stream: {bad}{hint}")


def replay_stream(stream: DataFrame, plan: str | list[Step], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The cleaned stream. Raises ``ValueError`` if a step needs all rows.

    ``watermark``: (event time column, delay). Of rows with one key, or of equal rows if the step has no key, the first that
    arrives stays if the others follow within the delay; state for older keys is dropped. With a delay that covers the
    duplicates, the stream gives the rows of a batch run, whatever its batches and restarts from its checkpoint.
    """
    steps = plan_from_json(plan) if isinstance(plan, str) else plan
    active = [s for s in steps if s.status != "rejected"]
    _refuse(active, watermark)
    frame = stream.withWatermark(*watermark) if watermark else stream
    ahead: list[Step] = []
    for step in active:
        if catalog.get_operation(step.operation).shape != "frame":
            ahead.append(step)
            continue
        frame, ahead = _applied(frame, ahead), []
        params = {k: v for k, v in step.parameters.items() if k != "column"}
        catalog.get_operation(step.operation).check(catalog.column_kinds(frame), step.target, params)
        if watermark[0] not in frame.columns:
            raise ValueError(f"INVALID_COLUMN: duplicates need the event time '{watermark[0]}' until they are dropped")
        keys = params.get("subset_columns")
        frame = frame.dropDuplicatesWithinWatermark(keys) if keys else frame.dropDuplicatesWithinWatermark()
    return _applied(frame, ahead)


def _applied(frame: DataFrame, steps: list[Step]) -> DataFrame:
    done = execute_plan(frame, steps)
    if done.errors:
        raise ValueError("; ".join(message for _, message in done.errors))
    return done.frame
