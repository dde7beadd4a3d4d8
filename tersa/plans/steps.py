"""Plan steps and their JSON form."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row

# Review states of a step.
STATUSES = ("proposed", "approved", "edited", "rejected")


@dataclass(frozen=True)
class Step:
    operation: str
    column: str | None = None
    parameters: dict = field(default_factory=dict)
    step_id: str = ""
    reason: str = ""
    confidence: float = 0.9
    risk: str = "low"
    affected_rows_estimate: int = 0
    status: str = "proposed"

    def __post_init__(self):
        if self.status not in STATUSES:
            raise ValueError(f"INVALID_PARAMETER: unknown status '{self.status}'")

    @property
    def target(self) -> str | None:
        return self.column or self.parameters.get("column")


def numbered(steps: list[Step]) -> list[Step]:
    return [s if s.step_id else replace(s, step_id=f"STEP-{i:03d}") for i, s in enumerate(steps, 1)]


def review(steps: list[Step], decisions: dict[str, str]) -> list[Step]:
    """Set the review state of steps by step id."""
    return [replace(s, status=decisions.get(s.step_id, s.status)) for s in steps]


def step_from_row(row: Row) -> Step:
    return Step(
        operation=row.operation, column=row.column, parameters=json.loads(row.parameters),
        step_id=row.step_id, reason=row.reason, confidence=row.confidence, risk=row.risk,
        affected_rows_estimate=row.affected_rows_estimate, status=row.status,
    )


def collect_steps(plan: DataFrame) -> list[Step]:
    """The steps of one plan, by number; a plan has at most a few rows per column of the table."""
    steps = [step_from_row(r) for r in plan.collect()]
    return sorted(steps, key=lambda s: (int(re.sub(r"\D", "", s.step_id) or 0), s.step_id))


def plan_to_json(steps: list[Step]) -> str:
    return json.dumps([asdict(s) for s in steps], ensure_ascii=False)


def plan_from_json(text: str) -> list[Step]:
    return [Step(**item) for item in json.loads(text)]
