"""Data preparation, quality scoring, cleaning plans and KPIs as Spark DataFrame operators."""

from tersa.operators.analysis import Analysis, duplicate_rows
from tersa.operators.catalog import apply_operation, list_operations, register_operation
from tersa.operators.compare import compare_tables
from tersa.operators.kpi import category_breakdown, kpi_report
from tersa.operators.privacy import mask_by_hint, mask_embedded, masked_sample
from tersa.operators.profile import profile, profile_report
from tersa.operators.state import ProfileStore, merge_states, profile_of_states, profile_state
from tersa.operators.quality import before_after, quality_issues, quality_overall, quality_scores
from tersa.plans.execute import execute_plan, fit_plan, replay_plan, run_plan
from tersa.operators.spelling import apply_proposals, mapping_steps, propose_mappings
from tersa.plans.propose import guardrail, propose_plan, propose_steps
from tersa.plans.steps import Step, plan_from_json, plan_to_json, review
from tersa.sources.files import scan_csv, scan_parquet, scan_table, write_clean
from tersa.sources.hygiene import (
    count_empty_rows, dataset_metadata, drop_empty_rows, fingerprint, validate_ingest,
)
from tersa.streaming.replay import replay_stream

__all__ = [
    "Analysis", "ProfileStore", "Step", "apply_operation", "apply_proposals", "before_after", "category_breakdown", "compare_tables",
    "count_empty_rows", "dataset_metadata", "drop_empty_rows", "duplicate_rows", "execute_plan",
    "fingerprint", "fit_plan", "guardrail", "kpi_report", "list_operations", "mapping_steps", "mask_by_hint", "mask_embedded",
    "masked_sample", "merge_states", "plan_from_json", "plan_to_json", "profile", "profile_of_states", "profile_report", "profile_state",
    "propose_mappings", "propose_plan", "propose_steps", "quality_issues", "quality_overall", "quality_scores",
    "register_operation", "replay_plan", "replay_stream", "review", "run_plan", "scan_csv",
    "scan_parquet",
    "scan_table", "validate_ingest", "write_clean",
]
