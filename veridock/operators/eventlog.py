"""Event logs as tables: sequence checks, transitions, folds, as-of views, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OFTEN = ["BLOCKED", "FAILED"]
#: Allowed transitions of the workflow, and where a blocked one may resume.
TRANSITIONS = {
    "RECEIVED": ["CLASSIFYING_INPUTS", "FAILED"],
    "CLASSIFYING_INPUTS": ["ROLE_CONFIRMATION_REQUIRED", "PENDING_REFERENCE_INGESTION", "PENDING_DRAWING_INGESTION", "INPUT_CONFIRMATION_REQUIRED", "READY_TO_EVALUATE", *_OFTEN],
    "ROLE_CONFIRMATION_REQUIRED": ["CLASSIFYING_INPUTS", *_OFTEN],
    "PENDING_REFERENCE_INGESTION": ["CLASSIFYING_INPUTS", "PENDING_DRAWING_INGESTION", "INPUT_CONFIRMATION_REQUIRED", "READY_TO_EVALUATE", *_OFTEN],
    "PENDING_DRAWING_INGESTION": ["INPUT_CONFIRMATION_REQUIRED", "READY_TO_EVALUATE", *_OFTEN],
    "INPUT_CONFIRMATION_REQUIRED": ["READY_TO_EVALUATE", *_OFTEN],
    "READY_TO_EVALUATE": ["RETRIEVING_EVIDENCE", *_OFTEN],
    "RETRIEVING_EVIDENCE": ["RUNNING_MATH", *_OFTEN],
    "RUNNING_MATH": ["RUNNING_RULES", *_OFTEN],
    "RUNNING_RULES": ["WAITING_TRACK_A", *_OFTEN],
    "WAITING_TRACK_A": ["WAITING_TRACK_B", *_OFTEN],
    "WAITING_TRACK_B": ["FINALIZING", *_OFTEN],
    "FINALIZING": ["READY_FOR_REVIEW", *_OFTEN],
}
TERMINAL = ["READY_FOR_REVIEW", "FAILED"]
RESUME_TARGETS = [s for s in TRANSITIONS if s != "RECEIVED"] + ["FAILED"]


def transition_error(previous: Column, following: Column, kind: Column) -> Column:
    """Null for a legal transition, else what is wrong; previous is null for the first event."""
    allowed = F.lit(False)
    for state, targets in TRANSITIONS.items():
        allowed = allowed | ((previous == state) & following.isin(*targets))
    blocked = previous == "BLOCKED"
    return (
        F.when(previous.isNull(), F.when((kind != "TRANSITION") | (following != "RECEIVED"), "INITIAL_MUST_ENTER_RECEIVED"))
        .when(previous.isin(*TERMINAL), "TERMINAL_STATE")
        .when(blocked & (kind != "RESUME"), "RESUME_REQUIRED")
        .when(blocked & ~following.isin(*RESUME_TARGETS), "RESUME_NOT_ALLOWED")
        .when(~blocked & (kind == "RESUME"), "RESUME_ONLY_AFTER_BLOCKED")
        .when(~blocked & ~allowed, "TRANSITION_NOT_ALLOWED")
    )


def check_sequence(events: DataFrame, group: str, order: str, state: str, kind: Column) -> DataFrame:
    """Adds place (from 1), gap (the sequence number isn't its place), previous state and transition error."""
    w = Window.partitionBy(group).orderBy(order)
    return (
        events.withColumn("place", F.row_number().over(w))
        .withColumn("gap", F.col(order) != F.col("place"))
        .withColumn("previous", F.lag(state).over(w))
        .withColumn("error", transition_error(F.col("previous"), F.col(state), kind))
    )


def current_state(events: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Last value of each column per group: a fold that combines map-side."""
    return events.groupBy(group).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max(order).alias(order), F.count(F.lit(1)).alias("n_events"))


def append_conflicts(events: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys that were appended with more than one payload; equal repeats are fine."""
    return events.groupBy(*keys).agg(F.count_distinct(payload).alias("n_payloads"), F.count(F.lit(1)).alias("n_events")).where("n_payloads > 1")


def latest_as_of(records: DataFrame, group: str, at: str, tie: str, cutoff: Column, *columns: str) -> DataFrame:
    """Latest record per group at or before the cutoff."""
    best = F.max(F.struct(at, tie, *columns)).alias("r")
    return records.where(F.col(at) <= cutoff).groupBy(group).agg(best).select(group, "r.*")


def retries(stages: DataFrame, group: list[str], order: list[str], status: str, failed: str) -> DataFrame:
    """n_attempts and n_retries per group: attempts whose previous attempt failed."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = stages.withColumn("__retry", (F.lag(status).over(w) == failed).cast("int"))
    return marked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_attempts"), F.coalesce(F.sum("__retry"), F.lit(0)).alias("n_retries"))


def run_metrics(stages: DataFrame, group: str, ms: str, external: Column, budget_ms: float) -> DataFrame:
    """Deterministic and external time per group, and whether the budget holds."""
    totals = stages.groupBy(group).agg(F.sum(F.when(~external, F.col(ms)).otherwise(0)).alias("work_ms"), F.sum(F.when(external, F.col(ms)).otherwise(0)).alias("external_ms"))
    return totals.withColumn("within_budget", F.col("work_ms") <= budget_ms)
