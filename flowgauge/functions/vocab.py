"""Status vocabularies and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The status names and the sets the rules read.
TASK_STATUSES = (
    "waiting", "deps_ready", "waiting_paused", "waiting_decision", "running", "pending",
    "success", "succeeded", "failed", "upstream_failed", "aborted", "skipped", "stopped",
)
FINAL = ("success", "succeeded", "failed", "skipped", "aborted", "upstream_failed", "stopped")
FINAL_FAILURES = ("failed", "upstream_failed", "aborted", "stopped")
SUCCESSES = ("success", "succeeded")
STOPPED_KINDS = ("stopped", "aborted", "upstream_failed")
SHOWN_RUN_STATUSES = ("running", "success", "failed", "aborted", "stale")
ACTIVE_BACKFILL = ("pending", "running")
ENDED_BACKFILL = ("completed", "failed", "partial", "canceled")
CASCADES = ("auto", "none", "all")
TRIGGER_RULES = (
    "all_success", "one_success", "all_done", "all_skipped", "none_skipped", "one_failed", "all_failed",
    "none_failed", "none_failed_min_one_success",
)
FAILURE_AVERSE_RULES = ("all_success", "one_success", "none_failed", "none_failed_min_one_success")
READABLE_SKIP_ORIGINS = ("manual", "run")


def is_final(status: Column) -> Column:
    return F.coalesce(status.isin(*FINAL), F.lit(False))


def is_success(status: Column) -> Column:
    return F.coalesce(status.isin(*SUCCESSES), F.lit(False))


def is_final_failure(status: Column) -> Column:
    return F.coalesce(status.isin(*FINAL_FAILURES), F.lit(False))


def is_skipped(status: Column) -> Column:
    return F.coalesce(status == "skipped", F.lit(False))


def readable_class(status: Column, origin: Column) -> Column:
    """Whether a task's output may be read in its run: ``ok``, ``upstream_failed`` or ``missing``."""
    return (
        F.when((status == "success") | ((status == "skipped") & origin.isin(*READABLE_SKIP_ORIGINS)), "ok")
        .when(is_final_failure(status), "upstream_failed")
        .otherwise("missing")
    )


def run_status(all_final: Column, any_failed: Column, any_stopped: Column) -> Column:
    """A run's outcome from what its rows are: open rows keep it running, a failure outranks a stop."""
    return (
        F.when(~F.coalesce(all_final, F.lit(False)), "running")
        .when(any_failed, "failed")
        .when(any_stopped, "aborted")
        .otherwise("success")
    )
