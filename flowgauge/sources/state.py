"""State tables: current rows, retention, parsed columns, stored outputs and alert routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowgauge.functions import text, timing, vocab

# Key prefixes of internal rows, the markers of backfill records, and a task row's readiness fields.
INTERNAL_PREFIXES = ("_", "output#", "input#", "dag_snapshot::")
BACKFILL_PIPELINE = r"^_.*bulk_backfill$"
READINESS_KEYS = ("dependencies", "trigger_rule", "orchestration_timeout", "wait_before", "wait_for")
READINESS_REQUIRED = ("dependencies", "trigger_rule")
PUSH_MAX_BYTES = 350_000


def task_rows_only(rows: DataFrame) -> DataFrame:
    """Rows of real tasks: no internal record and no backfill record."""
    name = F.coalesce("execution_name", F.lit(""))
    internal = name.startswith(INTERNAL_PREFIXES[0])
    for prefix in INTERNAL_PREFIXES[1:]:
        internal = internal | name.startswith(prefix)
    backfill = (F.coalesce("record_type", F.lit("")) == "backfill") | (
        F.coalesce("pipeline_name", F.lit("")).rlike(BACKFILL_PIPELINE))
    return rows.where(~internal & ~backfill)


def parse_readiness(rows: DataFrame, column: str = "readiness") -> DataFrame:
    """``trigger_rule`` and ``dependencies`` of each readiness text, and what makes a text unusable."""
    keys = F.json_object_keys(F.col(column))
    document = F.try_parse_json(F.col(column))
    known, required = (F.array(*[F.lit(k) for k in names]) for names in (READINESS_KEYS, READINESS_REQUIRED))
    problem = (
        F.when(document.isNull(), "not JSON")
        .when(~F.schema_of_variant(document).startswith("OBJECT"), "not an object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown keys")
        .when(F.size(F.array_except(required, keys)) > 0, "missing keys")
    )
    parsed = rows.withColumn("problem", problem)
    usable = F.col("problem").isNull()
    return parsed.withColumns({
        "rule": F.when(usable, F.try_variant_get(F.try_parse_json(column), "$.trigger_rule", "string")),
        "dependencies": F.coalesce(
            F.when(usable, F.try_variant_get(F.try_parse_json(column), "$.dependencies", "array<string>")),
            F.array().cast("array<string>")),
    })


def json_list(column: Column) -> Column:
    """A JSON text as a list of strings; an empty list for anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", "array<string>"), F.array().cast("array<string>"))


def apply_markers(outputs: DataFrame, markers: DataFrame, key: list[str]) -> DataFrame:
    """Outputs after manual markers: a marker lands where nothing or only an earlier marker is stored."""
    joined = outputs.select(*key, "result").join(
        markers.select(*key, F.col("result").alias("marker")), key, "full")
    replace = F.col("marker").isNotNull() & (
        F.col("result").isNull() | F.coalesce(text.output_kind(F.col("result")) == "manual", F.lit(False)))
    return joined.select(*key, F.when(replace, F.col("marker")).otherwise(F.col("result")).alias("result"),
                         replace.alias("marked"))


def validate_pushes(rows: DataFrame, column: str, max_bytes: int = PUSH_MAX_BYTES) -> DataFrame:
    """Whether each serialised value fits a stored row, with its size and what to do when it does not."""
    size = F.octet_length(F.col(column))
    return rows.withColumns({
        "bytes": size, "accepted": size <= max_bytes,
        "hint": F.when(size > max_bytes, F.lit("store the payload and push a pointer to it")),
    })


def live_rows(rows: DataFrame, kind: str, written_at: str, now: Column) -> DataFrame:
    """Rows that have not outlived their kind's retention, counted from their last write."""
    return rows.where(timing.lives_until(F.col(written_at), kind) > now)


def live_backfills(records: DataFrame, written_at: str, now: Column) -> DataFrame:
    running = F.col("status").isin(*vocab.ACTIVE_BACKFILL)
    until = F.when(running, timing.lives_until(F.col(written_at), "backfill_running")).otherwise(
        timing.lives_until(F.col(written_at), "backfill_ended"))
    return records.where(until > now)


def current_rows(log: DataFrame) -> DataFrame:
    """The latest image of each row: the highest generation, then the latest write; one partial aggregate."""
    newest = F.max(F.struct("generation_after", "at", "seq", "new_status")).alias("newest")
    return log.groupBy("run_id", "task_no").agg(newest).select(
        "run_id", "task_no", F.col("newest.new_status").alias("status"),
        F.col("newest.generation_after").alias("generation"), F.col("newest.at").alias("status_since"))


def unregistered(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Pipeline names seen in state that the registry does not have."""
    return runs.select("pipeline").distinct().join(registry.select(F.col("name").alias("pipeline")), "pipeline", "left_anti")


def route_alerts(failures: DataFrame, config: DataFrame) -> DataFrame:
    """One row per failure and enabled channel of its pipeline; pipelines without channels give none."""
    channels = config.select("pipeline", F.explode("enabled_channels").alias("channel"))
    return failures.join(channels, "pipeline")
