"""Questions to the run log: one row per task of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phases a task can be in; ``skipped`` marks tasks whose input failed.
PHASES = ("waiting", "running", "completed", "failed", "skipped")


def latest_run(log: DataFrame) -> DataFrame:
    """All rows of the run that started last. The aggregate is a single row."""
    newest = log.agg(F.max(F.struct("run_started_at", "run_id")).alias("newest")).select("newest.run_id")
    return log.join(F.broadcast(newest), "run_id", "left_semi")


def completed_tasks(log: DataFrame) -> DataFrame:
    """Tasks that finished, with the time they did."""
    return log.where("phase = 'completed' and completed_at is not null")


def phase_counts(log: DataFrame) -> DataFrame:
    """Tasks per run and phase, and the run's total."""
    return (
        log.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("phase") == phase).alias(phase) for phase in PHASES],
        )
    )
