"""Operations report: counters, dead letters, run outcomes, newest restaurants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import listing, runs


@dataclass
class Report:
    counters: DataFrame
    dead_letters: DataFrame
    runs: DataFrame
    run_outcomes: DataFrame
    newest: DataFrame


def operations_report(
    restaurants: DataFrame, locations: DataFrame, dishes: DataFrame, changes: DataFrame, run_events: DataFrame,
    run_updates: DataFrame, failed_jobs: DataFrame,
) -> Report:
    lifecycle = runs.run_lifecycle(run_events).join(runs.merge_metrics(run_updates), "run_id", "left")
    outcomes = lifecycle.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms")
    )
    return Report(
        runs.counters(restaurants, changes, lifecycle),
        runs.sweep_report(runs.sweep_failed(failed_jobs)),
        lifecycle,
        outcomes,
        listing.restaurant_summary(restaurants, locations, dishes),
    )
