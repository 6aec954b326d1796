"""Run-log analysis: latest status, resource summary, sustained breaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_running


def latest_status(log: DataFrame, *, task: str = "task_id", sequence: str = "seq") -> DataFrame:
    """Last record of each task in log order."""
    rest = [c for c in log.columns if c != task]
    last = log.groupBy(task).agg(F.max_by(F.struct(*rest), sequence).alias("_r"))
    return last.select(task, "_r.*")


def resource_summary(log: DataFrame, *, task: str = "task_id") -> DataFrame:
    """Points, extremes, time range and rate per task."""
    summary = log.groupBy(task).agg(
        F.count(F.lit(1)).alias("points"),
        F.max("temperature").alias("maximum_temperature"),
        F.max("used_ram").alias("maximum_used_ram"),
        F.min("free_disk").alias("minimum_free_disk"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )
    seconds = (F.unix_micros("last_time") - F.unix_micros("first_time")) / 1000000.0
    return summary.withColumns(
        {
            "elapsed_seconds": seconds,
            "rows_per_second": F.when(seconds > 0, F.col("points") / seconds),
        }
    )


def sustained_breaches(
    log: DataFrame, *, limit: float, grace_seconds: float = 120.0, task: str = "task_id",
    bucket: Column | None = None,
) -> DataFrame:
    """First moment each task has stayed at or above ``limit`` for the grace time, and when that stretch began.

    A record opens a stretch if it is high and the one before it is not, or there is none; a record without a
    temperature is not high. The start of the stretch is the latest opening, a running maximum that is carried across
    time buckets, so a busy task is spread over many tasks, also one that never falls below the limit.
    """
    span = F.date_trunc("hour", F.col("time")) if bucket is None else bucket
    order = [F.col("time"), F.col("seq")]
    high = F.coalesce(F.col("temperature") >= limit, F.lit(False))
    plain = log.select(task, "time", "seq", high.alias("_high"))
    before = with_running(plain, [task], span, order, lags={"_before": F.col("_high")})
    opens = F.col("_high") & ~F.coalesce("_before", F.lit(False))
    ran = with_running(before, [task], span, order, maxes={"_begin": F.when(opens, F.col("time"))})
    held = (F.unix_micros("time") - F.unix_micros("_begin")) / 1000000.0
    return ran.where(F.col("_high") & (held >= grace_seconds)).groupBy(task).agg(
        F.min("time").alias("breach_time"), F.min_by("_begin", "time").alias("begin_time"),
        F.count(F.lit(1)).alias("breach_points"),
    )
