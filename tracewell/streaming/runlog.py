"""Live view of the append-only run log with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import shared_dir


def read_log_stream(spark: SparkSession, path: str, schema, *, fmt: str = "json", pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def live_status(log: DataFrame, *, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Latest record and resource extremes per task and event-time window.

    The watermark bounds the state to the windows still open; every aggregate merges map-side.
    """
    return (
        log.withWatermark("time", delay)
        .groupBy("task_id", F.window("time", window))
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.max("temperature").alias("maximum_temperature"),
            F.max("used_ram").alias("maximum_used_ram"),
            F.min("free_disk").alias("minimum_free_disk"),
            F.max("time").alias("last_time"),
            F.max_by("status", "seq").alias("status"),
        )
    )


def breach_flags(df: DataFrame, *, temperature: float, ram: float, disk: float) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns(
        {
            "temperature_breach": flag(F.col("maximum_temperature") >= temperature),
            "ram_breach": flag(F.col("maximum_used_ram") > ram),
            "disk_breach": flag(F.col("minimum_free_disk") < disk),
        }
    )


_BREACH_STATE = "begin long, breach long, at array<long>, seq array<long>, high array<boolean>"


def _walked(begin: int | None, rows: list[tuple[int, int, bool]], grace: int) -> tuple[int | None, int | None]:
    """(start of the open stretch, first breach) after records in order; the walk ends at a breach."""
    for at, _, high in rows:
        if not high:
            begin = None
        elif begin is None:
            begin = at
        if begin is not None and at - begin >= grace:
            return begin, at
    return begin, None


def _breach_states(grace: int):
    """Update of one task: records up to the watermark are settled, later ones wait in order for late arrivals."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        begin, breach, *waiting = state.get if state.exists else (None, None, [], [], [])
        rows = list(zip(*(list(w) for w in waiting), strict=True))
        for batch in batches:
            rows += zip(batch["at"].tolist(), batch["seq"].tolist(), batch["high"].tolist(), strict=True)
        if breach is not None:
            state.update((begin, breach, [], [], []))
            return
        rows.sort()
        mark = state.getCurrentWatermarkMs()
        settled = [r for r in rows if r[0] <= mark * 1000]
        rows = rows[len(settled) :]
        begin, breach = _walked(begin, settled, grace)
        final = breach is not None
        if final:
            rows, seen = [], (begin, breach)
        else:
            seen = _walked(begin, rows, grace)
        state.update((begin, breach, *([r[i] for r in rows] for i in range(3))))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000, mark) + 1)
        start, moment = (None, None) if seen[1] is None else seen
        yield pd.DataFrame({
            "task_id": [key[0]], "begin": pd.array([start], "Int64"), "breach": pd.array([moment], "Int64"), "final": [final],
        })

    return update


def live_breaches(log: DataFrame, *, limit: float, grace_seconds: float = 120.0, delay: str = "1 hour") -> DataFrame:
    """Stream of the first sustained breach per task: task_id, begin_time, breach_time, final.

    Records may arrive up to ``delay`` late in any order. Those the watermark has passed are settled into the start of the
    open stretch; the later ones wait in the state, sorted on each update, so a late record can still open, join or
    end a stretch. A row tells what holds now - a null time where nothing is in breach - and is final once settled. A task's
    state is a start, a breach and the records of the delay; after the breach it is two numbers. A timer settles
    tasks that send nothing more. A record without a temperature ends a stretch.
    """
    high = F.coalesce(F.col("temperature") >= limit, F.lit(False))
    plain = log.withWatermark("time", delay).select(
        "task_id", "time", F.unix_micros("time").alias("at"), F.col("seq").cast("long").alias("seq"), high.alias("high")
    )
    found = plain.groupBy("task_id").applyInPandasWithState(
        _breach_states(round(grace_seconds * 1_000_000)), "task_id string, begin long, breach long, final boolean", _BREACH_STATE,
        "update", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(
        "task_id", F.timestamp_micros("begin").alias("begin_time"), F.timestamp_micros("breach").alias("breach_time"), "final"
    )


def new_run(spark: SparkSession, name: str) -> str:
    """Folder of a stream's state and rows; later runs with the same folder go on where the last one ended."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def advance(status: DataFrame, root: str) -> None:
    """Run a stream over all input there is now.

    Updates go to one folder per micro-batch, so a replayed batch overwrites its own rows.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/rows/batch={epoch}")

    run = (
        status.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    run.awaitTermination()


def newest(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key that a stream has written."""
    rows = spark.read.parquet(f"{root}/rows").drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def drain(status: DataFrame, name: str) -> DataFrame:
    """Run a status stream over all available input; the newest version of each window as a table."""
    root = new_run(status.sparkSession, name)
    advance(status, root)
    rows = newest(status.sparkSession, root, ["task_id", "window"])
    return rows.select("task_id", F.col("window.start").alias("window_start"), *[c for c in rows.columns if c not in ("task_id", "window")])


def replayed_breaches(
    log: DataFrame, *, limit: float, grace_seconds: float = 120.0, late_seconds: int, slices: int = 4
) -> DataFrame:
    """A log played back as it would arrive, up to ``late_seconds`` late by a hash of ``seq``: the live breaches at its end.

    Arrivals are cut into slices of equal time. Each is appended to the folder the stream reads and the stream is started
    again from its checkpoint, so micro-batches hold late records and every slice is a recovery as well.
    """
    spark = log.sparkSession
    plain = log.select("task_id", "time", "seq", "temperature")
    arrival = F.unix_seconds("time") + F.pmod(F.xxhash64("seq"), F.lit(late_seconds))
    ends = plain.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    if ends["lo"] is None:
        return spark.createDataFrame([], "task_id string, begin_time timestamp, breach_time timestamp, final boolean")
    number = F.floor((arrival - ends["lo"]) * slices / (ends["hi"] - ends["lo"] + 1)).cast("int")
    numbered = plain.withColumn("slice", number)
    root = new_run(spark, "live-breaches")
    stream = None
    for i in range(slices):
        numbered.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{root}/log")
        if stream is None:
            stream = live_breaches(
                read_log_stream(spark, f"{root}/log", plain.schema, fmt="parquet"), limit=limit, grace_seconds=grace_seconds,
                delay=f"{late_seconds + 1} seconds",
            )
        advance(stream, root)
    return newest(spark, root, ["task_id"])
