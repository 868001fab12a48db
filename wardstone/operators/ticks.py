"""Streams of checks in batch form: repeated frames, failure streaks, due times, title changes, newest traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import before, run_of, run_of_time


def repeated(ticks: DataFrame, device: str = "device_id", seq: str = "seq") -> DataFrame:
    """Adds skipped: the frame equals the last one analysed and there is no sound. A failed check leaves the last frame
    as it was; one with sound only sets it to null, which equals nothing."""
    analysed = F.when(~F.col("failed"), F.struct("frame_hash"))
    rows = before(ticks, device, [seq], run_of(F.col(seq)), {"__last": ("last", analysed)})
    return rows.withColumn("skipped", ~F.col("has_audio") & F.coalesce(F.col("frame_hash") == F.col("__last.frame_hash"), F.lit(False))).drop("__last")


def streaks(ticks: DataFrame, device: str = "device_id", seq: str = "seq") -> DataFrame:
    """Adds failures since the last success (skips change nothing), the wait before the next try, and degraded."""
    rows = repeated(ticks, device, seq)
    failed, good = ~F.col("skipped") & F.col("failed"), ~F.col("skipped") & ~F.col("failed")
    rows = before(rows, device, [seq], run_of(F.col(seq)), {"__failed": ("sum", failed.cast("int"))})
    rows = rows.withColumn("__failed", (F.coalesce("__failed", F.lit(0)) + failed.cast("int")).cast("int"))
    rows = before(rows, device, [seq], run_of(F.col(seq)), {"__then": ("max", F.when(good, F.col("__failed")))})
    since = F.col("__failed") - F.when(good, F.col("__failed")).otherwise(F.coalesce("__then", F.lit(0)))
    return rows.withColumn("failures", since.cast("long")).withColumn("wait", F.least(F.lit(15), 2 * F.col("failures"))).withColumn("degraded", F.col("failures") >= 3).drop("__failed", "__then")


def due(ticks: DataFrame, every: int = 30, least: int = 10, device: str = "device_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Adds the next time a check is due, and how long after the one before this one came. Checks of one time are taken by
    their numbers."""
    rows = before(ticks, device, [ts, seq], run_of_time(ticks, ts), {"__ts": ("last", F.unix_timestamp(ts))})
    step = max(every, least)
    return rows.withColumn("gap", F.unix_timestamp(ts) - F.col("__ts")).withColumn("due", F.col(ts) + F.expr(f"interval {step} seconds")).drop("__ts")


def segments(ticks: DataFrame, title: str = "title", device: str = "device_id", seq: str = "seq") -> DataFrame:
    """Adds the number of the stretch with one title."""
    rows = before(ticks, device, [seq], run_of(F.col(seq)), {"__was": ("last", F.struct(F.col(title).alias("t")))})
    changed = F.col("__was").isNotNull() & ~F.col(title).eqNullSafe(F.col("__was.t"))
    rows = rows.withColumn("__changed", changed.cast("int"))
    rows = before(rows, device, [seq], run_of(F.col(seq)), {"__changes": ("sum", F.col("__changed"))})
    return rows.withColumn("segment", F.coalesce("__changes", F.lit(0)) + F.col("__changed")).drop("__was", "__changed", "__changes")


def newest(ticks: DataFrame, most: int = 30, device: str = "device_id", seq: str = "seq") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(device).orderBy(F.desc(seq)))
    return ticks.withColumn("rank", rank).where(F.col("rank") <= most)


def alert_edges(runs: DataFrame, closes: DataFrame, device: str = "device_id", ts: str = "ts") -> DataFrame:
    """Runs that raise an alert: the first hate run of a device, and the first one after each close of the intercept that
    the alert before it opened. ``closes`` is (device, ts); a close counts before runs of its own time. Each run has one row."""
    hate = runs.where(F.col("decision") == "hate").withColumn("__close", F.lit(0))
    both = hate.unionByName(closes.select(device, ts).withColumn("__close", F.lit(1)), allowMissingColumns=True).withColumn("__later", 1 - F.col("__close"))
    seen = before(both, device, [ts, "__later", "id"], run_of_time(both, ts), {"__open": ("sum", F.col("__close"))})
    runs_ = seen.where("__close = 0").withColumn("__open", F.coalesce("__open", F.lit(0)))
    first = runs_.groupBy(device, "__open").agg(F.min_by(F.struct(*runs.columns), F.struct(ts, "id")).alias("r"))
    return first.select("r.*")
