"""Scans over the rows of a key in order that don't put a key into one task.

A key's rows are cut into runs along their order. A run's rows are scanned where they are; what a run leaves behind, a row
for each run, is scanned in the same manner (runs within ranges of runs, then the ranges), and each run gets what all
earlier ones carry over as a row before its first. So rows are shuffled once, by key and run, whatever share of them a key
holds. Null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 4096  # of a run, in numbers of the order


DAY = 86_400


def run_of(order: Column, width: int = WIDTH) -> Column:
    """Run of a whole number."""
    return F.floor(order / width).cast("long")


def run_of_time(df: DataFrame, ts: str, width: int = DAY) -> Column:
    """Run of a time, or of a number of seconds."""
    return run_of(F.unix_timestamp(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts), width)


_OVER = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}


def _both(how: str, near: Column, far: Column) -> Column:
    """What a nearer and a farther part of the past carry together."""
    return F.coalesce(near, far) if how == "last" else F.greatest(near, far) if how == "max" else F.coalesce(near + far, near, far)


def before(df: DataFrame, key: str, order: Sequence[str], run: Column, values: dict[str, tuple[str, Column]], first: Sequence[Column] = (), width: int = WIDTH) -> DataFrame:
    """Adds for each name the ``last`` value that isn't null, the ``sum`` or the ``max`` of an expression over all rows of the
    key before this one; null without any. ``run`` must not fall along ``order``; ``first`` orders rows that ``order`` leaves
    equal, or comes before its last columns where given with them."""
    taken = [f"__{n}" for n in values]
    rows = df.select("*", run.alias("__run"), F.lit(False).alias("__carry"), *[v.alias(t) for t, (_, v) in zip(taken, values.values(), strict=True)])
    hows = dict(zip(taken, (h for h, _ in values.values()), strict=True))
    place = F.struct(*order)
    left = {t: F.max_by(t, F.when(F.col(t).isNotNull(), place)) if h == "last" else _OVER[h](t) for t, h in hows.items()}
    runs = rows.groupBy(key, "__run").agg(*[c.alias(t) for t, c in left.items()]).withColumn("__far", F.floor(F.col("__run") / width))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = past(Window.partitionBy(key, "__far").orderBy("__run"))
    left = {t: F.max_by(t, F.when(F.col(t).isNotNull(), F.col("__run"))) if h == "last" else _OVER[h](t) for t, h in hows.items()}
    ranges = runs.groupBy(F.col(key).alias("__key"), F.col("__far").alias("__range")).agg(*[c.alias(f"{t}_") for t, c in left.items()])
    early = past(Window.partitionBy("__key").orderBy("__range"))
    ranges = ranges.select("__key", "__range", *[_OVER[h](f"{t}_").over(early).alias(f"{t}_") for t, h in hows.items()])
    inside = runs.select(key, "__run", "__far", *[_OVER[h](t).over(near).alias(t) for t, h in hows.items()])
    joined = inside.join(ranges, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__far") == F.col("__range")))
    carry = joined.select(key, "__run", F.lit(True).alias("__carry"), *[_both(h, F.col(t), F.col(f"{t}_")).alias(t) for t, h in hows.items()])
    here = past(Window.partitionBy(key, "__run").orderBy(F.desc("__carry"), *first, *order))
    every = rows.unionByName(carry, allowMissingColumns=True)
    found = every.select("*", *[_OVER[h](t).over(here).alias(n) for n, (t, h) in zip(values, hows.items(), strict=True)])
    return found.where(~F.col("__carry")).drop("__run", "__carry", *taken)


def rolling(df: DataFrame, key: str, order: Sequence[str], run: Column, rows: int, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Adds aggregates over this row and the ``rows - 1`` before it. Rows are numbered by a scan; the last of each run of
    numbers are dealt to the next run as well."""
    width = max(width, rows)
    numbered = before(df, key, order, run, {"__n": ("sum", F.lit(1))}).withColumn("__n", F.coalesce("__n", F.lit(0)))
    own = numbered.select("*", F.floor(F.col("__n") / width).alias("__part"), F.lit(False).alias("__copy"))
    copies = own.where(F.col("__n") % width > width - rows).select(*numbered.columns, (F.col("__part") + 1).alias("__part"), F.lit(True).alias("__copy"))
    w = Window.partitionBy(key, "__part").orderBy("__n").rowsBetween(-(rows - 1), 0)
    found = own.union(copies).select("*", *[v.over(w).alias(n) for n, v in values.items()])
    return found.where(~F.col("__copy")).drop("__n", "__part", "__copy")
