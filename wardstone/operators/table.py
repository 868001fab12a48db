"""The stored table of runs: batches that are written once however often they are tried, look-ups by id, retention and keyed
replacement that touch only the partitions they change.

The table is parted by day and batch; within a file rows are sorted by id and ids have a Bloom filter. Rewrites go by dynamic
partition overwrite: what isn't rewritten keeps its files. Rows are gathered by partition before they are written, large days
in several tasks (Spark's rebalancing). A ledger beside the data (``_ledger``, hidden from readers) says
which batches of a stream are complete and how many rows each had.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import RUN_COLUMNS, conform, retained, with_defaults

#: For look-ups by id: a filter in each row group, sized for the ids of a file.
LOOKUP = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "200000"}
DYNAMIC = {"partitionOverwriteMode": "dynamic"}
LEDGER = "stream string, batch long, rows long"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def write_batch(df: DataFrame, path: str, batch: str, **options: str) -> int:
    """Writes run rows as one batch, in place of what an earlier try of it left; how many rows it has."""
    rows = with_defaults(df).withColumn("dt", F.to_date("ts")).withColumn("batch", F.lit(batch))
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("n"))
    counted.hint("rebalance", "dt").sortWithinPartitions("dt", "id").write.mode("overwrite").options(**DYNAMIC, **LOOKUP, **options).partitionBy("dt", "batch").parquet(path)
    return seen.get["n"]


def append(df: DataFrame, path: str) -> int:
    """Adds run rows as a batch of their own."""
    return write_batch(df, path, f"append-{uuid.uuid4().hex}")


def committed(spark: SparkSession, path: str, stream: str) -> dict[int, int]:
    """Rows of each complete batch of a stream: a row for each batch."""
    if not exists(spark, f"{path}/_ledger"):
        return {}
    found = spark.read.schema(LEDGER).parquet(f"{path}/_ledger").where(F.col("stream") == stream)
    return {r["batch"]: r["rows"] for r in found.groupBy("batch").agg(F.max("rows").alias("rows")).collect()}


def commit(spark: SparkSession, path: str, stream: str, batch: int, rows: int) -> None:
    spark.createDataFrame([(stream, batch, rows)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/_ledger")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all batches with their day and batch, whatever columns each file has; of an empty table no rows."""
    p, fs = _path(spark, path)
    if not any(not e.getPath().getName().startswith("_") for e in fs.listStatus(p)):
        return conform(spark.range(0).select(), RUN_COLUMNS | {"dt": "date", "batch": "string"})
    df = spark.read.option("mergeSchema", "true").option("partitionColumnTypeInference.enabled", "false").parquet(path)
    return conform(df, RUN_COLUMNS | {"dt": "date", "batch": "string"})


def by_id(spark: SparkSession, path: str, ids: str | Sequence[str]) -> DataFrame:
    """Runs of some ids; sorted files and their filters leave out the row groups that can't hold them."""
    return read(spark, path).where(F.col("id").isin([ids] if isinstance(ids, str) else list(ids)))


def _drop(spark: SparkSession, path: str, **partition: object) -> None:
    name = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else str(v)
    p, fs = _path(spark, "/".join([path, *(f"{k}={name(v)}" for k, v in partition.items())]))
    fs.delete(p, True)


def prune(spark: SparkSession, path: str, now: Column, hours: int = 24, days: int = 30, rows: int = 5000, thumb: str = "thumb_jpeg") -> dict[str, int]:
    """Retention on the stored table: old thumbs become null, old rows and those beyond the newest ``rows`` go (rows without
    a time too). Partitions that lose all rows are dropped, those that lose some or hold an old thumb are rewritten, the others
    keep their files. Returns how many partitions were dropped, rewritten and kept, and the rows removed. Run again after a
    failure, it goes on where it stopped."""
    table = read(spark, path)
    by = ["dt", "batch"]
    stale = F.col(thumb).isNotNull() & (F.col("ts") < now - F.expr(f"interval {hours} hours"))
    kept = retained(table, now, hours, days, rows, thumb)
    n = kept.groupBy(*by).agg(F.count("*").alias("kept")).select(F.struct(*by).alias("p"), "kept")
    all_ = table.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(stale).alias("stale")).withColumn("p", F.struct(*by))
    found = all_.join(n, "p", "left").select(*by, "n", "stale", F.coalesce("kept", F.lit(0)).alias("kept")).collect()  # a row for each partition
    gone = [r for r in found if not r["kept"]]
    changed = [r for r in found if r["kept"] and (r["kept"] < r["n"] or r["stale"])]
    if changed:
        one = F.array(*[F.struct(F.lit(r["dt"]).alias("dt"), F.lit(r["batch"]).alias("batch")) for r in changed])
        new = kept.where(F.array_contains(one, F.struct("dt", "batch")))
        new.hint("rebalance", "dt").sortWithinPartitions("dt", "batch", "id").write.mode("overwrite").options(**DYNAMIC, **LOOKUP).partitionBy(*by).parquet(path)
    for r in gone:
        _drop(spark, path, dt=r["dt"], batch=r["batch"])
    return {"dropped": len(gone), "rewritten": len(changed), "untouched": len(found) - len(gone) - len(changed), "rows": sum(r["n"] - r["kept"] for r in found)}


def purge(spark: SparkSession, path: str) -> int:
    """Removes all rows of the table, whose ledger stays; how many there were."""
    n = read(spark, path).count()
    p, fs = _path(spark, path)
    for entry in fs.listStatus(p):
        if not entry.getPath().getName().startswith("_"):
            fs.delete(entry.getPath(), True)
    return n


def upsert(updates: DataFrame, path: str, key: str, order: str, buckets: int = 64) -> int:
    """Replaces the rows of the updates' keys in a table parted by bucket of the key, and adds those it lacks; of rows of a
    key the last by ``order`` stays, an update before an older row of equal order. Only the buckets that hold one of the keys are read
    and rewritten. Returns how many those are."""
    spark = updates.sparkSession
    bucketed = updates.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = bucketed.withColumn("__new", F.lit(1))
    touched = sorted(r["bucket"] for r in bucketed.select("bucket").distinct().collect())  # at most ``buckets``
    rows = new
    if exists(spark, path):
        old = spark.read.schema(bucketed.schema).parquet(path).where(F.col("bucket").isin(touched)).withColumn("__new", F.lit(0))
        rows = rows.unionByName(old)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*bucketed.columns), F.struct(order, "__new")).alias("r")).select("r.*")
    last.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").options(**DYNAMIC).partitionBy("bucket").parquet(path)
    return len(touched)


def publish(df: DataFrame, path: str) -> int:
    """Writes a new version of a table and makes it the current one; readers of the version before keep it. Returns its number."""
    spark = df.sparkSession
    number = max(versions(spark, path), default=0) + 1
    name = f"v{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{path}/_versions")
    return number


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of the published versions by number; of two published at once under one number the lesser name counts."""
    if not exists(spark, f"{path}/_versions"):
        return {}
    found = spark.read.schema("number long, name string").parquet(f"{path}/_versions")
    return {r["number"]: r["name"] for r in found.groupBy("number").agg(F.min("name").alias("name")).collect()}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version that was published whole, or none."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/{known[max(known)]}") if known else None


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders of all but the newest versions; for when no reader needs them any more."""
    known = versions(spark, path)
    old = sorted(known)[:-keep] if keep else sorted(known)
    for number in old:
        p, fs = _path(spark, f"{path}/{known[number]}")
        fs.delete(p, True)
    return len(old)
