"""Readers of media folders, corpora and histories, and the corpus registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import table

HISTORY = "sessions array<struct<session_id:string,ts:timestamp,age:int,threat_type:string,completed:boolean,agreed:boolean,turns:array<struct<turn:int,child_response:string,reply:string,child_emotion:string>>>>"


def media(spark: SparkSession, path: str) -> DataFrame:
    """(stem, image, audio): pictures of a folder with the sound of the same stem, null without."""

    def files(pattern: str, name: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
        return rows.select(stem.alias("stem"), F.col("content").alias(name))

    return files("*.{png,jpg,jpeg}", "image").join(files("*.wav", "audio"), "stem", "left")


def csv_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted texts over several lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def parquet_corpus(spark: SparkSession, paths: str | Sequence[str], wanted: Sequence[str], needed: str | None = None, limit: int | None = None) -> DataFrame:
    """The wanted columns that exist, of rows that have ``needed``; only those columns are read."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    out = df.select(*[c for c in wanted if c in df.columns])
    if needed:
        out = out.where(F.col(needed).isNotNull())
    return out if limit is None else out.limit(limit)


def history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Sessions of JSON documents, a file or (``lines``) a line each; broken documents have none."""
    docs = spark.read.schema(HISTORY).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return docs.select(F.explode("sessions").alias("s")).select("s.*")


def write_history(sessions: DataFrame, path: str) -> None:
    """A document for each session, a line each, so that no task gathers them."""
    sessions.select(F.array(F.struct("*")).alias("sessions")).write.mode("overwrite").json(path)


def corpora(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Registry (key, file, citation, note), small enough to be joined by broadcast."""
    return spark.createDataFrame(list(rows), "key string, file string, citation string, note string")


def cached(spark: SparkSession, path: str, least: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The current version of a table if it has enough rows, else a new one, built beside it and published when it is whole:
    who reads the old one meanwhile keeps reading it."""
    found = table.current(spark, path)
    if found is not None and found.count() >= least:
        return found
    table.publish(build(), path)
    return table.current(spark, path)
