"""What several operators share: tables, the shared scratch folder, ranges of ids and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of documents that cross to Python at once: texts of a few megabytes, so that two workers fit beside an executor's heap.
ARROW_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to a size for whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may leave it unnamed."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if place is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def stored(df: DataFrame, *partition: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


GROUP = 128  # bounds that are compared at once


def range_of(df: DataFrame, column: str, rows: int, most: int = GROUP * GROUP) -> tuple[Column, int]:
    """Number of the range that a whole number falls in, and how many ranges there are: ``most`` at most, of about ``rows``
    rows each up to that number. Bounds are quantiles of the column, so far-apart values don't make a range large; rows of
    one value share a range. Nulls are in none."""
    n = df.where(F.col(column).isNotNull()).count()
    parts = max(1, min(most, n // rows))
    bounds: list[int] = []
    if parts > 1:
        found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        bounds = sorted({b for b in found if b > -(1 << 63)})
    if not bounds:
        return F.when(F.col(column).isNotNull(), 0), 1
    array = lambda values: f"array({','.join(values)})"
    groups = [bounds[i : i + GROUP] for i in range(0, len(bounds), GROUP)]
    first = F.expr(array(f"{g[0]}L" for g in groups))
    rest = F.expr(array(array(f"{b}L" for b in g) for g in groups))
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col(column)))
    group = below(first)
    inside = F.when(group == 0, 0).otherwise((group - 1) * GROUP + below(F.get(rest, group - 1)))
    return F.when(F.col(column).isNotNull(), inside), len(bounds) + 1


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_columns(docs: DataFrame, *taken: str) -> list[str]:
    """Columns of ``docs`` whose names don't clash with the columns that an operator adds."""
    return [c for c in docs.columns if c.lower() not in {t.lower() for t in taken}]


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for columns that an operator adds for a while, none of which ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
