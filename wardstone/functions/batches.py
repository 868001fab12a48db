"""Arrow batches of a bounded size, for functions over texts, pictures and sound."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS, BYTES = 1000, 4 << 20  # that cross to Python at once; that become Python objects at once


def tuned() -> None:
    """Sets the session's Arrow batches to a size for whole texts and files."""
    SparkSession.getActiveSession().conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def slices(values: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """Slices of a batch in order, of about ``most`` bytes each; an empty batch is one."""
    rows = max(1, len(values) * most // max(most, values.nbytes))
    for at in range(0, max(1, len(values)), rows):
        yield values.slice(at, rows)
