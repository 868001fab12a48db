"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Five-word shingles are hashed once. The top eight bits of a hash choose one of 256 bins, and each bin keeps its
smallest hash. An empty bin is filled by optimal densification: it tries the other bins in an order of its own (an affine
permutation of the bins, fixed by the bin's number alone) and takes the value of the first bin that isn't empty. The low
eight bits of every bin are stored, packed as hex. Equal low bits by chance (1 in 256) are taken off the likeness.

How the bins come about without a table for each row: one sentinel for each bin, the largest hash it can hold, joins
the hashes; after a sort, the first entry of every bin is its minimum, and a sentinel there marks an empty bin.

A null or empty text, or one of white space, has the fingerprint of 512 zeros; its likeness to another such is 1, to
anything else 0. A text of one to four words is one shingle. Repeated rows each keep a row. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, range_of

BINS = 256
WORDS = 5
TRIES = 8  # bins tried one by one before all filled bins are ranked at once
NONE = "0" * (2 * BINS)
_LOW = (1 << 56) - 1


def _permutations() -> tuple[list[int], list[int], list[int]]:
    """Multiplier, its inverse and offset of each bin's order of tries: try t looks at bin (m t + c) mod 256."""
    draw = random.Random(20)
    m = [draw.randrange(1, BINS, 2) for _ in range(BINS)]
    return m, [pow(x, -1, BINS) for x in m], [draw.randrange(BINS) for _ in range(BINS)]


def _ints(values: list[int], kind: str = "int") -> Column:
    return F.lit(values).cast(f"array<{kind}>")


def with_fingerprint(df: DataFrame, text_col: str, name: str, words: int = WORDS) -> DataFrame:
    """``df`` with the packed fingerprint of ``text_col`` as column ``name``."""
    mult, inverse, offset = (_ints(x) for x in _permutations())
    sentinels = _ints([((b + 1) << 56) - 1 for b in range(-BINS // 2, BINS // 2)], "long")
    w, h, s, first, filled = (f"__{x}_{name}" for x in ("w", "h", "s", "first", "filled"))
    real = lambda x: x.bitwiseAND(F.lit(_LOW)) != _LOW
    low = lambda x: x.bitwiseAND(F.lit(255))
    bin_of = lambda x: F.shiftright(x, 56)
    hashes = F.col(h)
    run = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, words)])
    shingles = F.when(F.size(h) >= words, F.transform(F.slice(h, F.lit(1), F.size(h) - (words - 1)), run)).otherwise(F.array(F.xxhash64(h)))

    def fill(x: Column, i: Column) -> Column:
        tries = [F.get(F.col(first), (F.get(mult, i) * t + F.get(offset, i)).bitwiseAND(F.lit(BINS - 1))) for t in range(TRIES)]
        rank = lambda y: (F.get(inverse, i) * (bin_of(y) + BINS // 2 - F.get(offset, i))).bitwiseAND(F.lit(BINS - 1)) * 256 + low(y)
        return F.when(real(x), low(x)).otherwise(F.coalesce(*[F.when(real(y), low(y)) for y in tries], low(F.array_min(F.transform(F.col(filled), rank)))))

    out = df.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACE), ""))
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    out = out.withColumn(s, F.sort_array(F.concat(shingles, sentinels)))
    out = out.withColumn(first, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))))).drop(s)
    out = out.withColumn(filled, F.filter(first, real))
    packed = F.array_join(F.transform(F.transform(first, fill), lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return out.withColumn(name, F.when(F.size(h) == 0, NONE).otherwise(F.lower(packed))).drop(h, first, filled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for equal bits by chance."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(2 * BINS - 1), F.lit(2)), lambda i: a.substr(i, F.lit(2)) == b.substr(i, F.lit(2))))
    estimate = F.greatest((same - BINS / 256) / (BINS - BINS / 256), F.lit(0.0))
    return F.when((a == NONE) | (b == NONE), (a == b).cast("double")).otherwise(estimate)


def with_next(docs: DataFrame, id_col: str, columns: list[str], derive: Callable[[DataFrame], DataFrame], rows: int = 1000) -> DataFrame:
    """``derive(docs)`` with ``next_<column>``: its value in the row with the next smaller id; the smallest id's next is
    the largest. ``derive`` adds columns row by row.

    Ids are cut into ranges of about ``rows`` ids by their quantiles, one window partition each; the last row of a range is
    also dealt to the range after it, so the table is never ordered as a whole. Rows with a null id have no next; among
    rows of one id the order is that of their first column's hash.
    """
    known = docs.where(F.col(id_col).isNotNull())
    block, _ = range_of(known, id_col, rows)
    ends = known.groupBy(block.alias("__block")).agg(F.max(id_col).alias("__end"))
    order = Window.orderBy("__block")  # as many rows as ranges, a bounded number
    links = ends.select("__end", F.coalesce(F.lead("__block").over(order), F.first("__block").over(order)).alias("__block"))
    tails = known.join(F.broadcast(links), F.col(id_col) == F.col("__end")).select(*docs.columns, "__block", F.lit(True).alias("__copy"))
    dealt = derive(known.select(*docs.columns, block.alias("__block"), F.lit(False).alias("__copy")).union(tails))
    order = Window.partitionBy("__block").orderBy(F.desc("__copy"), F.col(id_col), F.xxhash64(columns[0]))
    found = dealt.select("*", *[F.lag(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("__copy")).drop("__block", "__copy")
    alone = derive(docs.where(F.col(id_col).isNull()))
    return found.union(alone.select("*", *[F.lit(None).cast(alone.schema[c].dataType).alias(f"next_{c}") for c in columns]))


def query(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, "doc_id", ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n.cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
