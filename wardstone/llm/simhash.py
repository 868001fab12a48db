"""SimHash near-duplicates: fingerprints linked within a Hamming radius by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a value that is at most ``radius / 2`` bits from either. Every
distinct fingerprint emits all values of that smaller ball; a shuffle on the values brings the pairs together. A group
around one value holds at most as many fingerprints as the ball has values (65 at radius 2), whatever the data, and its
members are all linked through its smallest member, so no pairs are listed within a group.

Nulls and empty texts have the fingerprint zero and are linked like any other. Repeated ids keep a row each; a null id
counts for no smallest id. Repeated rows and ties change nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

SEED = 42
BITS = 64
#: Of ``similar``: words of a run, least similarity of a link (four fifths), bits and number of the fingerprints of a text.
RUN, LIKE = 5, (4, 5)
COUNTS = 1 << 17  # runs are counted by so many values of their hashes, which orders them from rare to frequent
SPARE = 10  # runs of a set for which one more of its first runs is looked at, and has to be shared
FILTER, BITS_AT = 20, (22, 28, 34)  # the filter of candidates: bits of the number of its words, and where a node's bits are taken from
SHORT, PRINTS = 40, 6
ODD = np.random.default_rng(SEED).integers(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text, over its shingles with repeats."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    runs = list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.dtype("<u8"), len(runs))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): one row for each row of ``docs``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    of = F.pandas_udf(run, "long")
    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def ball(radius: int, width: int = BITS) -> list[int]:
    """Signed masks of at most ``radius`` set bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) with a > b: links between distinct fingerprints, enough to connect all that are within ``radius`` bits.

    The ball radius is rounded up for an odd radius, so members of a group may be a bit too far apart; then all links
    of the (bounded) group are verified one by one instead of through its smallest member.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball(half)])
    near = fps.select("fp").distinct().select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))
    if radius % 2 == 0:
        least = F.min("fp").over(Window.partitionBy("value"))
        pairs = near.select(F.col("fp").alias("a"), least.alias("b")).where("a > b")
    else:
        pairs = near.alias("x").join(near.alias("y"), "value").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).where("a > b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(a, label): the smallest member of each connected component, for every member but that one.

    Alternating large-star and small-star contraction: each round is joins and sums over edges, the number of rounds
    grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    scratch(edges.sparkSession)
    edges = edges.select("a", "b").checkpoint()
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.withColumnRenamed("b", "label")
        seen = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, the row's own included."""
    fps = stored(fingerprints(docs, id_col, text_col, words))
    return _grouped(fps, components(links(fps, radius)))


SALTS = 16  # parts of a component with many fingerprints


def _grouped(fps: DataFrame, label: DataFrame) -> DataFrame:
    known = fps.groupBy("fp").agg(F.min("id").alias("first")).join(label, F.col("fp") == F.col("a"), "left")
    known = known.select("fp", "first", F.coalesce("label", "fp").alias("label"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    least = known.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select("label", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = known.join(least, ["label", "salt"], "left").select("fp", F.coalesce("least", "first").alias("component"))
    return fps.join(known, "fp").select("id", "fp", "component")


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words; a shorter text is one run, an empty one has none."""
    import xxhash

    runs = list(map(b" ".join, zip(*(words[i:] for i in range(RUN)), strict=False))) if len(words) >= RUN else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def sketch(words: list[bytes], runs: np.ndarray) -> list[int]:
    """Of one text: a hash of its set of runs, PRINTS fingerprints of its distinct words, as many smallest hashes of runs.

    A fingerprint has SHORT bits, and its number above them.
    """
    import xxhash

    if not len(runs):
        return [0, *(i << SHORT for i in range(PRINTS)), *[0] * PRINTS]
    own = list(set(words))
    prints, each = [], 128 // SHORT
    for seed in range(-(-PRINTS // each)):
        ones = np.zeros(128, np.int64)
        for i in range(0, len(own), 1 << 14):
            part = b"".join(map(partial(xxhash.xxh3_128_digest, seed=SEED + seed), own[i : i + (1 << 14)]))
            ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.uint32)
        packed = int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")
        prints += [packed >> (128 - SHORT * (i + 1)) & (1 << SHORT) - 1 for i in range(each)]
    with np.errstate(over="ignore"):
        least = (runs * ODD[:, None]).min(axis=1) >> np.uint64(33)
    node = xxhash.xxh64_intdigest(runs.tobytes(), seed=SEED)
    return [node - (1 << 64) if node >> 63 else node, *(i << SHORT | x for i, x in enumerate(prints[:PRINTS])), *least.tolist()]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with a > b: nodes that follow one another under one value, in rows (value, least, node) as they are sorted."""

    def pairs(value: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero((value[1:] == value[:-1]) & (node[1:] != node[:-1]))
        found = pd.DataFrame({"a": np.maximum(node[at], node[at + 1]), "b": np.minimum(node[at], node[at + 1])})
        return pa.RecordBatch.from_pandas(found.drop_duplicates(), preserve_index=False)

    values, nodes, held = [], [], 0
    for batch in batches:
        values.append(batch.column(0).to_numpy())
        nodes.append(batch.column(2).to_numpy())
        held += len(batch)
        if held >= 500_000:
            value, node = np.concatenate(values), np.concatenate(nodes)
            yield pairs(value, node)
            values, nodes, held = [value[-1:]], [node[-1:]], 1
    if values:
        yield pairs(np.concatenate(values), np.concatenate(nodes))


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b) with a > b: texts that follow one another under a value of the ball of one of their fingerprints.

    Texts whose fingerprints share a value are sorted by the smallest hash of their runs, one for each fingerprint, which is
    the same in two texts as often as they are similar; each meets the one after it, so a group of n texts gives n pairs
    for each value. The sort is by ranges, so a large group is no task's.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in ball(1, SHORT)])
    each = rows.select("node", "fps", "least").distinct().select("node", F.explode(F.arrays_zip("fps", "least")).alias("x"))
    near = each.select(F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("x.fps")))).alias("value"), F.col("x.least").alias("least"), "node")
    near = near.repartitionByRange("value", "least", "node").sortWithinPartitions("value", "least", "node")
    return near.mapInArrow(_neighbours, "a long, b long").distinct()


def sets_of(docs: DataFrame, involved: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, runs): the whole sets of the nodes ``involved``, and of a few others."""
    # A blocked Bloom filter of the nodes, 2 to the FILTER words at the most, spares shuffling most other texts' runs; the joins
    # decide, so it drops nothing.
    words = 1 << min(FILTER, max(4, (involved.count() // 4).bit_length()))
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(node, {at}) & 63 as int))" for at in BITS_AT))
    found = involved.groupBy(F.col("node").bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(bits).alias("mask")).toPandas()
    table = np.zeros(words, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table, seen = shared.value, set()
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                runs = shingles(_split(text))
                node = int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes(), seed=SEED)).astype(np.int64)) if len(runs) else 0
                mask = sum({1 << (node >> at & 63) for at in BITS_AT})
                if node in seen or int(table[node & (len(table) - 1)]) & mask != mask:
                    continue
                seen.add(node)
                nodes.append(node)
                sets.append(runs.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "runs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, runs array<long>").dropDuplicates(["node"])


def verified(docs: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ``pairs`` of nodes whose sets of runs have a similarity of LIKE or more, counted in full."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text_col)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(LIKE[1] * shared >= LIKE[0] * (F.size("x") + F.size("y") - shared)).select("a", "b")


def rare_first(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often runs of each value of the last bits of their hashes occur. Any order of runs finds all pairs; this one keeps
    frequent runs out of the prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTS, np.int64)
        for batch in batches:
            runs = np.concatenate([np.zeros(0, np.uint64), *[shingles(_split(text)) for text in batch.column(0).to_pylist()]])
            n += np.bincount((runs & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["value", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTS, np.int64)
    counts[found["value"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _least(n):
    """Runs that a set of ``n`` shares with a set of similarity LIKE, at least: four fifths of n, rounded up."""
    return F.ceil(n * LIKE[0] / F.lit(LIKE[1])) if isinstance(n, Column) else -(-n * LIKE[0] // LIKE[1])


def _shared(sets: DataFrame) -> DataFrame:
    """(node, n, label, run, held): runs that sets of several labels hold, and how many sets hold each."""
    each, w = sets.select("node", "n", "label", F.explode("runs").alias("run")), Window.partitionBy("run")
    each = each.select("*", F.min("label").over(w).alias("least"), F.max("label").over(w).alias("most"), F.count("*").over(w).alias("held"))
    return each.where("least < most").drop("least", "most")


def _few(n):
    """How many of their first runs similar sets share at least: one, and one more for each SPARE of the smaller set."""
    return 1 + (F.floor(n / SPARE) if isinstance(n, Column) else n // SPARE)


def remaining(docs: DataFrame, label: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b) with a > b: all pairs of nodes in different components of ``label`` (a, label) that may have a similarity of LIKE.

    Two sets of that similarity share ``_few`` of the smaller one's size of their first runs, in one order of all runs, of which
    a set of n has n less four fifths of n, rounded up, and ``_few(n)``. A set with fewer of them in other components has no partner.
    Of the other sets all runs meet, and those that only one component holds are left out, so a group of similar texts makes no
    pairs of its own. How many sets hold a run is then known: partners meet on their rarest runs, and only if the runs from there
    on are enough for both. Texts that have a passage in common, but less than four fifths, make no pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rare_first(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts, seen = shared.value, set()
        for batch in batches:
            nodes, sizes, firsts = [], [], []
            for text in batch.column(0).to_pylist():
                runs = shingles(_split(text))
                node = int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes(), seed=SEED)).astype(np.int64)) if len(runs) else 0
                if not len(runs) or node in seen:
                    continue
                seen.add(node)
                n = len(runs)
                order = np.lexsort((runs, counts[(runs & np.uint64(COUNTS - 1)).astype(np.int64)]))
                nodes.append(node)
                sizes.append(n)
                firsts.append(runs[order[: n - _least(n) + _few(n)]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["node", "n", "runs"])

    sets = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, n int, runs array<long>").dropDuplicates(["node"])
    sets = sets.join(label.withColumnRenamed("a", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    each = _shared(sets)
    some = each.groupBy("node", "n", "label").agg(F.count("*").alias("c")).where(F.col("c") >= _few(_least(F.col("n")))).drop("c")
    some = stored(some)
    each = stored(_shared(sets_of(docs, some.select("node"), text_col).join(some, "node")))
    w = Window.partitionBy("node")
    left = F.count("*").over(w) - F.row_number().over(w.orderBy("held", "run")) + 1  # shared runs of the set from this one on
    each = each.select("node", "n", "label", "run", left.alias("left")).where(F.col("left") >= _least(F.col("n")))
    x, y = (each.select("run", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "label", "left")]) for k in "xy")
    both = x.join(y, "run").where("label_x < label_y")
    both = both.where(sum(LIKE) * F.least("left_x", "left_y") >= LIKE[0] * (F.col("n_x") + F.col("n_y")))
    return both.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component): components of texts whose sets of five-word runs have a similarity of LIKE or more.

    Candidates come from ball hashing of several short fingerprints of the distinct words, which join most texts cheaply; all
    other pairs come from the sets' first runs. Every link between distinct texts is verified. A node is a distinct set of runs.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sketch(w, shingles(w)) for w in map(_split, texts)])

    of = F.pandas_udf(run, "array<long>")
    rows = docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("of"))
    rows = rows.select("id", F.col("of")[0].alias("node"), F.slice("of", 2, PRINTS).alias("fps"), F.slice("of", PRINTS + 2, PRINTS).cast("array<int>").alias("least"))
    rows = stored(rows)
    label = components(verified(docs, stored(candidates(rows)), text_col))
    more = verified(docs, stored(remaining(docs, label, text_col)), text_col)
    label = components(label.select("a", F.col("label").alias("b")).union(more))  # a component is kept by its links to its least
    return _grouped(rows.select("id", F.col("node").alias("fp")), label).withColumnRenamed("fp", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their component of similar texts (or whose component has no id)."""
    found = similar(docs, id_col, text_col)
    first = found.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__kept")).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
