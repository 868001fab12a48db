"""Ranked lexical search: one automaton of all items' terms scans the documents; no index of the documents is made.

1. The items' distinct terms are dealt into parts of bounded size, an item's terms together. A part's terms become an
   Aho-Corasick automaton that every worker builds from a broadcast of at most ``PART_CHARS`` characters (or one item's).
2. A term stands between guards: every character that is in no term is made a blank, and a key is a blank, the term and a
   blank. Keys share blanks, so the automaton reports each whole term and never a piece of one.
3. The first scan counts the documents of each term, all documents and all terms, summed within each task first: a row for
   each term and task.
4. The second scan counts terms again and adds their weights to the items that hold them. A task keeps each item's best
   ``most`` documents; those of all tasks are ranked in two steps, so no task gets all of an item's.

Each part is two scans of all documents; with up to ``PART_CHARS`` characters of terms there is one part.

Terms are maximal runs of letters, digits and all characters beyond ASCII, A-Z in lower case. A null or empty text holds
none. Rows of one item id (a null one too) are one item; an item without a term has no rows. Each document row is a document
of its own; ties go to the smaller id, null ids last. Other columns are ignored. Without items or documents there are no rows.
"""

from __future__ import annotations

import collections
import math
import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
PART_CHARS = 8_000_000
SEGMENT = 1 << 20  # bytes of a text that cross to the automaton at once
CELLS = 1 << 21  # scores of documents and items that are held at once
PENDING = 1 << 18  # rows that a task holds before it ranks them
#: Bytes of a text, letters in lower case, all that is in no term as blanks; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(1))


@dataclass
class Part:
    """Items and their terms: ``items`` of a term are at ``holders[starts[t]:starts[t + 1]]``."""

    items: list[int | None]
    terms: list[str]
    starts: np.ndarray
    holders: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def parts(items: DataFrame, item_col: str, text_col: str, chars: int = PART_CHARS) -> Iterator[Part]:
    """The items' terms, dealt by item."""
    pairs = items.select(F.col(item_col).cast("long").alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    size = pairs.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    n = -(-size // chars)
    for k in range(n):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else pairs
        rows = own.collect()  # about chars characters
        ids = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i or 0))
        place = {i: k for k, i in enumerate(ids)}
        by_term: dict[str, list[int]] = {}
        for item, term in rows:
            by_term.setdefault(term, []).append(place[item])
        if ids:
            lengths = [0, *map(len, by_term.values())]
            yield Part(ids, list(by_term), np.cumsum(lengths), np.array([i for v in by_term.values() for i in v], np.int64))


class Scanner:
    """Counts a part's terms in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t} ".encode().decode("latin-1"), i)
        if terms:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[int, collections.Counter]:
        """How many terms a text has, and how often it holds each term of the part."""
        data = b" " + text.encode().translate(FOLD) + b" "
        inside = np.frombuffer(data, np.uint8) != 32
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        found: collections.Counter = collections.Counter()
        at = 0
        while n and at < len(data) - 1:
            end = data.find(b" ", at + SEGMENT)
            end = end if end >= 0 else len(data) - 1
            found.update(map(operator.itemgetter(1), self.automaton.iter(data[at : end + 1].decode("latin-1"))))
            at = end
        return n, found


_scanners: dict[str, Scanner] = {}


def scanner(part: Part) -> Scanner:
    """The last part's, once for each worker process."""
    if part.key not in _scanners:
        _scanners.clear()
        _scanners[part.key] = Scanner(part.terms)
    return _scanners[part.key]


DOCUMENTS, LENGTH = -1, -2  # rows of counts beside those of the terms


def counts(texts: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms, and the documents of each term of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = scanner(shared.value), collections.Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                if text:
                    n, found = scan(text)
                    total.update(found.keys())
                    total[DOCUMENTS] += n > 0
                    total[LENGTH] += n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["term", "n"])

    rows = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the part
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(DOCUMENTS, 0), found.pop(LENGTH, 0), found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``most`` best documents of each item among those seen so far."""

    def __init__(self, n_items: int, most: int):
        self.most = most
        self.floor = np.ones(n_items, np.int64)  # a score that a document must reach to be looked at
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id
        self.new: list[list[np.ndarray]] = []
        self.pending = 0

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        if len(doc):
            self.new.append([item, scores[doc, item], missing[doc], ids[doc]])
            self.pending += len(doc)
            if self.pending > PENDING:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        item, score, missing, ids = (np.concatenate(c) for c in zip(self.rows, *self.new, strict=True))
        order = np.lexsort((ids, missing, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.floor)))
        place = np.arange(len(order)) - first[item[order]]
        keep = order[place < self.most]
        self.rows = [c[keep] for c in (item, score, missing, ids)]
        last = order[place == self.most - 1]
        self.floor[item[last]] = score[last]
        self.new, self.pending = [], 0
        return self.rows


def ranked(texts: DataFrame, shared, weights: np.ndarray, n_docs: int, length: int, most: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task's."""
    broad = texts.sparkSession.sparkContext.broadcast(weights)  # a number for each term of the part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = shared.value
        scan, w, best = scanner(part), broad.value, Best(len(part.items), most)
        held = np.diff(part.starts)
        step = max(1, CELLS // len(part.items))

        def score(doc: list[int], term: list[int], tf: list[int], soft: list[int], ids: list[int | None]) -> None:
            d, t, f = (np.array(x, np.int64) for x in (doc, term, tf))
            m = np.array(soft, np.int64)
            own = w[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[d]))
            many = held[t]
            at = np.repeat(part.starts[t] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            scores = np.zeros(len(m) * len(part.items), np.int64)
            np.add.at(scores, np.repeat(d * len(part.items), many) + part.holders[at], np.repeat(own, many))
            best.add(scores.reshape(len(m), -1), np.array([i is None for i in ids], np.int64), np.array([i or 0 for i in ids], np.int64))

        for b in batches:
            doc, term, tf, soft, ids = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = scan(text) if text else (0, {})
                if not found:
                    continue
                doc += [len(soft)] * len(found)
                term += found.keys()
                tf += found.values()
                soft.append(10 + 90 * n * n_docs // length)
                ids.append(i)
                if len(soft) == step:
                    score(doc, term, tf, soft, ids)
                    doc, term, tf, soft, ids = [], [], [], [], []
            if soft:
                score(doc, term, tf, soft, ids)
        item, value, missing, ids = best.settle()
        names = pa.array(part.items, pa.int64())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(ids, mask=missing == 1), pa.array(value)], ["item_id", "doc_id", "score"])

    return texts.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars: int = PART_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of every item."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for part in parts(items, item_col, item_text_col, chars):
        shared = context.broadcast(part)
        n_docs, length, df = counts(texts, shared)
        if n_docs:
            weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(part.terms))], np.int64)
            found = found.union(ranked(texts, shared, weights, n_docs, length, most))
    best = lambda *by: F.row_number().over(Window.partitionBy("item_id", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = dealt.withColumn("rank", best("deal")).where(F.col("rank") <= most)
    return few.withColumn("rank", best()).where(F.col("rank") <= most).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_FOLDED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_FOLDED} AS ts FROM documents),
n AS (SELECT rid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (SELECT DISTINCT item_id, unnest({_FOLDED}) AS term FROM benchmark),
t AS (SELECT rid, unnest(ts) AS term FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, nn),
s AS (
    SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
    FROM tf JOIN i USING (term) JOIN w USING (term) JOIN n USING (rid), c GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM r WHERE place <= 10
"""
