"""Benchmark decontamination: a BM25 index of test items, searched with every training passage by block-max bounds.

Index: items' terms with BM25 impacts, each divided by the item's score against its own words, so 1 is a full match and
one threshold serves all items. Items are cut into blocks; a term's largest impact in a block bounds what the term adds
to any item there.

Search: a text is cut into strides of S words; two neighbouring strides are a passage, so every item of at most S words that
a text quotes lies in one passage whole. First the bounds of a passage's words are summed for all blocks at once (frequent
terms by presence, the others over their postings); a passage none of whose blocks reaches the threshold is done. Any
other passage is searched by block-max WAND: postings in the order of items, a pivot by the terms' largest impacts, a check
of the blocks' bounds at the pivot, and skips past blocks that can't reach the threshold; items that may are scored
exactly. All items at or above the threshold are then verified: of the word runs of the item's question and of its
answer, the passage must hold at least ``overlap`` each; without columns of their own, of the runs of the whole item. A run
has five words, in a part of fewer than 15 words a third of them (two at least), so that one edit anywhere in five words
or more leaves half of the runs.

Results: one row for each (document, item), with the best passage. A null or empty text or item matches nothing.
Repeated rows give a row each, equal items all match. Terms are runs of letters and digits, lower-cased.

Items are dealt to parts by length, doubling from ``stride`` words on, so S and with it an item's passages depend on the
item's own length only; and further by number, so that a part has at most ``postings`` postings. The driver holds one part at
a time: it broadcasts the part, lets it be searched in one pass over the documents and forgets it. Statistics are those of
all items, so parts change no result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = 5
FREQUENT = 64  # terms that are matched by presence
#: Bytes of a term: digits, lower-case letters and all of other scripts; anything else parts terms.
_TERM = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
BATCH_STRIDES = 4096


def terms(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TERM).split()


def runs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(RUN, len(words), max(2, len(words) // 3))
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if n else set()


@dataclass
class Index:
    """One part of the index, as tasks use it."""

    items: pd.DataFrame  # item, question, answer, impacts {term: impact}
    stride: int
    threshold: float
    overlap: float
    vocab: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = len(self.items)
        self.per_block = max(2, -(-n // 512))
        self.blocks = max(1, -(-n // self.per_block))
        count: dict[bytes, int] = {}
        for impacts in self.items["impacts"]:
            for t in impacts:
                count[t] = count.get(t, 0) + 1
        ordered = sorted(count, key=lambda t: (-count[t], t))
        self.vocab = {t: i + 1 for i, t in enumerate(ordered)}  # 0: no term of the index
        bound: list[dict[int, float]] = [{} for _ in range(len(ordered) + 1)]
        self.impacts: list[dict[int, float]] = []
        for i, impacts in enumerate(self.items["impacts"]):
            own = {self.vocab[t]: v for t, v in impacts.items()}
            self.impacts.append(own)
            for t, v in own.items():
                b = i // self.per_block
                bound[t][b] = max(bound[t].get(b, 0.0), v)
        self.frequent = np.zeros((FREQUENT, self.blocks), np.float32)
        for t in range(1, min(FREQUENT, len(ordered)) + 1):
            for b, v in bound[t].items():
                self.frequent[t - 1, b] = v
            bound[t] = {}
        self.postings: list[tuple[list[int], list[float], dict[int, float], float]] = [([], [], {}, 0.0)]
        at: list[tuple[list[int], list[float]]] = [([], []) for _ in range(len(ordered) + 1)]
        for i, own in enumerate(self.impacts):
            for t, v in own.items():
                at[t][0].append(i)
                at[t][1].append(v)
        for t in range(1, len(ordered) + 1):
            blocks: dict[int, float] = {}
            for i, v in zip(*at[t], strict=True):
                blocks[i // self.per_block] = max(blocks.get(i // self.per_block, 0.0), v)
            self.postings.append((*at[t], blocks, max(at[t][1])))
        self.first = np.concatenate([[0], np.cumsum([len(b) for b in bound])])
        self.block = np.array([b for x in bound for b in x], np.int64)
        self.bound = np.array([v for x in bound for v in x.values()], np.float64)
        self.runs = [(runs(q), runs(a)) for q, a in zip(self.items["question"], self.items["answer"], strict=True)]

    def wand(self, terms: set[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of all items that reach the threshold, by block-max WAND over the terms' postings."""
        # items, impacts, block bounds, largest impact, place
        lists = [[*self.postings[t], 0] for t in sorted(terms) if 0 < t < len(self.postings)]
        least, end = self.threshold - 1e-9, len(self.impacts)

        def seek(x: list, item: int) -> None:
            x[4] = bisect_left(x[0], item, x[4])

        while True:
            lists = sorted((x for x in lists if x[4] < len(x[0])), key=lambda x: x[0][x[4]])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[3]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                return
            item = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            block = item // self.per_block
            if sum(x[2].get(block, 0.0) for x in lists[: pivot + 1]) < least:
                # no item before the block's end can reach it, unless another list begins there
                after = lists[pivot + 1][0][lists[pivot + 1][4]] if pivot + 1 < len(lists) else end
                for x in lists[: pivot + 1]:
                    seek(x, min((block + 1) * self.per_block, after))
            elif lists[0][0][lists[0][4]] == item:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += x[1][x[4]]
                    x[4] += 1
                if score >= least:
                    yield item, score
            else:
                for x in lists[:pivot]:
                    seek(x, item)


def build(items: DataFrame, id_col: str, text_col: str, question_col: str | None, answer_col: str | None, *, threshold: float, overlap: float, k1: float, b: float, postings: int, least_stride: int) -> Iterator[Index]:
    """Index parts, one by one. Term statistics are Spark sums over all items; a part is at most ``postings`` rows on the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[terms(t) for t in batch.column(i).to_pylist()] for i in range(1, batch.num_columns)]
            q, a = texts if len(texts) == 2 else texts * 2  # the item as a whole
            words = [x if x is y else x + y for x, y in zip(q, a, strict=True)]
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, kind) for x in (q, a, words)]], ["item", "question", "answer", "words"])

    columns = [F.col(id_col).cast("long").alias("item")]
    columns += [F.col(question_col), F.col(answer_col)] if question_col and answer_col else [F.col(text_col)]
    parsed = items.select(*columns).mapInArrow(split, "item long, question array<binary>, answer array<binary>, words array<binary>")
    parsed = stored(parsed.where(F.size("words") > 0).withColumn("key", F.xxhash64("item", "words")))
    tf = parsed.select("key", "item", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("key", "item", "len", "term").agg(F.count("*").alias("tf"))
    n, mean = parsed.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n:
        return
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    scored = tf.join(df, "term").select("key", "term", weight.alias("w"))
    impacts = scored.groupBy("key").agg(F.collect_list(F.struct("term", "w")).alias("all"))
    impacts = impacts.select("key", F.expr("map_from_entries(transform(all, x -> struct(x.term, x.w / aggregate(all, 0D, (s, y) -> s + y.w))))").alias("impacts"))
    rows = stored(parsed.join(impacts, "key").select("item", "question", "answer", "impacts"))
    words = F.size("question") if not question_col else F.size("question") + F.size("answer")
    level = F.greatest(F.lit(0), F.ceil(F.log2(words / F.lit(float(least_stride))))).cast("int")
    rows = rows.withColumn("level", level)
    for at, size in sorted(tuple(r) for r in rows.groupBy("level").agg(F.sum(F.size("impacts"))).collect()):
        parts = max(1, -(-size // postings))
        dealt = rows.where(F.col("level") == at).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        for p in range(parts):
            columns = dealt.where(F.col("part") == p).drop("part", "level").orderBy("item").toArrow().to_pydict()  # ids stay whole numbers or nulls
            found = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})
            for c in ("question", "answer"):
                found[c] = [[bytes(x) for x in v] for v in found[c]]
            found["impacts"] = [{bytes(k): v for k, v in (m.items() if isinstance(m, dict) else m)} for m in found["impacts"]]
            if len(found):
                yield Index(found, least_stride << at, threshold, overlap)


def matches(words: list[list[bytes]], index: Index) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(text, item, first word, score, question overlap, answer overlap) of every passage that is verified."""
    s = index.stride
    count = [max(1, -(-len(w) // s)) for w in words]
    start = np.concatenate([[0], np.cumsum(count)])
    get = index.vocab.get
    ids = [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in words]
    stride = np.concatenate([start[i] + np.arange(len(x)) // s for i, x in enumerate(ids)]) if ids else np.zeros(0, np.int64)
    term = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    total = int(start[-1])
    near = (term > 0) & (term <= FREQUENT)
    present = np.bincount(stride[near] * FREQUENT + term[near] - 1, minlength=total * FREQUENT).reshape(total, FREQUENT) > 0
    far = term > FREQUENT
    t, g = term[far], stride[far]
    n = index.first[t + 1] - index.first[t]
    at = np.repeat(index.first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(t) else np.zeros(0, np.int64)
    rest = np.bincount(np.repeat(g, n) * index.blocks + index.block[at], index.bound[at], total * index.blocks).reshape(total, index.blocks)
    owner = np.repeat(np.arange(len(words)), count)
    joined = np.flatnonzero(owner[:-1] == owner[1:])  # strides that have a next one in the same text
    rest[joined] += rest[joined + 1]
    both = present.copy()
    both[joined] |= present[joined + 1]
    bound = rest + both.astype(np.float32) @ index.frequent
    for g in np.flatnonzero((bound >= index.threshold - 1e-5).any(axis=1)).tolist():
        text = int(owner[g])
        first = int(g - start[text]) * s
        held = None
        for i, score in index.wand(set(ids[text][first : first + 2 * s].tolist())):
            if held is None:
                passage = words[text][first : first + 2 * s]
                held = {k: set(zip(*(passage[j:] for j in range(k)), strict=False)) for k in range(1, RUN + 1)}
            q, a = ((sum(r in held[len(r)] for r in x) / len(x) if x else 1.0) for x in index.runs[i])
            if q >= index.overlap and a >= index.overlap:
                yield text, index.items["item"].iat[i], first, score, q, a


FOUND = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, threshold: float = 0.5, overlap: float = 0.5, k1: float = 1.2, b: float = 0.75, postings: int = 2_000_000, stride: int = 64) -> DataFrame:
    """One row for each document and item that it quotes, with the passage of the highest score."""
    session = docs.sparkSession
    found = session.createDataFrame([], FOUND)
    all_parts = build(items, item_id_col, item_text_col, question_col, answer_col, threshold=threshold, overlap=overlap, k1=k1, b=b, postings=postings, least_stride=stride)
    part = next(all_parts, None)
    while part is not None:
        shared = session.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value

            def searched(docs: list, words: list) -> pa.RecordBatch:
                best: dict[tuple[int, int], tuple] = {}
                for text, item, first, score, q, a in matches(words, index):
                    if (key := (text, item)) not in best or score > best[key][3]:
                        best[key] = (docs[text], item, first, score, q, a)
                columns = list(zip(*best.values(), strict=True)) or [[]] * 6
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

            for batch in batches:
                ids, words, size = [], [], 0
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    words.append(terms(text))
                    size += 1 + len(words[-1]) // index.stride
                    if size >= BATCH_STRIDES:
                        yield searched(ids, words)
                        ids, words, size = [], [], 0
                if ids:
                    yield searched(ids, words)

        rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        own = rows.mapInArrow(run, FOUND)
        part = next(all_parts, None)
        if part is not None:
            own = stored(own)
            shared.destroy()
        found = found.union(own)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that quote no item. A row with a null id stays only if no such row quotes one."""
    bad = leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)
