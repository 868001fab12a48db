"""Language-model scoring by a hierarchical Pitman-Yor model of word bigrams.

Restaurants: one for every context word (the mark of a text's end stands before its first word), whose parent is the one
restaurant of all words, whose base is uniform over the V words of the training texts and one unknown word. A dish of a
context's restaurant with c customers has t tables; the tables of all contexts are the customers of the parent.

Gibbs sampling: given a Gamma variate v of each restaurant (shape strength / discount + its tables), the table counts of its
dishes are independent: P(t) is in proportion to S(c, t), a generalised Stirling number, and to discount v P for each table,
where P is the parent's predictive probability of the dish given its other customers. A sweep draws v and reseats all
customers of every dish of every context at once from that conditional, then the parent's likewise. Dishes of more than EXACT
customers are seated in runs of customers, an eighth of those already seated. Predictive probabilities are averaged over the
sweeps kept.

On Spark: texts are cut into blocks of tokens; a block sends each shard of words the counts of its bigrams. A shard holds all
contexts of its words, so their parent's customers are its own; what it needs of others are the customers and tables of each
context, which are summed over shards after counting and again after the first sweeps. Between these exchanges a shard takes
the others' share as it was. At last the blocks send their bigrams again with the documents that hold them, and shards
return sums by document, so neither token rows nor probabilities of single bigrams travel.

Skew: words whose share of a sample is above a quarter of a shard are dealt to several shards by context (their sums meet in
the driver, at most four rows a shard); bigrams with more than a quarter of a shard's tokens are scored in the blocks, from a
broadcast of at most four a shard. The sample decides the layout only.

Words are 64-bit hashes, contexts 48 bits of them; equal hashes would be one word (odds of 1 in 10^6 at 6 million words).
A null or empty text is one end token. A null doc_id counts as training. Repeated rows count as often as they occur. Without
training rows all words are unknown. Other columns are ignored. The rows of ``docs`` must come in the same order whenever a
partition is read again, as from files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tuned

END = np.uint64(0x5851F42D4C957F2D)
CONTEXT = np.uint64((1 << 48) - 1)
EXACT = 1024  # customers of a dish whose tables are drawn from the full conditional
STRENGTH = 1.0
BURN_IN, KEPT = 4, 4
FLUSH = 1_500_000  # tokens of a block
DOCUMENTS = 1 << 16  # of a block, whose numbers are 16 bits
KEYS = 1 << 62  # keys of bigrams by shard that a block may have
SOME = 1000  # documents that are taken of a batch at once, whatever its size
SHARD_BYTES = 10 << 20  # of text for each shard
SLICE = 1 << 20  # bytes that are hashed at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(10).integers(1, 1 << 63, 256, np.uint64)
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, each text's end included, and the number of each text's."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, edges, data = texts.buffers()
    edge = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = _LOWER[np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]] if data is not None else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    word = ~_SPACE[low]
    apart = np.ones(len(low) + 1, bool)  # no word goes on from the byte before
    apart[1:-1] = ~word[:-1]
    apart[edge] = True
    start = np.flatnonzero(word & apart[:-1])
    hashes = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + SLICE)))
            begin = start[at:to] - start[at]
            part = low[start[at] : start[to] if to < len(start) else len(low)]
            size = np.diff(np.append(begin, len(part)))
            place = np.arange(len(part)) - np.repeat(begin, size)
            power = np.cumprod(np.full(int(size.max()), _STEP))
            hashes[at:to] = np.add.reduceat(_BYTE[part] * power[place], begin)
            at = to
    count = np.diff(np.searchsorted(start, edge)) + 1
    out = np.empty(len(start) + len(count), np.uint64)
    last = np.cumsum(count) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[last] = END
    out[inner] = _mix(hashes)
    return out, count


def packed(x: np.ndarray) -> bytes:
    """Counts as a byte each, those from 255 on as eight bytes behind them."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def unpacked(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(b, "<i8", offset=n)
    return out


def packed_contexts(u: np.ndarray) -> bytes:
    return u.astype("<u4").tobytes() + (u >> np.uint64(32)).astype("<u2").tobytes()


def contexts_of(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == keys, i, -1)


@dataclass
class Layout:
    """How words are dealt to shards, and what is known of hot words (all arrays by hot word) and hot bigrams."""

    shards: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # shards of each hot word
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # its training tokens
    guests: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # its customers in the parent
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hot bigrams: mixed hash, sorted
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # their log10 probability and the word's base score

    def shard(self, words: np.ndarray, iw: np.ndarray, iu: np.ndarray) -> np.ndarray:
        """Shard of each bigram (words[iw] after words[iu])."""
        own = (words % np.uint64(self.shards)).astype(np.int64)
        at = _find(self.hot, words)
        wide = np.where(at >= 0, self.spread[at], 1) if len(self.hot) else np.ones(len(words), np.int64)
        out = own[iw]
        some = np.flatnonzero(wide[iw] > 1)
        step = (_mix(words[iu[some]] & CONTEXT) >> np.uint64(8)).astype(np.int64) % wide[iw[some]]
        out[some] = (out[some] + step) % self.shards
        return out


def pair_hash(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(w * _STEP + u)


REQUEST = "shard int, block long, docs long, w binary, k binary, u binary, n binary, m binary, at binary, ids array<long>, head binary"


def requests(docs: DataFrame, layout: Layout, counting: bool) -> DataFrame:
    """Rows of (shard, block): bigrams of a block, grouped by word, with their numbers in training texts; when not
    ``counting``, of all texts and with the documents that hold them. One row of a block has its documents' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(layout)  # bounded: four hot words and bigrams for each shard
    names = [x.split()[0] for x in REQUEST.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = shared.value
        number = TaskContext.get().partitionId() << 32
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            size, train = np.concatenate(sizes), np.concatenate(flags)
            word, iw = np.unique(np.concatenate(parts), return_inverse=True)
            parts.clear()
            iu = np.concatenate([[np.searchsorted(word, END)], iw[:-1]])  # every text ends with END, which stands before the next
            doc = np.repeat(np.arange(len(size)), size)
            head = np.zeros((len(size), 3))
            if counting:
                of = train[doc] > 0
                iw, iu = iw[of], iu[of]
            k = len(word)
            at = lay.shard(word, iw, iu)
            if lay.shards * k * k < KEYS:
                present = np.arange(lay.shards)
            else:  # the shards of this block only are numbered, so that keys keep to 63 bits
                present, at = np.unique(at, return_inverse=True)
            key = (at * k + iw) * k + iu
            del iw, iu, at
            if counting:
                keys, n = np.unique(key, return_counts=True)
                m, where = n, np.zeros(0, np.uint16)
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                keys, m = key[first], np.diff(np.append(first, len(key)))
                where = doc[order]
                del key, order, doc
                n = np.add.reduceat(train[where], first)
                hot = _find(lay.pairs, pair_hash(word[keys // k % k], word[keys % k] & CONTEXT))
                if (hot >= 0).any():  # scored here
                    at = np.repeat(hot, m)
                    for column, value in enumerate((lay.values[:, 0], lay.values[:, 1], np.ones(len(lay.values)))):
                        head[:, column] = np.bincount(where[at >= 0], value[at[at >= 0]], len(size))
                    where, m = where[at < 0], np.where(hot >= 0, 0, m)
                where = where.astype(np.uint16)
            end = np.concatenate([[0], np.cumsum(m)])
            cut = np.searchsorted(keys, np.arange(len(present) + 1) * k * k)
            home = int(present[(number & 0xFFFFFFFF) % len(present)])
            rows: list[list] = [[] for _ in kinds]
            for i in np.flatnonzero((np.diff(cut) > 0) | (present == home)).tolist():
                s, a, b = int(present[i]), cut[i], cut[i + 1]
                w = keys[a:b] // k % k
                start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if b > a else np.zeros(0, np.int64)
                own = s == home and not counting
                row = [s, number, len(size), word[w[start]].tobytes(), packed(np.diff(np.append(start, b - a))), packed_contexts(word[keys[a:b] % k] & CONTEXT), packed(n[a:b])]
                row += [b"", b""] if counting else [packed(m[a:b]), where[end[a] : end[b]].tobytes()]
                row += [list(ids), np.column_stack([size, head]).tobytes()] if own else [None, None]
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
            number, held = number + 1, 0
            for x in (sizes, flags, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

        for b in (whole.slice(i, SOME) for whole in batches for i in range(0, whole.num_rows, SOME)):
            w, size = tokens(b.column(2))
            parts.append(w)
            sizes.append(size)
            flags.append(np.asarray(b.column(1)).astype(np.int64))
            ids += b.column(0).to_pylist()
            held += len(w)
            if held >= FLUSH or len(ids) > DOCUMENTS - SOME:
                yield flush()
        if ids:
            yield flush()

    return docs.select("id", "train", "text").mapInArrow(run, REQUEST)


@dataclass
class Merged:
    """All bigrams of a shard: word, context, training count; ``back`` leads from the rows' bigrams to them."""

    words: np.ndarray
    contexts: np.ndarray
    iw: np.ndarray
    iu: np.ndarray
    c: np.ndarray
    back: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Merged:
        w, u, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for words, k, contexts, count in zip(*(rows.column(c).to_pylist() for c in ("w", "k", "u", "n")), strict=True):
            w.append(np.repeat(np.frombuffer(words, np.uint64), unpacked(k, len(words) // 8)))
            u.append(contexts_of(contexts))
            n.append(unpacked(count, len(u[-1])))
        words, iw = np.unique(np.concatenate(w), return_inverse=True)
        contexts, iu = np.unique(np.concatenate(u), return_inverse=True)
        keys, back = np.unique(iw * max(1, len(contexts)) + iu, return_inverse=True)
        c = np.bincount(back, np.concatenate(n), len(keys)).astype(np.int64)
        return Merged(words, contexts, keys // max(1, len(contexts)), keys % max(1, len(contexts)), c, back)


@lru_cache(4)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row c, column t, for 1 <= t <= c."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
        out[c + 1, 1:] = np.logaddexp(stay, out[c, :-1])
    return out


def draw_tables(c: np.ndarray, factor: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, P(t) in proportion to S(c, t) and ``factor(dish, j)`` for each table j < t."""
    t = np.minimum(c, 1)
    u = rng.random(len(c))
    two = np.flatnonzero(c == 2)
    x = factor(two, np.ones(len(two)))
    t[two] += u[two] < x / (x + 1 - discount)
    table = stirling(discount)
    some = np.flatnonzero((c > 2) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    edges = np.flatnonzero(np.diff(c[some], prepend=0, append=0)) if len(some) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n = int(c[some[a]])
        for i in range(a, b, max(1, (1 << 20) // n)):
            at = some[i : min(b, i + max(1, (1 << 20) // n))]
            logits = np.repeat(table[None, n, 1 : n + 1], len(at), axis=0)
            logits[:, 1:] += np.cumsum(np.log(factor(at[:, None], np.arange(1, n)[None, :])), axis=1)
            p = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (p < u[at, None] * p[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        seated, open_ = np.ones(len(many)), np.ones(len(many))
        while (left := np.flatnonzero(seated < c[many])).size:
            run = np.minimum(c[many[left]] - seated[left], np.maximum(1, np.floor(seated[left] / 8))).astype(np.int64)
            x = factor(many[left], open_[left])
            open_[left] += rng.binomial(run, x / (x + np.maximum(seated[left] - discount * open_[left], 1e-9)))
            seated[left] += run
        t[many] = open_
    return t


@dataclass
class Parent:
    """Totals of the parent restaurant over all shards, as they were at the last exchange."""

    words: int
    guests: float
    tables: float
    discount: float
    lower: float  # the contexts' discount
    base: float  # probability of every word, the unknown one included


@dataclass
class Seating:
    """Seats of a shard: ``c`` and ``t`` of its bigrams with customers, and what of the contexts and the parent it takes from others."""

    parent: Parent
    iw: np.ndarray
    iu: np.ndarray
    c: np.ndarray
    t: np.ndarray
    contexts: np.ndarray  # tables of each context over all shards, at the last exchange
    single: np.ndarray  # by word: bigrams of one customer, which have one table
    offset: np.ndarray  # by word: customers in the parent that other shards have (hot words)
    owner: np.ndarray  # by word: whether its tables in the parent are counted here
    rng: np.random.Generator
    t1: np.ndarray | None = None  # tables of the words in the parent, by the sweeps before the last exchange

    def __post_init__(self) -> None:
        self.began = np.bincount(self.iu, self.t, len(self.contexts))
        if self.t1 is None:
            self.t1 = np.minimum(self.guests(), 1)
        self.first = self.own()
        self.predict()

    def own(self) -> np.ndarray:
        """Customers and tables in the parent that are counted here."""
        return np.array([self.guests(own=True).sum(), self.t1[self.owner].sum()], float)

    def guests(self, own: bool = False) -> np.ndarray:
        n = self.single + np.bincount(self.iw, self.t, len(self.single)).astype(np.int64)
        return n if own else n + self.offset

    def tables(self) -> np.ndarray:
        """Tables of each context, the others' share as it was."""
        return self.contexts - self.began + np.bincount(self.iu, self.t, len(self.contexts))

    def totals(self) -> tuple[float, float]:
        """Customers and tables of the parent, the others' share as it was."""
        guests, tables = self.own() - self.first
        return self.parent.guests + guests, self.parent.tables + tables

    def upper(self, tables: float) -> np.ndarray:
        """Tables of the parent's dishes, drawn anew."""
        p = self.parent
        weight = p.discount * self.rng.gamma(STRENGTH / p.discount + tables) * p.base
        return draw_tables(self.guests(), lambda at, j: np.full(np.broadcast_shapes(at.shape, j.shape), weight), p.discount, self.rng)

    def predict(self) -> None:
        p = self.parent
        guests, tables = self.totals()
        self.unknown = (STRENGTH + p.discount * tables) * p.base / (STRENGTH + guests)
        self.p = np.maximum(self.guests() - p.discount * self.t1, 0) / (STRENGTH + guests) + self.unknown

    def sweep(self) -> None:
        p = self.parent
        guests, tables = self.totals()
        v = self.rng.gamma(np.maximum(STRENGTH / p.lower + self.tables(), 1e-3))
        scale = p.lower / (STRENGTH + guests) * v[self.iu]
        others, t1 = self.guests()[self.iw] - self.t, self.t1[self.iw]
        more = (STRENGTH + p.discount * tables) * p.base

        def lower(at: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Weight of one more table, with j of the dish here and the others' as customers in the parent."""
            n = others[at] + j
            return scale[at] * (n - p.discount * np.minimum(t1[at], n) + more)

        self.t = draw_tables(self.c, lower, p.lower, self.rng)
        self.t1 = self.upper(tables)
        self.predict()


MODEL = "kind int, shard int, other int, a binary, b binary, c binary, d binary, e binary"
PAIRS, ACTIVE, HOT, STATS, EXTRA, TABLES, PREDICTED = range(7)


def _rows(rows: list[tuple]) -> pa.Table:
    full = [(*r, *[None] * (8 - len(r))) for r in rows]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array([r[i] for r in full], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in MODEL.split(", ")])


def _by_home(kind: int, shard: int, shards: int, u: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows of contexts (ascending) for the shards that sum them up."""
    home = (u % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(shards + 1))
    return [(kind, shard, s, packed_contexts(u[at]), *[packed(c[at]) for c in columns]) for s in np.flatnonzero(np.diff(cut)).tolist() for at in [order[cut[s] : cut[s + 1]]]]


def count(docs: DataFrame, layout: Layout) -> DataFrame:
    """What shards count: customers and dishes of contexts, dishes of more than one customer, hot words, statistics."""
    shards, hot = layout.shards, layout.hot

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        m = Merged.of(rows)
        n1 = np.bincount(m.iw, minlength=len(m.words))
        active = np.flatnonzero(m.c > 1)
        is_hot = _find(hot, m.words) >= 0
        total = np.bincount(m.iw, m.c, len(m.words)).astype(np.int64)
        stats = [np.count_nonzero(~is_hot), m.c.sum(), len(m.c), *(np.count_nonzero(m.c == i) for i in (1, 2)), *(np.count_nonzero(n1[~is_hot] == i) for i in (1, 2))]
        out = _by_home(PAIRS, shard, shards, m.contexts, np.bincount(m.iu, m.c, len(m.contexts)).astype(np.int64), np.bincount(m.iu, minlength=len(m.contexts)))
        out.append((ACTIVE, shard, 0, m.words.tobytes(), packed(n1), m.iw[active].astype("<i4").tobytes(), packed_contexts(m.contexts[m.iu[active]]), packed(m.c[active])))
        out.append((HOT, shard, 0, m.words[is_hot].tobytes(), total[is_hot].astype("<i8").tobytes(), n1[is_hot].astype("<i8").tobytes()))
        out.append((STATS, shard, 0, np.array(stats, "<i8").tobytes()))
        return _rows(out)

    return requests(docs, layout, True).groupBy("shard").applyInArrow(run, MODEL)


def exchanged(rows: DataFrame) -> DataFrame:
    """Each shard's contexts with their customers and tables, summed over all shards and over rows of EXTRA tables."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [(k, s, contexts_of(a), b, c) for k, s, a, b, c in zip(*(rows.column(x).to_pylist() for x in ("kind", "shard", "a", "b", "c")), strict=True)]
        _, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        own = [np.bincount(back, np.concatenate([unpacked(p[i], len(p[2])) for p in parts])).astype(np.int64)[back] for i in (3, 4)]
        edge = np.cumsum([0] + [len(p[2]) for p in parts])
        return _rows([(PAIRS, s, 0, packed_contexts(u), *[packed(x[edge[i] : edge[i + 1]]) for x in own]) for i, (k, s, u, _, _) in enumerate(parts) if k == PAIRS])

    return rows.groupBy("other").applyInArrow(run, MODEL)


def _contexts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a shard in order, their customers and tables."""
    found = [(contexts_of(a), b, c) for k, a, b, c in zip(*(rows.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True) if k == PAIRS]
    u = np.concatenate([np.zeros(0, np.uint64), *[f[0] for f in found]])
    customers, tables = (np.concatenate([np.zeros(0, np.int64), *[unpacked(f[i], len(f[0])) for f in found]]) for i in (1, 2))
    order = np.argsort(u)
    return u[order], customers[order], tables[order]


def _offsets(layout: Layout, words: np.ndarray, own: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """By word: customers that other shards have of it, and whether this shard counts its tables."""
    at = _find(layout.hot, words)
    known = len(layout.guests) > 0
    offset = np.where(at >= 0, layout.guests[at] - own, 0) if known else np.zeros(len(words), np.int64)
    return offset, (at < 0) | ((words % np.uint64(layout.shards)).astype(np.int64) == shard)


def _predicted(p: Parent, seats: Seating, c: np.ndarray, t: np.ndarray, iw: np.ndarray, customers: np.ndarray, iu: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Probability of bigrams under one seating."""
    return (np.maximum(c - p.lower * t, 0) + (STRENGTH + p.lower * tables[iu]) * seats.p[iw]) / (STRENGTH + customers[iu])


def sampled(counted: DataFrame, contexts: DataFrame, layout: Layout, parent: Parent, tokens_: int, burn_in: int, kept: int) -> DataFrame:
    """The first sweeps: tables of the dishes, tables that contexts gained, statistics, and hot bigrams' probabilities."""
    shared = counted.sparkSession.sparkContext.broadcast(layout)

    def run(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        shard, lay, p = key[0].as_py(), shared.value, parent
        if not len(rows):
            return _rows([])
        words, n1, iw, u, c = (rows.column(x)[0].as_py() for x in "abcde")
        words = np.frombuffer(words, np.uint64)
        n1, iw, u = unpacked(n1, len(words)), np.frombuffer(iw, "<i4").astype(np.int64), contexts_of(u)
        c = unpacked(c, len(u))
        of, customers, tables = _contexts(found)
        iu = np.searchsorted(of, u)
        offset, owner = _offsets(lay, words, n1, shard)
        seats = Seating(p, iw, iu, c, np.ones(len(c), np.int64), tables, n1 - np.bincount(iw, minlength=len(words)), offset, owner, np.random.default_rng([1, shard]))
        hot = np.flatnonzero(c > tokens_ / (4 * lay.shards))
        total = np.zeros(len(hot))
        for i in range(burn_in + kept):
            seats.sweep()
            if i >= burn_in:
                total += _predicted(p, seats, c[hot], seats.t[hot], iw[hot], customers, iu[hot], seats.tables())
        gained = (np.bincount(iu, seats.t - 1, len(of))).astype(np.int64)
        some = np.flatnonzero(gained)
        guests = seats.guests(own=True)
        is_hot = _find(lay.hot, words) >= 0
        out = [(TABLES, shard, 0, packed(seats.t), packed(seats.t1))]
        out += _by_home(EXTRA, shard, lay.shards, of[some], np.zeros(len(some), np.int64), gained[some])
        out.append((HOT, shard, 0, words[is_hot].tobytes(), guests[is_hot].astype("<i8").tobytes()))
        out.append((STATS, shard, 0, seats.own().astype("<i8").tobytes()))
        out.append((PREDICTED, shard, 0, words[iw[hot]].tobytes(), packed_contexts(u[hot]), (total / max(1, kept)).astype("<f8").tobytes()))
        return _rows(out)

    return counted.where(F.col("kind") == ACTIVE).groupBy("shard").cogroup(contexts.groupBy("shard")).applyInArrow(run, MODEL)


PARTIAL = "block long, sums binary, ids array<long>, head binary"


def partial_sums(docs: DataFrame, model: DataFrame, layout: Layout, parent: Parent, n_tokens: int, burn_in: int, kept: int) -> DataFrame:
    """Sums over the bigrams of each shard and block by document: log10 probability, base score, known words."""
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    names = [x.split()[0] for x in PARTIAL.split(", ")]

    def run(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        shard, lay, p = key[0].as_py(), shared.value, parent
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        if not len(rows):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        m = Merged.of(rows)
        of, customers, tables = _contexts(found)
        at = _find(of, m.contexts)
        customers, tables = (np.where(at >= 0, x[at], 0) if len(of) else np.zeros(len(m.contexts), np.int64) for x in (customers, tables))
        seen = m.c > 0
        n1 = np.bincount(m.iw[seen], minlength=len(m.words))
        active = np.flatnonzero(m.c > 1)
        drawn = [(a, b) for k, a, b in zip(*(found.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True) if k == TABLES]
        t, t1 = np.ones(len(active), np.int64), np.minimum(n1, 1)
        if drawn:
            t, t1[n1 > 0] = unpacked(drawn[0][0], len(active)), unpacked(drawn[0][1], np.count_nonzero(n1))
        iw, iu = m.iw[active], m.iu[active]
        single = n1 - np.bincount(iw, minlength=len(m.words))
        own = single + np.bincount(iw, t, len(m.words)).astype(np.int64)
        offset, owner = _offsets(lay, m.words, own, shard)
        seats = Seating(p, iw, iu, m.c[active], t, tables, single, offset, owner, np.random.default_rng([2, shard]), t1)
        every = np.minimum(m.c, 1)
        total = np.zeros(len(m.c))
        for i in range(burn_in + kept):
            seats.sweep()
            if i >= burn_in:
                every[active] = seats.t
                total += _predicted(p, seats, m.c, every, m.iw, customers, m.iu, seats.tables())
        score = np.log10(total / kept)
        n = np.bincount(m.iw, m.c, len(m.words)).astype(np.int64)
        hot = _find(lay.hot, m.words)
        if len(lay.hot):
            n = np.where(hot >= 0, lay.count[hot], n)
        base = np.log10((n + 1) / (n_tokens + p.words + 1))[m.iw]
        known = (n > 0)[m.iw].astype(np.float64)
        out, edge = [], 0
        for block, docs_, u, times, where, ids, head in zip(*(rows.column(c).to_pylist() for c in ("block", "docs", "u", "m", "at", "ids", "head")), strict=True):
            size = len(u) // 6
            at = np.repeat(m.back[edge : edge + size], unpacked(times, size))
            doc = np.frombuffer(where, np.uint16)
            sums = [np.bincount(doc, x[at], docs_) for x in (score, base, known)]
            out.append((block, sums[0].astype("<f4").tobytes() + sums[1].astype("<f8").tobytes() + sums[2].astype("<u4").tobytes(), ids, head))
            edge += size
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    asked = requests(docs, layout, False)
    return asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(run, PARTIAL)


SCORED = "id long, n_tokens long, n_known long, base_score double, score double"


def summed(partial: DataFrame) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        heads = rows.column("head").to_pylist()
        home = next(i for i, h in enumerate(heads) if h is not None)
        size, score, base, known = np.frombuffer(heads[home]).reshape(-1, 4).T.copy()
        n = len(size)
        for b in rows.column("sums").to_pylist():
            score += np.frombuffer(b, "<f4", n)
            base += np.frombuffer(b, "<f8", n, 4 * n)
            known += np.frombuffer(b, "<u4", n, 12 * n)
        ids = pa.array(rows.column("ids")[home].as_py(), pa.int64())
        return pa.table({"id": ids, "n_tokens": size.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": score})

    return partial.groupBy("block").applyInArrow(run, SCORED)


def hot_words(docs: DataFrame, shards: int, one_in: int = 64) -> Layout:
    """Words with more than a quarter of a shard's tokens, from a sample of the documents; decides the layout only."""
    if shards == 1:
        return Layout(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n = np.unique(tokens(b.column(0))[0], return_counts=True)
            some = n > n.sum() / (16 * shards)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[some].view(np.int64), 0)), pa.array(np.append(n[some], n.sum())), pa.array(np.arange(some.sum() + 1) == some.sum())], ["word", "n", "total"])

    found = docs.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(one_in)) == 0).select("text").mapInArrow(run, "word long, n long, total boolean")
    found = found.groupBy("word", "total").agg(F.sum("n").alias("n"))
    total = found.where("total").agg(F.sum("n")).first()[0] or 0
    rows = found.where(~F.col("total") & (F.col("n") > total / (4 * shards))).toPandas()
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    wide = np.minimum(shards, np.ceil(rows["n"].to_numpy(np.float64) * 4 * shards / max(1, total))).astype(np.int64)
    return Layout(shards, words[order], wide[order])


def _summed_hot(rows: list, hot: np.ndarray, columns: int) -> list[np.ndarray]:
    out = [np.zeros(len(hot), np.int64) for _ in range(columns)]
    for r in rows:
        at = np.searchsorted(hot, np.frombuffer(r["a"], np.uint64))
        for total, name in zip(out, "bc", strict=False):
            np.add.at(total, at, np.frombuffer(r[name], "<i8"))
    return out


def _total(df: DataFrame, kind: int, size: int) -> np.ndarray:
    """Sums of the statistics of all shards, added up in tasks first."""
    return sum((np.frombuffer(r["a"], "<i8").astype(object) for r in df.where(F.col("kind") == kind).select("a").toLocalIterator()), np.zeros(size, object))


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def scores(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, burn_in: int = BURN_IN, kept: int = KEPT) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows where ``train`` is true."""
    tuned(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), train.cast("int").alias("train"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = hot_words(texts, max(1, -(-size // shard_bytes)))
    counted = stored(count(texts, layout), "kind")
    words, n_tokens, bigrams, *ones = _total(counted, STATS, 7).tolist()
    if len(layout.hot):
        layout.count, layout.guests = _summed_hot(counted.where(F.col("kind") == HOT).select("a", "b", "c").collect(), layout.hot, 2)
        words += int(np.count_nonzero(layout.count))
    parent = Parent(words, float(bigrams), float(words), _discount(ones[2], ones[3]), _discount(ones[0], ones[1]), 1 / (words + 1))
    pairs = counted.where(F.col("kind") == PAIRS)
    first = stored(sampled(counted, exchanged(pairs), layout, parent, n_tokens, burn_in, kept), "kind")
    guests, tables = _total(first, STATS, 2).tolist()
    if words:
        parent.guests, parent.tables = float(guests), float(tables)
    if len(layout.hot):
        (layout.guests,) = _summed_hot(first.where(F.col("kind") == HOT).select("a", "b").collect(), layout.hot, 1)
        hot = [(np.frombuffer(r["a"], np.uint64), contexts_of(r["b"]), np.frombuffer(r["c"])) for r in first.where(F.col("kind") == PREDICTED).select("a", "b", "c").collect()]
        w, u, p = (np.concatenate([x[i] for x in hot]) for i in range(3))
        key, at = pair_hash(w, u), _find(layout.hot, w)
        own = at >= 0  # a word that the sample missed stays with its shard
        base = np.log10((layout.count[at[own]] + 1) / (n_tokens + words + 1))
        order = np.argsort(key[own])
        layout.pairs, layout.values = key[own][order], np.column_stack([np.log10(p[own]), base])[order]
    model = exchanged(pairs.unionByName(first.where(F.col("kind") == EXTRA))).unionByName(first.where(F.col("kind") == TABLES))
    result = summed(partial_sums(texts, model, layout, parent, n_tokens, 1, kept))
    return result.select("id", "n_tokens", "n_known", F.lit(int(n_tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    found = scores(docs, ~held_out())
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
