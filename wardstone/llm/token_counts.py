"""Token counts of documents without their ids: pieces are counted once for each distinct pre-token.

1. Texts are split into pre-tokens as the tokenizer does. Runs of documents form blocks: the distinct pre-tokens of the
   block, and for each document how often it holds which of them (numbers within the block, sorted, as differences).
2. The blocks' pre-tokens are dealt by hash and sorted, so that equal ones of the whole corpus are neighbours. The first of them
   is handed to the tokenizer's model, which gives its number of pieces; the others join that number (a merge join whose
   distinct side is made as it is read). A pre-token that every document holds has a row for each block, not for each document.
3. Counts return to their blocks, packed, where a document's frequencies and their counts are multiplied and summed.

The tokenizer is a byte-level BPE file of the tokenizers library (no normalizer; pre-tokens by its pattern); other files are
refused. Characters on whose classes all tables agree are split by a pattern; a text with any other character is split by
the library. Strings of special tokens within texts are special tokens, as the library has it: one token each.

One row for each row: a null text counts as empty (no bytes, no tokens); null and repeated ids keep a row each. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import collections
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_CHARS = 24_000_000  # at which a block is closed after a whole document
#: Characters that the pattern splits; a test holds every one of them against the library.
PLAIN = [(0x0, 0x557), (0x2000, 0x2064), (0x3000, 0x3029), (0x3041, 0x3096), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3)]
BLOCKS = "block long, ids array<long>, n_bytes array<long>, specials array<int>, sizes array<int>, words array<string>, pairs binary"


class Splitter:
    """Pre-tokens of a text, and the number of pieces of a pre-token, for one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path))  # noqa: SIM115
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level vocabulary")
        whole = Tokenizer.from_file(path)
        self.model, self.split = whole.model, whole.pre_tokenizer.pre_tokenize_str
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        letter, number, space = ("".join(self._ranges(regex.compile(p).match)) for p in (r"\p{L}", r"\p{N}", r"\s"))
        plain = "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN)
        self.other = re.compile(f"[^{plain}]").search
        # fixed value: the pattern of byte-level vocabularies, its classes spelled out
        self.runs = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        others = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.bytes = {c: b for b, c in self.shown.items()}

    @staticmethod
    def _ranges(test) -> Iterator[str]:
        for a, b in PLAIN:
            inside = [bool(test(chr(c))) for c in range(a, b + 1)]
            at = a
            for yes, run in itertools.groupby(inside):
                n = len(list(run))
                if yes:
                    yield f"{re.escape(chr(at))}-{re.escape(chr(at + n - 1))}"
                at += n

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special tokens it holds."""
        parts = self.added.split(text)
        out: list[str] = []
        for part in parts:
            if self.other(part):
                out += [bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self.split(part)]
            else:
                out += self.runs(part)
        return out, len(parts) - 1

    def pieces(self, word: str) -> int:
        return len(self.model.tokenize("".join(map(self.shown.__getitem__, word.encode("utf-8", "surrogateescape")))))


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One for each worker process."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def packed(numbers: list[np.ndarray], times: list[np.ndarray]) -> bytes:
    """A block's frequencies: each document's pre-token numbers in ascending order as differences, then how often; bytes of
    one place beside each other, compressed."""
    steps = [np.diff(n, prepend=np.uint32(0)).astype("<u4") for n in numbers]
    both = np.concatenate([*steps, *(t.astype("<u4") for t in times)]) if steps else np.zeros(0, "<u4")
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(packet: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and times of all documents of a block, one after the other."""
    n = int(sizes.sum())
    both = np.frombuffer(pa.decompress(packet, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() if n else np.zeros(0, "<u4")
    total = np.cumsum(both[:n].astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.where(begin > 0, total[np.minimum(begin, n) - 1], 0) if n else np.zeros(len(sizes), np.int64)
    return total - np.repeat(before, sizes), both[n:].astype(np.int64)


def frequencies(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents with their distinct pre-tokens and each document's frequencies."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple[int | None, int, int]] = []
        numbers, times, size = [], [], 0
        known: dict[str, int] = collections.defaultdict(itertools.count().__next__)

        def block() -> pa.RecordBatch:
            nonlocal number, size, known
            ids, n_bytes, specials = zip(*rows, strict=True)
            values = [[number], [ids], [n_bytes], [specials], [[len(x) for x in numbers]], [list(known)], [packed(numbers, times)]]
            number, size = number + 1, 0
            for x in (rows, numbers, times):
                x.clear()
            known = collections.defaultdict(itertools.count().__next__)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for b in batches:
            for doc, text, n_bytes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if rows and size + len(text) > chars:
                    yield block()
                words, specials = s.words(text)
                count = collections.Counter(words)
                both = np.fromiter(map(known.__getitem__, count), np.uint64, len(count)) << np.uint64(32)
                both |= np.fromiter(count.values(), np.uint64, len(count))
                both.sort()
                numbers.append((both >> np.uint64(32)).astype("<u4"))
                times.append((both & np.uint64(0xFFFFFFFF)).astype("<u4"))
                rows.append((doc, n_bytes, specials))
                size += len(text)
        if rows:
            yield block()

    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n")).mapInArrow(run, BLOCKS)


MEETINGS = 1 << 22  # rows of pre-tokens that a task holds before it sends counts back
COUNTS = "id long, n_bytes long, n_tokens long"


def counted(words: DataFrame, path: str) -> DataFrame:
    """(block, sizes, pairs) of (block, place, word): the pieces of the pre-tokens at a block's places, packed. Rows of one
    pre-token are neighbours here: the first has its pieces counted, the others take that count over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path)
        last, count = None, 0
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def back() -> pa.RecordBatch:
            block, place, pieces = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((place, block))
            block, place, pieces = block[order], place[order], pieces[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            runs = list(itertools.pairwise(edges.tolist()))
            pairs = [packed([place[a:b].astype(np.uint32)], [pieces[a:b]]) for a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array([[b - a] for a, b in runs], pa.list_(pa.int32())), pa.array(pairs, pa.binary())], ["block", "sizes", "pairs"])

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(2).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            pieces = np.array([count if w == last else s.pieces(w) for w in distinct], np.int64)
            last, count = distinct[-1], int(pieces[-1])
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), pieces[coded.indices.to_numpy()]))
            rows += b.num_rows
            if rows >= MEETINGS:
                yield back()
                rows = 0
        if held:
            yield back()

    return words.repartition("word").sortWithinPartitions("word").select("block", "place", "word").mapInArrow(run, "block long, sizes array<int>, pairs binary")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of documents, from rows in the order of blocks: a block's counts, then the block itself."""
    at, counts = None, []
    for b in batches:
        for block, whole, sizes, packet, ids, n_bytes, specials in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if block != at:
                at, counts = block, []
            if not whole:
                counts.append(unpacked(packet, np.array(sizes, np.int64)))
                continue
            pieces = np.zeros(sum(len(place) for place, _ in counts), np.int64)
            for place, found in counts:
                pieces[place] = found
            sizes = np.array(sizes, np.int64)
            number, times = unpacked(packet, sizes)
            running = np.concatenate([[0], np.cumsum(pieces[number] * times)])
            ends = np.cumsum(sizes)
            total = running[ends] - running[ends - sizes] + np.array(specials, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(total)], ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``."""
    blocks = stored(frequencies(docs, path, id_col, text_col, chars))
    found = counted(blocks.select("block", F.posexplode("words").alias("place", "word")), path).withColumn("whole", F.lit(False))
    own = blocks.select("block", F.lit(True).alias("whole"), "sizes", "pairs", "ids", "n_bytes", "specials")
    both = found.unionByName(own, allowMissingColumns=True).select(*own.columns)
    return both.repartition("block").sortWithinPartitions("block", "whole").mapInArrow(summed, COUNTS)


def query(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts(docs, path)
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
