"""Token ids as binary blocks: a static range asymmetric numeral system over one shared frequency table.

1. Every text is tokenized whole and an end id is appended; ids are kept as little-endian integers.
2. Counts of all ids (at most one row for each id of the vocabulary) become the shared frequency table; each id of the
   vocabulary has a share of at least one, so any block can be coded.
3. Documents are parted by ranges of doc_id whose bounds Spark samples, and sorted within; each range (shard) is one file
   of blocks of whole documents, files in ascending order.
4. The files are read back and decoded, each block on its own. A document's place among all ids comes from running totals of
   the shards.

A block is self-describing: header, checkpoints, coded words. Token t belongs to lane t mod lanes; a checkpoint holds all
lane states and the word offset at a step, so parts of a block can be decoded in parallel. CRC32 sums cover the stored
bytes and the decoded ids. The frequency table lies beside the blocks, with its own CRC32, which each block's header
repeats: the folder is all that a reader needs.

The blocks are rows of a Parquet table in the shared folder: Spark's writer commits them, so lost executors and repeated
tasks leave no half-written block.

A null text counts as empty (the end id alone). Null doc_ids come before all others; repeated doc_ids keep a row each, in
the order of a hash of their ids. Other columns are ignored. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored

SCALE = 20
LANES = 1024
STEPS = 256  # between checkpoints
BLOCK = 1 << 19  # tokens, at which a block is closed after a whole document
HEADER = struct.Struct("<4sHHIIIIII")
MAGIC = b"WRN2"
CHUNKS, PIECES = 350_000, 800_000  # that a worker remembers
_LOW = np.uint64(1 << 31)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's merges never cross white space, and its pattern parts a chunk without white space into runs that
    the library's model encodes one by one. Chunks of simple Latin characters take that way and are remembered; a
    chunk with any other character, or one that may hold a special token, goes through the whole library call.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.load(open(path))  # noqa: SIM115
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.runs = regex.compile(split).findall
        # outside: what the fast way leaves to the library: marks, other scripts, U+0130 and the start of special tokens
        self.other = regex.compile(r"[^\x00-įı-ɏ]|<\|").search
        self.control = regex.compile(r"[\x00-\x08\x0e-\x1b\x7f]").search
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.size = self.whole.get_vocab_size()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        others = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            shown = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
            found = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()
        return found

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk.lower())
        if not chunk.isascii() and self.other(chunk) or "<|" in chunk or not chunk.isprintable() and self.control(chunk):
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        if chunk.isalpha():  # a run of letters, perhaps with one mark after it: what the pattern would find
            return self._piece(chunk.lower())
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
            return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1])
        return b"".join(map(self._piece, self.runs(chunk.lower())))

    def ids(self, text: str) -> bytes:
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to Python, not to the library
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = text.split()
        for w in set(words).difference(self.chunks):
            self.chunks[w] = self._chunk(w)
        return b"".join(map(self.chunks.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, with what it remembers."""
    return _encoders.setdefault(path, None) or _encoders.__setitem__(path, Encoder(path)) or _encoders[path]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids of the whole text and the end id, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            ids = [e.ids(t) + end if t else end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def count_ids(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """(token, n), summed within each task first; at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype))
            total, n = (total, n) if len(total) >= len(n) else (n, total)
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def shares(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole shares of 2**scale, at least one each, nearly in proportion to the counts."""
    rest = (1 << scale) - len(counts)
    assert rest > 0, "the vocabulary needs a larger scale"
    total = max(1, int(counts.sum()))
    part = counts.astype(object) * rest // total if total > 1 << 40 else counts.astype(np.int64) * rest // total
    share = 1 + np.array(part, np.int64)
    share[int(np.argmax(counts))] += (1 << scale) - int(share.sum())
    return share


class Coder:
    def __init__(self, share: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.share = share.astype(np.uint64)
        self.crc = zlib.crc32(share.astype("<u4").tobytes())
        self.start = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
        self.limit = self.share << np.uint64(63 - scale)
        self.symbol = np.repeat(np.arange(len(share), dtype=np.uint32), share)
        self.mask = np.uint64((1 << scale) - 1)

    def encode(self, ids: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 32))
        rounds = -(-n // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        out, marks = [], []
        words = 0
        for t in range(rounds - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            own, f = x[: len(s)], self.share[s]
            full = own >= self.limit[s]
            if full.any():
                out.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                words += len(out[-1])
                own = np.where(full, own >> np.uint64(32), own)
            q = own // f
            x[: len(s)] = (q << self.scale) + (own - q * f) + self.start[s]
            if t % steps == 0:
                marks.append((words, x.copy()))
        payload = b"".join(w.tobytes() for w in reversed(out))
        body = b"".join(struct.pack("<I", words - w) + state.astype("<u8").tobytes() for w, state in reversed(marks)) + payload
        return HEADER.pack(MAGIC, int(self.scale), lanes, n, steps, len(marks), self.crc, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def decode(self, block: bytes, first_mark: int = 0, marks: int | None = None) -> np.ndarray:
        """All ids of a block, or those from one checkpoint over ``marks`` of them."""
        magic, scale, lanes, n, steps, n_marks, table, crc, ids_crc = HEADER.unpack_from(block)
        body = memoryview(block)[HEADER.size :]
        if magic != MAGIC or scale != self.scale or table != self.crc or zlib.crc32(body) != crc:
            raise ValueError("the block is damaged, of another format or of another table")
        size = 4 + 8 * lanes
        words = np.frombuffer(body, "<u4", offset=n_marks * size)
        rounds = -(-n // lanes)
        last = rounds if marks is None else min(rounds, (first_mark + marks) * steps)
        begin = first_mark * steps
        if begin >= last:
            return np.zeros(0, np.uint32)
        (at,) = struct.unpack_from("<I", body, first_mark * size)
        x = np.frombuffer(body, "<u8", lanes, first_mark * size + 4).astype(np.uint64)
        out = np.empty(min(n, last * lanes) - begin * lanes, np.uint32)
        for t in range(begin, last):
            k = min(lanes, n - t * lanes)
            own = x[:k]
            low = own & self.mask
            s = self.symbol[low]
            out[(t - begin) * lanes : (t - begin) * lanes + k] = s
            own = self.share[s] * (own >> self.scale) + low - self.start[s]
            need = np.flatnonzero(own < _LOW)
            if len(need):
                own[need] = (own[need] << np.uint64(32)) | words[at : at + len(need)]
                at += len(need)
            x[:k] = own
        if first_mark == 0 and last == rounds and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the decoded ids differ from those written")
        return out


BLOCKS = "shard long, number int, start long, doc_ids array<long>, lengths array<int>, block binary"


def write_blocks(tokens: DataFrame, share: np.ndarray, dtype: np.dtype, folder: str, parts: int = 1) -> None:
    """Writes ``folder``/blocks, all documents in ascending id over files and within, and ``folder``/table."""
    session = tokens.sparkSession
    table = session.sparkContext.broadcast(share)  # bounded: one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        at, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start
            all_ids = np.frombuffer(b"".join(ids), dtype)
            lengths = [len(x) // dtype.itemsize for x in ids]
            row = [[at], [number], [start], [docs], [lengths], [coder.encode(all_ids)]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "number", "start", "doc_ids", "lengths", "block"])
            number, start = number + 1, start + len(all_ids)
            ids.clear()
            docs.clear()
            return out

        size = 0
        for b in batches:
            for doc, x in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if ids and size >= BLOCK * dtype.itemsize:
                    yield flush()
                    size = 0
                ids.append(x)
                docs.append(doc)
                size += len(x)
        if ids:
            yield flush()

    order = ["id", "tie"]
    dealt = tokens.select("id", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    dealt.select("id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")
    stored = share.astype("<u4").tobytes()
    row = session.range(1).select(F.lit(SCALE).alias("scale"), F.lit(zlib.crc32(stored)).cast("long").alias("crc32"), F.lit(bytearray(stored)).alias("shares"))
    row.write.parquet(f"{folder}/table")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before; running totals within runs of shards, then over the runs."""
    sums = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sums = sums.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("shard") / 4096))
    before = F.sum("n").over(Window.partitionBy("run").orderBy("shard")) - F.col("n")
    runs = sums.groupBy("run").agg(F.sum("n").alias("total"))
    runs = runs.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("earlier"))
    return sums.withColumn("inside", before).join(runs, "run").select("shard", (F.col("inside") + F.col("earlier")).alias("before"))


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The shares of a folder of blocks."""
    row = spark.read.parquet(f"{folder}/table").first()
    if row["scale"] != SCALE or zlib.crc32(row["shares"]) != row["crc32"]:
        raise ValueError("the frequency table is damaged or of another format")
    return np.frombuffer(row["shares"], "<u4").astype(np.int64)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks of ``folder``."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    table = spark.sparkContext.broadcast(read_table(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for b in batches:
            for shard, start, docs, lengths, block in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = memoryview(coder.decode(block).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                begin = start + ends - np.array(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(begin), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = blocks.select("shard", "start", "doc_ids", "lengths", "block").mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(blocks), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> None:
    """Tokenizes all documents and writes them to ``folder``."""
    e = encoder(path)
    tokens = stored(tokenize(docs, path, end_id))
    found = count_ids(tokens, e.dtype).toPandas()
    counts = np.zeros(e.size, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    write_blocks(tokens, shares(counts), e.dtype, folder, max(1, -(-int(counts.sum()) // (4 * BLOCK))))


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    folder = f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, folder, end_id)
    return read_blocks(docs.sparkSession, folder)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return write_and_read(docs, path)
