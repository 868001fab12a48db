"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each of its positions, one bit for every language. An n-gram's masks at its ``hashes``
positions, ANDed, give all languages whose training texts contain the n-gram anywhere. A text's hits for each language are
counted, corrected for that language's false positives, and the language with the largest corrected count wins. There is
an n-gram for every letter: the letter, the one before it and the two after it, 0 beyond the word's edges.

The filter has eight positions for each n-gram of the largest set, ``FILTER_BYTES`` at the most for 64 languages; beyond it
filters are fuller and their false positives, which are measured, more. Sets cover all training rows, and all languages are
learned: as many as filters of that size hold make a part, and parts are met one after the other, each adding to a row its
best language and the sum of its counts. Ties go to the language that sorts first.

A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing could be learned. A text
whose n-grams are in no set gets the language with most training rows, with score 0. Rows with a null language teach
nothing; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, kept_columns, stored

UNKNOWN = "und"
BATCH_CHARS = 1 << 21
FILTER_BYTES = 1 << 27  # of masks, which are broadcast
BLOCK = 1 << 16  # positions whose masks reach the driver as one row


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    wrong: np.ndarray  # false-positive rate of each language
    hashes: int
    usual: int  # the language with most training rows
    usual_rows: int = 0
    rest: Callable[[], Iterator[Filters]] | None = None  # the other parts of the languages


@lru_cache(1)
def _folded() -> np.ndarray:
    """Code point to lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each after one boundary; where each text begins."""
    joined = "\n" + "\n".join(t.replace("\n", " ") for t in texts) + "\n"
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)], at


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams around a letter and the place of each; no n-gram looks past a word's end."""
    codes = np.append(codes, np.zeros(1, codes.dtype))
    at = np.flatnonzero(codes)
    a, b, c, d = (codes[at + i].astype(np.uint64) for i in (-1, 0, 1, 2))
    with np.errstate(over="ignore"):
        x = ((a << np.uint64(42)) | (b << np.uint64(21)) | c) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x = (x + np.where(c > 0, d, np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32)), at


def _slots(grams: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = grams * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        step = (x >> np.uint64(40)) | np.uint64(1)
        return [((x + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)]


def _batches(texts: list[str], others: list | None = None) -> Iterator[tuple[list[str], list]]:
    """Cut a list into parts of about BATCH_CHARS characters; a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BATCH_CHARS or i == len(texts) - 1:
            yield texts[start : i + 1], others[start : i + 1] if others is not None else []
            start, size = i + 1, 0


def members(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram) of all rows with a language; made distinct within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            rows: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(lang, []).append(text)
            for lang, texts in rows.items():
                for part, _ in _batches(texts):
                    kept.setdefault(lang, []).append(np.unique(_grams(_codes(part)[0])[0]))
                    if len(kept[lang]) > 16:
                        kept[lang] = [np.unique(np.concatenate(kept[lang]))]
        for lang, parts in kept.items():
            grams = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64))], ["lang", "gram"])

    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long").distinct()


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", *, size: int = FILTER_BYTES, hashes: int = 3, most: int = 1024) -> Filters:
    """Filters from all rows of ``train``, of the first part of the languages; ``rest`` makes those of the other parts. A part
    is about ``most`` languages or fewer, and its masks, which alone reach the driver, ``size`` bytes or fewer."""
    counts = train.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    sets = stored(members(train, text_col, lang_col))
    grams = sets.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("grams"))
    known = stored(counts.join(grams, F.col("lang") == F.col("of"), "left").select("lang", "n", F.coalesce("grams", F.lit(0)).alias("grams")))
    n, largest = known.agg(F.count("*"), F.max("grams")).first()
    if not n:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), hashes, 0)
    slots = min(1 << (size // 8).bit_length() - 1, 1 << max(10, int(8 * (largest or 1) - 1).bit_length()))
    most = min(most, 64 * max(1, size // (8 * slots)))
    parts = 1 if n <= most else -(-5 * n // (4 * most))  # hashed names fill parts unevenly
    of = F.pmod(F.xxhash64("lang"), F.lit(parts))

    def made() -> Iterator[Filters]:
        for p in range(parts):
            usual = {r["lang"]: r["n"] for r in known.where(of == p).select("lang", "n").collect()}
            if usual:
                yield _filters(sets.where(of == p), usual, slots, hashes)

    every = made()
    first = next(every)
    if parts == 1:
        return first

    def rest() -> Iterator[Filters]:
        others = made()
        next(others)
        yield from others

    return replace(first, rest=rest)


def _filters(sets: DataFrame, usual: dict[str, int], slots: int, hashes: int) -> Filters:
    """Filters of a part's languages (with their training rows) from their sets of n-grams."""
    languages = sorted(usual)
    masks = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    block = min(BLOCK, slots)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = np.asarray(b.column(0)).view(np.uint64)
            for at in _slots(grams, hashes, slots):
                yield pa.RecordBatch.from_arrays([pa.array((at // block).astype(np.int32)), pa.array((at % block).astype(np.int32)), b.column(1), b.column(2)], ["block", "slot", "word", "mask"])

    def packed(rows: pa.Table) -> pa.Table:
        dense = np.zeros(block, np.int64)
        np.bitwise_or.at(dense, rows["slot"].to_numpy(), rows["mask"].to_numpy())
        return pa.table({"block": rows["block"][:1], "word": rows["word"][:1], "masks": pa.array([dense.tobytes()], pa.binary())})

    numbered = sets.select("gram", place[F.col("lang")].alias("place"))
    bits = numbered.groupBy("gram", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("mask"))
    found = bits.mapInArrow(positions, "block int, slot int, word int, mask long").groupBy("block", "word").applyInArrow(packed, "block int, word int, masks binary")
    for r in found.toLocalIterator():
        masks[r["block"] * block : (r["block"] + 1) * block, r["word"]] = np.frombuffer(r["masks"], np.uint64)
    full = np.array([np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]) / slots
    best = max(range(len(languages)), key=lambda i: usual[languages[i]])
    return Filters(languages, masks, full**hashes, hashes, best, usual[languages[best]])


def tally(texts: list[str | None], f: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: place of the language with the largest corrected count, that count, the sum of all counts, and the
    number of n-grams."""
    best, top, total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    rows = [i for i, t in enumerate(texts) if t]
    if not f.languages or not rows:
        return best, top, total, n
    for part, where in _batches([texts[i] for i in rows], rows):
        codes, starts = _codes(part)
        grams, at = _grams(codes)
        slots = _slots(grams, f.hashes, len(f.masks))
        cut = np.searchsorted(at, starts)  # a text's n-grams belong to its own letters
        n[where] = np.diff(cut)
        hits = np.zeros((len(part), len(f.languages)))
        for i in range(len(f.languages)):
            if i % 64 == 0:
                mask = np.bitwise_and.reduce([f.masks[at, i // 64] for at in slots])
            run = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1))])
            hits[:, i] = (run[cut[1:]] - run[cut[:-1]]).astype(float)
        real = np.clip((hits - n[where][:, None] * f.wrong) / (1 - np.minimum(f.wrong, 0.999)), 0, None)
        best[where], top[where], total[where] = real.argmax(axis=1), real.max(axis=1), real.sum(axis=1)
    return best, top, total, n


def judge(texts: list[str | None], f: Filters) -> tuple[list[str], list[float]]:
    """Language and score of each text, by one part of the languages. The score is the winner's share of the corrected
    counts, times the share of the text's n-grams that it explains."""
    best, top, total, n = tally(texts, f)
    value = np.clip(top / np.maximum(total, 1e-9) * np.minimum(top / np.maximum(n, 1), 1), 0, 1)
    lang = [f.languages[b if t > 0 else f.usual] if k else UNKNOWN for b, t, k in zip(best, top, n, strict=True)]
    return lang, [float(round(v, 6)) for v in value]


def predict(docs: DataFrame, f: Filters, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows of ``docs`` with the language and the score added under ``names`` (columns so named before are replaced).
    With several parts of languages the rows are written and read again after each, so one part's filters are held at once."""
    keep = [F.col(f"`{c}`") for c in kept_columns(docs, *names)]
    both, new = free_names(docs, "prediction", "part")
    found, usual = docs, ("", -1)
    for k, part in enumerate(_parts(f)):
        if k:
            found = stored(found)
        found = found.withColumn(new, _tallied(docs, part)(F.col(text_col)))
        if k:
            a, b = F.col(both), F.col(new)
            ahead = (b["top"] > a["top"]) | ((b["top"] == a["top"]) & (b["lang"] < a["lang"]))
            merged = F.struct(F.when(ahead, b["lang"]).otherwise(a["lang"]).alias("lang"), F.greatest(a["top"], b["top"]).alias("top"), (a["total"] + b["total"]).alias("total"), b["n"].alias("n"))
            found = found.withColumn(both, merged).drop(new)
        else:
            found = found.withColumnRenamed(new, both)
        if part.languages:
            usual = min(usual, (part.languages[part.usual], part.usual_rows), key=lambda x: (-x[1], x[0]))
    x = F.col(both)
    lang = F.when(x["n"] == 0, UNKNOWN).when(x["top"] > 0, x["lang"]).otherwise(usual[0])
    value = F.round(x["top"] / F.greatest(x["total"], F.lit(1e-9)) * F.least(x["top"] / F.greatest(x["n"], F.lit(1)), F.lit(1.0)), 6)
    return found.select(*keep, lang.alias(names[0]), F.least(value, F.lit(1.0)).alias(names[1]))


def _parts(f: Filters) -> Iterator[Filters]:
    yield replace(f, rest=None)
    if f.rest:
        yield from f.rest()


def _tallied(docs: DataFrame, f: Filters) -> Callable[[F.Column], F.Column]:
    shared = docs.sparkSession.sparkContext.broadcast(f)  # FILTER_BYTES at the most

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for texts in batches:
            best, top, total, n = tally([t if isinstance(t, str) else None for t in texts], f)
            yield pd.DataFrame({"lang": [f.languages[b] if f.languages else UNKNOWN for b in best], "top": top, "total": total, "n": n})

    return F.pandas_udf(run, "lang string, top double, total double, n long")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def query(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    f = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), f).select("doc_id", "held_out", "lang_pred", "score")
