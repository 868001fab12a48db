"""Lexical search, structure repair and token counts against brute force, and their corner cases."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wardstone.llm import lexical, structure, token_counts

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


# --- ranked lexical search --------------------------------------------------------------------------------------------
def plain_terms(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold)


def plain_search(docs, items, most=10):
    """[(item, rank, doc, score)] of all pairs; docs and items are lists of (id, text)."""
    terms = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in terms)
    total = sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(plain_terms(t))
    out = []
    for item, own in wanted.items():
        rows = []
        for doc, c in terms:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score:
                rows.append((score, doc))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k + 1, doc, score) for k, (score, doc) in enumerate(rows[:most])]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    vocab = ["the", "Ünï", "a1", "b", "日本", "Ab", "café", *[f"w{i}" for i in range(40)]]
    marks = [" ", "-", ",", "\n", "\x7f", "\x00", "_"]
    docs = [(i, "".join(draw.choice(vocab) + draw.choice(marks) * draw.randint(1, 2) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, "the"), (900, None), (901, ""), (902, " ,.- "), (903, "the " * 5), (904, "thethe theb xthe"), (905, " ".join(f"w{i % 50}" for i in range(250_000)))]
    items = [(i, " ".join(draw.choice(vocab) for _ in range(draw.randint(1, 12)))) for i in range(30)] + [(3, "w1 w2"), (None, "the a1"), (50, None), (51, ""), (52, "nowhere at_all"), (53, "THE the The")]
    return docs, items


@pytest.mark.parametrize("chars", [lexical.PART_CHARS, 60])
def test_search_equals_all_pairs(spark, corpus, chars):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, rank string, score double").repartition(3)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in lexical.search(d, b, chars=chars).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_search(docs, items)))
    assert lexical.query(d, b).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_without_rows(spark, corpus):
    docs, items = corpus
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.query(d.limit(0), b).count() == 0 and lexical.query(d, b.limit(0)).count() == 0
    assert lexical.query(d.where("text is null"), b).count() == 0


def test_scanner_cuts_long_texts_at_blanks(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 7)
    n, found = lexical.Scanner(["abc", "bc", "a"])("Abc bc,abc abcabc a bc " + "a" * 30 + " abc")
    assert n == 8 and found == {0: 3, 1: 2, 2: 1}


def test_best_keeps_ties_of_smaller_ids():
    import numpy as np

    best = lexical.Best(1, 2)
    for ids in ([5, 9], [7, 1], [3, 8]):
        best.add(np.array([[4], [4]]), np.zeros(2, np.int64), np.array(ids))
        best.settle()
    assert best.settle()[3].tolist() == [1, 3]


# --- structure repair -------------------------------------------------------------------------------------------------
def plain_repair(rows):
    """The contract's row of one conversation, by trying every edit; rows are (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    legal_end = ("", "a")

    def follows(state, c):
        return c == "s" and state == "" or c == "u" and state in ("", "s", "a") or c == "a" and state == "u"

    @functools.cache
    def best(i, state, inserted):
        """(cost, audit, repaired turns) from here on; ``inserted`` bounds insertions in a row."""
        found = []
        if i == len(rows) and state in legal_end:
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if follows(state, role[0]):
                    c, a, t = best(i, role[0], inserted + 1)
                    found.append((c + 3, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if follows(state, new[:1]):
                        c, a, t = best(i + 1, new[0], 0)
                        found.append((c + price + extra, edit + a, (f"{new}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit, turns = best(0, "", 0)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(key.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def ordered(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in by.items()}


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "usher", None]
    texts = ["Yes.", "No!", "What now", "", " \t ", "Well?", "a. b", None, "fine.\n", "ünï. "]
    rows = []
    for conv in [None, *range(120)]:
        for k in range(draw.randint(1, 9)):
            turn = draw.choice([k, k, k, k + 1, None])
            rows.append((conv, turn, draw.choice(roles[: draw.choice([4, 9])]), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.randint(0, 99)}."))
    rows += [(500, k, roles[k % 2], "again." if k % 3 else f"n{k}.") for k in range(40)]  # longer than a chunk in the test below
    return rows


@pytest.mark.parametrize("turns", [structure.CHUNK_TURNS, 3])
def test_repair_equals_all_edits(spark, talks, turns, monkeypatch):
    monkeypatch.setattr(structure, "CHUNK_TURNS", turns)
    df = spark.createDataFrame([(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, cost int, audit string")
    damaged = ordered(plain_damage(talks))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = [(c, *(plain_repair(damaged[c]) if c in damaged else nothing)) for c in {r[0] for r in talks}]
    got = [tuple(r) for r in structure.query(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_edits_are_the_audit(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    found = structure.repaired(df)
    rows = collections.defaultdict(list)
    for r in structure.edits(found).orderBy("place").collect():
        rows[r["conv_id"]].append(r)
    for r in structure.summary(found).collect():
        mine = rows[r["conv_id"]]
        assert "".join(e["edit"] for e in mine) == r["audit"]
        kept = [f"{e['role']}:{e['text']}" for e in mine if e["edit"] != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][:1] for e in mine if e["edit"] != "D"))
    assert structure.query(df.limit(0)).count() == 0


def test_ranks_order_all_audits():
    import numpy as np

    kinds, faults = np.array([2, 2, 0, 3, 1, 3, 2]), np.array([0, 3, 0, 0, 1, 2, 3])
    ways = structure.Ways([(kinds, faults, structure.END_COSTS)])
    audits = []
    for arc in range(len(ways.label)):
        out, at = "", arc
        while ways.label[at]:
            out += structure.LABELS[ways.label[at]]
            at = ways.first[ways.target[at]]
        audits.append(out)
    assert [int(x) for x in ways.rank] == [sorted(set(audits)).index(a) for a in audits]


# --- token counts -----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


TEXTS = [None, "", " ", "a b  c\n\n d", "I'll don't 'S 12³ ½", "<|endoftext|>", "x <|endoftext|><|endoftext|> y <|endoftext", "日本語 テキスト ｶﾅ", "🎉🎉 ok ‍﻿", "\x00\x1c\x1d\x85  z", "naïve café été́", "۱۲۳ १२ ก็", "a" * 5000, " " * 3000, "word " * 40_000, "՘ ꟎ 𐥀x"]


@pytest.mark.parametrize("chars", [token_counts.BLOCK_CHARS, 50])
def test_token_counts_equal_the_library(spark, vocabulary, chars):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    rows = [(i if i % 5 else None if i else 0, t, 7, "x") for i, t in enumerate([*TEXTS, *TEXTS])]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, block string").repartition(3)
    want = [(i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows]
    got = [tuple(r) for r in token_counts.token_counts(d, vocabulary, chars=chars).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    q = token_counts.query(d)
    assert q.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and q.where(F.col("over_limit") != (F.col("n_tokens") > 1024)).count() == 0
    assert token_counts.query(d.limit(0)).count() == 0


def test_splitter_equals_the_library_on_every_plain_character(vocabulary):
    from tokenizers import Tokenizer

    whole, s = Tokenizer.from_file(vocabulary), token_counts.splitter(vocabulary)
    for a, b in token_counts.PLAIN:
        texts = [f"a{c}b  {c} 1{c}2 .{c}. <|endoftext|>{c}{c}'s " for c in map(chr, range(a, b + 1))]
        for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
            words, specials = s.words(t)
            assert not s.other(t) and sum(map(s.pieces, words)) + specials == len(e.ids), t


def test_frequencies_are_packed_and_unpacked():
    import numpy as np

    numbers = [np.array(x, np.uint32) for x in ([0, 3, 70_000], [], [1], [0, 2**31])]
    times = [np.array(x, np.uint32) for x in ([1, 2, 3], [], [4], [1 << 20, 1])]
    sizes = np.array([3, 0, 1, 2])
    n, t = token_counts.unpacked(token_counts.packed(numbers, times), sizes)
    assert n.tolist() == [0, 3, 70_000, 1, 0, 2**31] and t.tolist() == [1, 2, 3, 4, 1 << 20, 1]
    assert token_counts.unpacked(token_counts.packed([numbers[1]] * 2, [times[1]] * 2), np.array([0, 0]))[0].size == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Splitter(public_tokenizers.path("word_bpe_49k.json"))
