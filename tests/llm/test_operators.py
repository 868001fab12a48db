"""Training-data operators against brute force, and their corner cases: nulls, empty and long texts, ties, empty tables,
clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import chat, decontamination, langid, minhash, pieces, pii, pitman_yor, simhash, token_ids, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 20] + str(i % 50) for i in range(30_000))


def text(seed, n):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3)) % 20] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, text(1, 60)), (1, text(1, 60)), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "one two"), (7, "Ünïcode çafé naïve 日本 🎉 text here now"), (8, text(2, 80)), (9, text(2, 79) + " changed"), (9, text(3, 10)), (None, text(4, 30)), (12, "a.b@c.de +1 (361) 555-8283 4111111111111111 1.2.3.4")]
    rows = [(i, t, "en" if n % 2 else "de", "s", -1, 0.5, "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")


def empty(docs):
    return docs.limit(0)


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


# --- SimHash --------------------------------------------------------------------------------------------------------
def plain_print(t):
    import xxhash

    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_print(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    want = []
    for i, r in enumerate(rows):
        ids = [rows[k]["doc_id"] for k in range(len(rows)) if label[k] == label[i] and rows[k]["doc_id"] is not None]
        want.append((r["doc_id"], f"{fps[i]:016x}", min(ids) if ids else None))
    assert same(want, map(tuple, simhash.query(docs).collect()))
    assert simhash.query(empty(docs)).count() == 0


def test_simhash_links_a_chain(spark):
    values = [0, 3, 15, 63, 1 << 40 | 1 << 50 | 1 << 60]
    fps = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, fp long")
    found = {r["id"]: r["component"] for r in simhash._grouped(fps, simhash.components(simhash.links(fps))).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert {(r["a"], r["b"]) for r in simhash.links(fps, 1).collect()} == set()


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 not in ids and 0 in ids and 2 in ids and 3 not in ids


def test_keep_one_links_what_brute_force_links(spark):
    rng = np.random.default_rng(7)
    texts = []
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5):  # similarity falls from 0.93 to under 0.8
            w = list(base)
            for at in rng.choice(150, edits, replace=False):
                w[at] = f"e{rng.integers(1 << 30)}"
            texts.append(" ".join(w))
    few = [f"v{x}" for x in range(60)]
    for _ in range(60):  # one vocabulary in other orders: no copies
        texts.append(" ".join(rng.permutation(few)))
        if len(texts) % 3 == 0:
            texts.append(texts[-1] + " end")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = set(label)
    assert want <= kept  # no document goes that has no similar one
    assert len(kept - want) <= 0.03 * (len(texts) - len(want))


# --- MinHash --------------------------------------------------------------------------------------------------------
def test_minhash(docs):
    rows = {r["doc_id"]: r for r in minhash.query(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (None, 9)}
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and len(rows[0]["fingerprint"]) == 512
    assert rows[2]["fingerprint"] == rows[4]["fingerprint"] == minhash.NONE and rows[3]["near_next"] == 1.0
    order = sorted((i for i in texts if i not in (8, 12)), reverse=True)
    for i, after in zip(order, order[1:], strict=False):
        t, n = texts[i] or "", texts[after] or ""
        half = len(t) // 2
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t)
    first, last = texts[0], texts[12]
    assert rows[0]["edited_sha256"] == hashlib.sha256((first[: len(first) - len(first) // 2] + last[: len(first) // 2]).encode()).hexdigest()
    assert rows[1]["near_next"] == 1.0 and minhash.query(empty(docs)).count() == 0


def test_minhash_estimates_similarity(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(base), " ".join(base[:400 - n] + [f"x{i}" for i in range(n)])) for n in (0, 40, 120, 200, 400)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = minhash.with_fingerprint(minhash.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("n", minhash.likeness(F.col("fa"), F.col("fb")).alias("s")).collect():
        shared = max(0, 396 - r["n"])
        assert abs(r["s"] - shared / (2 * 396 - shared)) < 0.12


# --- language ID ----------------------------------------------------------------------------------------------------
def test_language_filters(spark, docs):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = langid.learn(train)
    assert langid.judge(["the garden", "der haus", None, "", "123 !!", "zzzz"], f)[0] == ["en", "de", "und", "und", "und", f.languages[f.usual]]
    assert langid.judge(["the garden"] * 3, f)[1][0] == langid.judge(["the garden"], f)[1][0]
    out = langid.predict(docs, f)
    assert out.count() == docs.count() and out.columns[-2:] == ["lang_pred", "score"] and "fp" in out.columns
    none = langid.learn(empty(train))
    assert langid.judge(["the"], none) == (["und"], [0.0]) and langid.predict(empty(docs), none).count() == 0


def bm25_leaks(texts, items):
    """{(text, item): score} of all passages and items, every pair looked at; texts and items are lists of terms."""
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = collections.Counter(t for item in items for t in set(item))
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    weight = [{t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(item) / mean)) for t, c in collections.Counter(item).items()} for item in items]
    want = {}
    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            s = 64
            while s < len(item):
                s *= 2
            k = min(5, len(item), max(2, len(item) // 3))
            own = {tuple(item[j : j + k]) for j in range(len(item) - k + 1)}
            for first in range(0, max(1, len(words)), s):
                passage = words[first : first + 2 * s]
                score = sum(v for t, v in weight[i].items() if t in passage) / sum(weight[i].values())
                held = {tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)}
                if score >= 0.5 and len(own & held) >= 0.5 * len(own):
                    want[d, i] = max(want.get((d, i), 0), score)
    return want


def test_leaks_agree_with_bm25_of_all_pairs(spark):
    import random

    draw = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [[draw.choice(vocab) for _ in range(n)] for n in (6, 9, 12, 14, 20, 33, 40, 150, 9, 12, 25, 18)] + [vocab[:20]] * 2
    texts = []
    for i in range(60):
        body = [draw.choice(vocab) for _ in range(draw.randint(0, 300))]
        for item in draw.sample(items, draw.randint(0, 2)):
            cut = draw.randint(0, len(body))
            copy = [w if draw.random() > 0.06 * (i % 4) else draw.choice(vocab) for w in item]
            body = body[:cut] + copy + body[cut:]
        texts.append(body)
    want = bm25_leaks(texts, items)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for postings in (2_000_000, 40):  # one part for each length, and several
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(docs, table, postings=postings).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and len(want) > 20


def plain_grams(t):
    fold = [c.lower() if len(c.lower()) == 1 else c for c in t]
    letters = [c if c.isalpha() else "" for c in fold]
    at = lambda i: letters[i] if 0 <= i < len(letters) else ""
    return [(at(i - 1), at(i), at(i + 1), at(i + 2) if at(i + 1) else "") for i in range(len(letters)) if letters[i]]


def test_languages_are_counted_as_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in d.collect()}
    sets = collections.defaultdict(set)
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 3 != 1 and r["lang"] is not None and r["text"]:
            sets[r["lang"]].update(plain_grams(r["text"]))
    found = {r["doc_id"]: r for r in langid.query(d).collect()}
    same_, right, held = 0, 0, 0
    for i, r in rows.items():
        grams = plain_grams(r["text"] or "")
        hits = {k: sum(g in v for g in grams) for k, v in sorted(sets.items())}
        best = max(sorted(hits), key=lambda k: hits[k]) if grams else "und"
        same_ += found[i]["lang_pred"] == best
        if found[i]["held_out"] and r["lang"] is not None and grams:
            held, right = held + 1, right + (found[i]["lang_pred"] == r["lang"])
    assert same_ >= 0.98 * len(rows) and right >= 0.97 * held, (same_, len(rows), right, held)
    assert len(found) == len(rows)


def test_filters_have_no_false_negatives():
    grams = np.arange(5000, dtype=np.uint64) * np.uint64(977)
    bits = np.zeros(1 << 14, bool)
    for at in langid._slots(grams, 3, 1 << 14):
        bits[at] = True
    assert all(bits[at].all() for at in langid._slots(grams, 3, 1 << 14))


# --- token ids ------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_ids(docs, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = sorted(token_ids.write_and_read(docs, vocabulary).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    texts = collections.defaultdict(list)
    for r in docs.collect():
        one = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        texts[r["doc_id"]].append((len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
    for r in rows:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]]
        at += r["n_tokens"]
    assert token_ids.write_and_read(empty(docs), vocabulary).count() == 0


def test_token_files_are_read_by_another_process(docs, vocabulary, tmp_path):
    import subprocess
    import sys

    folder = str(tmp_path / "tokens")
    token_ids.write(docs, vocabulary, folder)
    code = f"""
import glob
import numpy as np, pyarrow.parquet as pq
from wardstone.llm import token_ids
table = pq.read_table({folder!r} + "/table").to_pylist()[0]
coder = token_ids.Coder(np.frombuffer(table["shares"], "<u4").astype(np.int64))
last = None
for file in sorted(glob.glob({folder!r} + "/blocks/*.parquet")):
    for row in pq.read_table(file).to_pylist():
        assert sum(row["lengths"]) == len(coder.decode(row["block"]))
        for x in row["doc_ids"]:
            assert last is None or x >= last
            last = x
print("read", last)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "read 12" in done.stdout, done.stderr
    with pytest.raises(Exception, match="table"):
        row = docs.sparkSession.read.parquet(folder + "/blocks").first()
        token_ids.Coder(token_ids.shares(np.arange(500))).decode(row["block"])


FAR = {"ends": [-(2**63), 2**63 - 1, 5], "two": [0, 10**17], "outlier": [*range(60), 10**15], "equal": [7] * 40}


@pytest.mark.parametrize("ids", FAR.values(), ids=FAR)
def test_far_apart_ids(spark, vocabulary, ids):
    d = spark.createDataFrame([(i, text(n, 8 + n % 5)) for n, i in enumerate(ids)], "doc_id long, text string")
    found = {}
    for r in minhash.with_next(d, "doc_id", ["text"], lambda df: df, rows=4).collect():
        found.setdefault(r["doc_id"], set()).add(r["next_text"])
    order = sorted(set(ids), reverse=True)
    texts = {i: {r["text"] for r in d.where(F.col("doc_id") == i).collect()} for i in order}
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        assert found[i] <= texts[after] | texts[i] and (found[i] <= texts[after] or ids.count(i) > 1)
    rows = sorted(token_ids.write_and_read(d, vocabulary).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids)
    assert pitman_yor.query(d).count() == len(ids)


def test_encoder_equals_library_on_single_characters(vocabulary):
    e = token_ids.Encoder(vocabulary)
    for c in [*range(0x250), 0x1680, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x300]:
        for t in (f"a{chr(c)}b", f"a {chr(c)} b", chr(c), f"don{chr(c)}t 12{chr(c)}3"):
            assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.whole.encode(t, add_special_tokens=False).ids, (c, t)


@pytest.mark.parametrize("t", ["l'été's can't 'there 12³ ½ naïve_x", "İstanbul ΣΑΣ é <|endoftext|>a <|x", "x\x1cy z", "", "\u0085a\u200bb", "Word. word, WORD! a.b"])
def test_encoder_equals_library(vocabulary, t):
    e = token_ids.Encoder(vocabulary)
    assert np.frombuffer(e.ids(t), e.dtype).tolist() == e.whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 31, 1000, 300_000])
def test_coder(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 500).astype(np.uint16)
    coder = token_ids.Coder(token_ids.shares(np.bincount(ids, minlength=500)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    if n > 100_000:
        parts = [coder.decode(block, k, 1) for k in range(-(-n // (token_ids.LANES * token_ids.STEPS)))]
        assert (np.concatenate(parts) == ids).all()
        damaged = bytearray(block)
        damaged[-5] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            coder.decode(bytes(damaged))


# --- decontamination ------------------------------------------------------------------------------------------------
def test_leaks(spark, docs):
    item = lambda k, n: " ".join(f"q{k}x{i}" for i in range(n))
    items = spark.createDataFrame([(1, item(1, 40)), (2, item(2, 30)), (3, item(1, 40)), (4, None), (5, "")], "item_id long, text string")
    hold = spark.createDataFrame([(100, LONG + " " + item(1, 40).upper() + ". " + LONG), (101, item(2, 12)), (102, "x " + item(2, 30))], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(hold)
    want = {(100, 1), (100, 3), (102, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(both, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(both, items, postings=20).collect()} == want
    kept = decontamination.without_leaks(docs, items)
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert decontamination.leaks(empty(docs), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_leaks_finds_near_copies(spark):
    """Copies with one edit at every place, and quotes without their last quarter."""
    rows, items = [], []
    for k, n in enumerate((5, 6, 9, 12, 14, 15, 20, 23, 24, 37, 59)):
        item = [f"q{k}x{i}" for i in range(n)]
        items.append((k, " ".join(item)))
        near = [[*item[:i], "edited", *item[i + 1 :]] for i in range(n)] + [item[:i] + item[i + 1 :] for i in range(n)] + [[*item[:i], "added", *item[i:]] for i in range(n)]
        if n >= 9:
            near.append(item[: n - n // 4])
        rows += [(k * 1000 + i, "before it " + " ".join(w) + " and after it") for i, w in enumerate(near)]
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i // 1000) for i, _ in rows}


# --- personal data --------------------------------------------------------------------------------------------------
def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def n_digits(s):
    return sum(c.isdigit() for c in s)


PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= n_digits(s) <= 19 and luhn(s)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= n_digits(s) <= 15),
]


def test_personal_data(spark, docs):
    more = ["a.b@c.d%e@f.g and x@y", "4111 1111-1111 1111 1.2.3.4.5.6.7.8 256.1.1.1 00255.1.2.003", "1" * 3000 + "@" * 50, "+" * 20 + "+1 2345678", "é 👍 q.r@s.t é 5 5-5 4111111111111111-", " 12--4111111111111111", 'token = "abcdef12345" call (361) 555-8283 now, john (at) example (dot) com']
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = []
    for r in rows.collect():
        spans, counts = [], []
        for kind, p, ok in PLAIN:
            found = [f"{kind}:{m.start()}:{m.end()}" for m in p.finditer(r["text"] or "") if ok(m.group())]
            counts.append(len(found))
            spans += found
        want.append((r["doc_id"], *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    got = pii.query(rows).collect()
    assert same(want, [tuple(r)[:6] for r in got])
    assert next(r["spans"] for r in got if r["doc_id"] == 1006).count(":") >= 2
    assert pii.query(empty(docs)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs, pii.train(pii.candidates(docs))).collect()}
    assert masked[12] == "<email> <phone> <card> <ip>" or "a.b@c.de" not in masked[12]
    assert masked[2] is None and masked[0] == text(1, 60)


# --- URL filter -----------------------------------------------------------------------------------------------------
def test_added_spans(spark):
    texts = ["call 555-123-4567 today", "mail a.b (at) example (dot) com or x.y@example.com", "ssn 123-45-6789, no ssn here", 'token = "abc123def456"', "section 555-123-4567-9", "a.b@c.de phone +1 555 123 4567"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.query(d).collect()}
    found = [[(k, texts[i][int(a) : int(b)]) for k, a, b in (s.split(":") for s in rows[i].split(",") if s)] for i in range(len(texts))]
    assert found[0] == [("phone", "555-123-4567")] and found[2] == [("ssn", "123-45-6789")]
    assert found[1] == [("email", "a.b (at) example (dot) com"), ("email", "x.y@example.com")]
    assert found[3][0][0] == "secret" and found[4] == []
    assert found[5] == [("email", "a.b@c.de"), ("phone", "+1 555 123 4567")]


def test_reliabilities_are_found_by_expectation_maximisation():
    import random

    draw, counts = random.Random(4), collections.Counter()
    for _ in range(20_000):
        real = draw.random() < 0.6
        votes = ""
        for yes, no in ((0.95, 0.1), (0.8, 0.05), (0.7, 0.3), (0.6, 0.2)):
            votes += "0" if draw.random() < 0.2 else "+" if draw.random() < (yes if real else no) else "-"
        counts[0, votes] += 1
    model, real = pii._estimate(dict(counts), rounds=300)
    assert abs(model.prior[0] - 0.6) < 0.05
    for name, (yes, no) in zip(pii.LABELERS, ((0.95, 0.1), (0.8, 0.05), (0.7, 0.3), (0.6, 0.2)), strict=True):
        assert abs(model.worth[name, "+"][0] - yes) < 0.06 and abs(model.worth[name, "+"][1] - no) < 0.06, name
    for (kind, votes), p in real.items():  # the posterior is Bayes' rule
        odds = model.prior[kind] / (1 - model.prior[kind])
        for name, v in zip(pii.LABELERS, votes, strict=True):
            odds *= model.worth[name, v][0] / model.worth[name, v][1] if v != "0" else 1
        assert abs(p - odds / (1 + odds)) < 0.02


def test_many_spans_in_one_text(spark):
    n = 3000
    d = spark.createDataFrame([(1, "é me@x.com " * n), (2, "a@b.c " * 65 + "end"), (3, "no")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in pii.query(d).collect()}
    assert r[1]["n_email"] == n and r[1]["spans"].endswith(f"email:{11 * n - 9}:{11 * n - 1}")
    m = {x["doc_id"]: x["text"] for x in pii.masked(d, pii.train(pii.candidates(d))).collect()}
    assert m == {1: "é <email> " * n, 2: "<email> " * 65 + "end", 3: "no"}


def test_running(spark):
    rows = [(list(range(k)),) for k in (0, 1, 255, 256, 257, 1000)]
    out = spark.createDataFrame(rows, "v array<int>").select("v", pii.running(F.col("v"), 0, lambda a, b: a + b).alias("s")).collect()
    assert all(r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))] for r in out)


def test_long_hosts_and_repeated_pages(spark):
    long = "http://" + "a." * 100_000 + "org/es/x"
    pages = spark.createDataFrame([(None, "http://x.com/en/"), (1, long), (1, long), (2, None), (2, "http://" + "b" * 300_000), (3, "x:///p")], "page_id long, url string")
    rows = [(r["page_id"], r["path"], r["rule"], r["verdict"]) for r in url_filter.query(pages).collect()]
    assert sorted(rows, key=str) == sorted([(None, "/en/", "com/en/", "block"), (1, "/es/x", "org/es/", "block"), (1, "/es/x", "org/es/", "block"), (2, "", None, "allow"), (2, "", None, "allow"), (3, "/p", None, "allow")], key=str)


def test_urls(spark):
    urls = ["https://A.Example.com/en/7x?q", "http://x.net/de/81", "http://example.net/de/8#f", "http://b.org/fr/", "ftp://h.io/p", None, "no scheme", "http://notcom/en/", "http://h.io/p?z=1", "x://"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    listed = spark.createDataFrame([("h.io/p",), ("h.io/p",)], "canonical string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES, listed).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("x.net", "/de/81", "net/de/", "allow") and got[2] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[3][2:] == (None, "allow") and got[4][2:] == got[8][2:] == (None, "block")
    assert got[5] == got[6] == got[9] == ("", "", None, "allow") and got[7][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0), [], listed.limit(0)).count() == 0


# --- chat -----------------------------------------------------------------------------------------------------------
def cheapest(roles):
    best = 1 << 30

    def go(i, s, c):
        nonlocal best
        if c >= best:
            return
        if i == len(roles):
            best = min(best, c + chat.ENDS[s][0])
            return
        if s:
            go(i + 1, s, c + (1 if s == roles[i] else 4))
        for new in (1, 2, 3):
            k = 0 if new == roles[i] else 3
            if chat._after(s, new):
                go(i + 1, new, c + k)
            for e in (2, 3):
                if chat._after(s, e) and chat._after(e, new):
                    go(i + 1, new, c + k + 2)

    go(0, 0, 0)
    return best


def test_chat(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(25):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((conv, turn, [None, "system", " User", "assistant"][int(rng.integers(4))], None if turn == 3 else f"t{turn}", "x"))
    rows += [(None, None, "user", "a", "x"), (None, None, "user", "a", "x")] + [(99, t, ("user", "assistant")[t % 2], f"m{t}", "x") for t in range(2000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    out = chat.query(turns).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["conv_id"]].append(r)
    for conv, rs in by.items():
        rs.sort(key=lambda r: r["position"])
        roles = [chat.role_number(r["role"]) for r in rs]
        if len(rs) < 8:
            assert sum(r["cost"] for r in rs) == cheapest(roles)
        seq = "".join(x[0] for x in re.findall(r"<\|(system|user|assistant)\|>\n", "".join(r["rendered"] for r in rs)))
        assert re.fullmatch("s?(ua)+", seq), (conv, seq)
    assert sum(r["cost"] for r in by[99]) == 0 and chat.query(turns.limit(0)).count() == 0
    monkeypatch.setattr(chat, "GROUP", 1)  # groups of two chunks
    small = collections.defaultdict(list)
    for r in chat.query(turns).collect():
        small[r["conv_id"]].append(r)
    for conv, rs in small.items():
        rs.sort(key=lambda r: r["position"])
        assert [r["position"] for r in rs] == list(range(len(rs)))
        if len(rs) < 8:
            assert sum(r["cost"] for r in rs) == cheapest([chat.role_number(r["role"]) for r in rs])
        seq = "".join(x[0] for x in re.findall(r"<\|(system|user|assistant)\|>\n", "".join(r["rendered"] for r in rs)))
        assert re.fullmatch("s?(ua)+", seq), (conv, seq)


def test_very_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y" * 3_000_000), (1, 2, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.query(turns).collect(), key=lambda r: r["position"])
    assert [r["action"] for r in rows] == ["keep", "keep", "merge"] and sum(len(r["rendered"]) for r in rows) > 6_000_000


# --- pieces ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.model_path())


def ways(s, lat):
    if not s:
        return [((), 0.0)]
    out = []
    for j in range(1, len(s) + 1):
        if (k := lat.vocab.get(s[:j])) is not None:
            out += [((k, *p), lat.weight[k] + w) for p, w in ways(s[j:], lat)]
    return out


def test_samples_follow_the_model(lattices):
    t, n = pieces.normalised("hetis"), 8000
    found = pieces.sample([t] * n, pieces._mix(np.arange(n, dtype=np.uint64)), 3, lattices)
    all_ways = ways(t, lattices)
    z = np.logaddexp.reduce([w for _, w in all_ways])
    p = {k: math.exp(w - z) for k, w in all_ways}
    first = collections.Counter(tuple(x[0][0].tolist()) for x in found)
    assert all(abs(first[k] / n - v) < 0.02 for k, v in p.items())
    assert all(len({tuple(y[0].tolist()) for y in x}) == len(x) for x in found)
    assert all(abs(y[1] - math.log(p[tuple(y[0].tolist())])) < 1e-9 for x in found[:100] for y in x)
    assert abs(np.mean([sum(math.exp(y[1] - y[3]) for y in x) for x in found]) - 1) < 0.02


def test_segmentations(spark, docs, lattices):
    path = pieces.model_path()
    rows = pieces.segmentations(docs, path, digest=True).collect()
    assert all(r["restored"] for r in rows)
    count = collections.Counter(r["doc_id"] for r in rows)
    assert count[0] == 2 and count[2] == count[3] == 1 and count[5] == 2 and count[9] == 4
    full = {(r["doc_id"], r["sample"]): r["ids"] for r in pieces.segmentations(docs.where("doc_id = 7"), path).collect()}
    assert pieces.decoded(np.array(full[7, 1]), lattices) == "Ünïcode çafé naïve 日本 🎉 text here now"
    assert pieces.segmentations(empty(docs), path).count() == 0
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text"), path).drop("text"), path)
    assert {r["text"] for r in back.collect() if r["doc_id"] == 7} == {"Ünïcode çafé naïve 日本 🎉 text here now"}
    alone = {r["ids_crc32"] for r in pieces.segmentations(docs.where("doc_id = 0"), path, digest=True).collect()}
    assert alone == {r["ids_crc32"] for r in rows if r["doc_id"] == 0}  # draws don't depend on the rest of the data


# --- language model -------------------------------------------------------------------------------------------------
def plain_tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def base_rows(docs):
    count = collections.Counter()
    for r in docs.collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            count.update(plain_tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    want = []
    for r in docs.collect():
        w = plain_tokens(r["text"])
        want.append((r["doc_id"], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)))
    return want


@pytest.mark.parametrize("shard_bytes", [1 << 24, 30_000])
def test_pitman_yor(docs, shard_bytes):
    rows = pitman_yor.scores(docs, ~pitman_yor.held_out(), shard_bytes=shard_bytes).collect()
    assert same(base_rows(docs), [(r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows])
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    assert pitman_yor.query(empty(docs)).count() == 0
    assert pitman_yor.query(docs.where("doc_id = 0")).count() == 1


def test_tokens_are_words_and_ends():
    import pyarrow as pa

    texts = ["A b\x0bA", None, "", " \n ", "b", "x" * 3_000_000 + " a", "\u00c4 \u00e4"]
    hashes, size = pitman_yor.tokens(pa.array(["left out", *texts]).slice(1))
    words = [w for t in texts for w in plain_tokens(t)]
    assert size.tolist() == [len(plain_tokens(t)) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


def seated_one_by_one(train, ask, lower, upper, sweeps, burn_in):
    """Chinese restaurants with explicit tables: every customer leaves and sits down again, given all others."""
    import random

    draw = random.Random(3)
    words = {w for text in train for w in text}
    base = 1 / (len(words) + 1)
    own, parent = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(list)
    total = lambda r: (sum(map(sum, r.values())), sum(map(len, r.values())))

    def p1(w):
        n, t = total(parent)
        return (sum(parent[w]) - upper * len(parent[w]) + (1 + upper * t) * base) / (1 + n)

    def p2(u, w):
        n, t = total(own[u])
        return (sum(own[u][w]) - lower * len(own[u][w]) + (1 + lower * t) * p1(w)) / (1 + n)

    def sit(tables, discount, weight):
        at = draw.choices(range(len(tables) + 1), [*(x - discount for x in tables), weight])[0]
        if at < len(tables):
            tables[at] += 1
            return False
        tables.append(1)
        return True

    def leave(tables):
        at = draw.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    customers = [(u, w) for text in train for u, w in zip([b"", *text], text, strict=False)]
    enter = lambda u, w: sit(own[u][w], lower, (1 + lower * total(own[u])[1]) * p1(w)) and sit(parent[w], upper, (1 + upper * total(parent)[1]) * base)
    for u, w in customers:
        enter(u, w)
    out = collections.Counter()
    for i in range(sweeps):
        for u, w in customers:
            if leave(own[u][w]):
                leave(parent[w])
            enter(u, w)
        if i >= burn_in:
            for u, w in ask:
                out[u, w] += p2(u, w) / (sweeps - burn_in)
    return out


def test_scores_agree_with_customers_seated_one_by_one(spark):
    texts = ["a b a c a b", "a b b", "c a b a b", "b c", "a b c a", "d a b", "a a a b a b"]
    d = spark.createDataFrame(list(enumerate([*texts, "a b e a d", "e e"])), "doc_id long, text string")
    rows = pitman_yor.scores(d, F.col("doc_id") < len(texts), burn_in=20, kept=400).orderBy("id").collect()
    train = [plain_tokens(t) for t in texts]
    count = collections.Counter((u, w) for t in train for u, w in zip([b"", *t], t, strict=False))
    followed = collections.Counter(w for _, w in count)
    rate = lambda c: min(0.95, max(0.05, (c.count(1)) / max(1, c.count(1) + 2 * c.count(2))))
    all_pairs = [list(zip([b"", *w], w, strict=False)) for w in map(plain_tokens, [r["text"] for r in d.orderBy("doc_id").collect()])]
    p = seated_one_by_one(train, {x for t in all_pairs for x in t}, rate(list(count.values())), rate(list(followed.values())), 5000, 500)
    for r, pairs in zip(rows, all_pairs, strict=True):
        want = sum(math.log10(p[x]) for x in pairs)
        assert abs(r["score"] - want) < 0.03 * abs(want), (r, want)
    words = sorted({w for t in train for w in t} - {b""})
    asked = spark.createDataFrame([(i, w) for i, w in enumerate([*texts, *[f"a {w.decode()}" for w in words], "a e", "a"])], "doc_id long, text string")
    found = pitman_yor.scores(asked, F.col("doc_id") < len(texts)).where(F.col("id") >= len(texts)).collect()
    assert all(math.isfinite(r["score"]) for r in found)


def test_tables_follow_their_conditional():
    rng = np.random.default_rng(5)
    for c in (2, 3, 6):
        drawn = pitman_yor.draw_tables(np.full(40_000, c), lambda at, j: np.full(np.broadcast_shapes(at.shape, j.shape), 0.7), 0.4, rng)
        weight = np.exp(pitman_yor.stirling(0.4)[c, 1 : c + 1]) * 0.7 ** np.arange(c)
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 40_000 - weight / weight.sum()).max() < 0.01


def test_held_out_words_cost_less_than_under_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = pitman_yor.query(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
