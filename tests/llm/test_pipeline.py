"""The pipeline keeps clean documents and drops or repairs the others."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import bm25_leaks
from wardstone.llm import decontamination, pieces

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_stages_keep_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(20), DIR).columns == docs.columns, name


def test_run(spark, docs):
    out = corpus_pipeline.run(spark, DIR)
    n, distinct = docs.count(), docs.select("text").distinct().count()
    assert 0.7 * n < out.count() <= distinct
    assert out.where(F.size("ids") == 0).count() == 0


def test_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_piece_ids_keeps_both_samples(spark, docs):
    some = docs.where("n_chars > 20").limit(10)
    want = {}
    for r in pieces.segmentations(some, pieces.model_path()).orderBy("sample").collect():
        want.setdefault(r["doc_id"], []).append(r["ids"])
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.piece_ids(spark, some, DIR).collect()}
    assert got == want and all(len(x) == 2 for x in got.values())


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_run_keeps_what_brute_force_keeps(spark, docs):
    """Languages by letters, groups by the similarity of all pairs, leaks by the scores of all pairs, masks by what is left."""
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    label, sets, unsure = {i: i for i in kept}, {i: shingles(t) for i, t in kept.items()}, set()
    ids = sorted(kept)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            both = len(x & y)
            like = both / len(x | y) if x or y else 1
            if 0.8 <= like < 0.86:  # where the candidate search may miss a pair
                unsure |= {i, j}
            if like >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    items = [decontamination.terms(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").collect()]
    ids = sorted(kept)
    leaks = {ids[d] for d, _ in bm25_leaks([decontamination.terms(kept[i]) for i in ids], items)}
    want = set(kept) - leaks
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(out) - unsure == want - unsure and len(want) > 100
    lat = pieces.lattices(pieces.model_path())
    for i, r in out.items():
        import numpy as np

        texts = {pieces.decoded(np.array(x), lat) for x in r["ids"]}
        assert len(texts) == 1 and len(r["ids"]) == 2
        text = texts.pop()
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
        if not re.search(r"[0-9@]|(?i:\bat\b|token|passw|secret|key)", rows[i]):
            assert text == rows[i]
