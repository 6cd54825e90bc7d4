"""Searches: exact nearest vectors and texts, whatever the blocks and partitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import search
from strandline.plans import retrieval


@pytest.mark.parametrize("block", [2, 2000])
def test_nearest_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(200, None), (201, [0.0] * 4), (None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)
    got = {}
    for r in search.nearest(vectors, vectors.where("id % 20 = 0 or id = 201"), 7, block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.sim)
    usable = {i: np.array(v) for i, v in rows if i is not None and v is not None and any(v)}
    want = {}
    for q in (i for i in usable if i % 20 == 0):
        sims = [(-round(float(np.clip(usable[q] @ v / np.linalg.norm(usable[q]) / np.linalg.norm(v), 0, 1)), 6), i) for i, v in usable.items() if i != q]
        want[q] = {k: (i, -s + 0.0) for k, (s, i) in enumerate(sorted(sims)[:7], 1)}
    assert got == want
    assert search.nearest(vectors.limit(0), vectors.limit(0)).isEmpty()


def test_text_search(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "patrol ships left"), (2, "patrol"), (3, "a tax law"), (4, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "patrol ships"), (3, "..."), (9, "Patrol")], "query_id bigint, text string")
    rows = retrieval.text_search(docs, asked).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in rows] == [(1, 2), (9, 2), (9, 1)]
    monkeypatch.setattr(search, "BLOCK", 1)
    assert retrieval.text_search(docs, asked).count() == 3 and retrieval.text_search(docs.limit(0), asked).where(F.lit(True)).isEmpty()


def searched(docs, queries, k):
    """Brute force over chunks that are lines of plain words."""
    chunks = [(d, line.lower().split()) for d, text in docs for line in text.split("\n") if line]
    mean = sum(len(w) for _, w in chunks) / len(chunks)
    out = {}
    for q, text in queries:
        best = {}
        for d, words in chunks:
            score = 0.0
            for t in {t for t in text.lower().split() if t in words}:
                df, n = sum(t in w for _, w in chunks), words.count(t)
                score += math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if score and d != q:
                best[d] = max(best.get(d, 0), round(score, 6))
        out |= {(q, r): (d, s) for r, (d, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "cells", "common"), [(2000, 2_000_000, 0.004), (5, 40, 0.0), (7, 1, 2.0)])
def test_text_search_against_brute_force(spark, monkeypatch, block, cells, common):
    rng, words = random.Random(3), ["the", "of", *(f"w{c}" for c in "abcdefghijkl")]
    line = lambda: " ".join(rng.choices(words, [9, 6, *range(12, 0, -1)], k=rng.randint(1, 7)))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 4)))) for i in range(80)]
    queries = [(i, line()) for i in range(0, 100, 6)]
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "CELLS", cells)
    rows = retrieval.text_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(queries, "query_id bigint, text string"), 4, block).collect()
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in rows} == searched(docs, queries, 4)


def test_text_search_shuffles_no_matches(spark):
    docs = spark.range(0, 3000, 1, 2).selectExpr("id AS doc_id", "concat('the harbor ', id % 7) AS text")
    asked = spark.range(40).selectExpr("id AS query_id", "'the harbor' AS text")
    store = lambda: spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    size = lambda x: {x.apply(i).stageId(): x.apply(i).shuffleWriteRecords() for i in range(x.size())}
    before = size(store())
    assert retrieval.text_search(docs, asked, 10).count() == 400
    assert sum(n for k, n in size(store()).items() if k not in before) < 4000  # of 120,000 matches
