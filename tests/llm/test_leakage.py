"""Leakage: blocks of items, proximity, short items, against brute force on random texts."""

from __future__ import annotations

import random

import numpy as np

from strandline.llm import p9_leakage as p9

WORDS = "harbor patrol ship north anchor signal crew tide storm buoy pilot chart radio beacon vessel".split()


def say(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def longest_common(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
        row, best = new, max(best, *new)
    return best


def bare(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def found(spark, docs, items, **kw):
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    return p9.leaks(corpus, spark.createDataFrame(items, "item_id bigint, text string"), **kw).collect()


def test_every_half_is_found_whatever_the_size_and_the_blocks(spark):
    rng = random.Random(5)
    items = [(i, say(rng, rng.choice([1, 2, 3, 5, 9, 20]))) for i in range(12)] + [(90, "ab"), (91, "7"), (92, "..."), (93, None)]
    docs = []
    for d in range(40):
        text = bare(rng.choice(items[:12])[1])
        size = rng.randint(max(1, len(text) // 2 - 2), len(text))
        at = rng.randint(0, len(text) - size)
        docs.append((d, say(rng, 6) + " " + text[at : at + size] + " " + say(rng, 3)))
    docs += [(98, None), (99, "")]
    true = {(d, i) for d, t in docs for i, x in items if t and x and bare(x) and 2 * longest_common(bare(t), bare(x)) >= len(bare(x))}
    for chars in (p9.BLOCK_CHARS, 60):
        rows = found(spark, docs, items, block_chars=chars)
        assert {(r.doc_id, r.item_id) for r in rows if r.kind != "near"} == true
        assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
        for r in rows:
            doc, item = bare(dict(docs)[r.doc_id]), bare(dict(items)[r.item_id])
            if r.kind != "near":
                assert r.common == longest_common(doc, item) and doc[r.doc_at : r.doc_at + r.common] == item[r.item_at : r.item_at + r.common]


def test_stretches_in_proximity(spark):
    rng = random.Random(6)
    words = [rng.choice(WORDS) + str(i) for i in range(60)]
    item = " ".join(words)
    near = " ".join(w if i % 20 != 10 else "changed" for i, w in enumerate(words))  # 19 words at a time, the longest a third
    far = "  ".join(" ".join(words[a : a + 19]) + say(rng, 200) for a in (0, 40))
    got = {r.doc_id: r.kind for r in found(spark, [(1, "Before. " + near + " After."), (2, far), (3, item)], [(1, item)])}
    assert got == {1: "near", 3: "exact"}


def test_ten_thousand_items_are_indexed_fast():
    rng = np.random.default_rng(1)
    items = [rng.integers(97, 123, 300).astype(np.uint32) for _ in range(10_000)]
    (places,) = p9._places(items)
    anchors = p9._anchors(places, items, rng.integers(0, 9, len(places.terms.hashes)))
    block, need = p9.blocks_of(300, 16)
    assert need >= 2 and len(anchors.item) == 10_000 * -(-(300 - 15) // block)


def test_repeated_rows_and_tables_without_rows(spark):
    text = say(random.Random(7), 30)
    assert len(found(spark, [(1, text), (1, text), (1, "other")], [(1, text), (1, text), (1, text[:80])])) == 1
    assert found(spark, [], [(1, text)]) == [] and found(spark, [(1, text)], []) == []
