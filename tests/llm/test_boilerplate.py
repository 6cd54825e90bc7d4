"""Boilerplate: runs inside longer lines, lines longer than any window, counts added over blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import p7_boilerplate as p7

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(LETTERS) for _ in range(7))


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


def lines_of(spark, pages: dict[str, tuple[str, str | None]]):
    docs = spark.createDataFrame([(d, t, r, None) for d, (t, r) in pages.items()], "doc_id string, text string, raw_content string, title string")
    names = spark.createDataFrame([(d, "Host") for d in pages], "doc_id string, source_name string")
    return p7.page_lines(docs, names)


def test_suffix_array_matches_sorting():
    rng = random.Random(2)
    for n in (1, 2, 3, 60):
        ids = p7.np.array([rng.randint(0, 3) for _ in range(n)])
        order, common = p7.suffix_array(ids)
        plain = sorted(range(n), key=lambda i: list(ids[i:]))
        assert list(order) == plain
        for r in range(1, n):
            a, b = list(ids[order[r - 1] :]), list(ids[order[r] :])
            assert common[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for times in (2, 3, 5):
            far = p7.repeats(order, common, times)
            for i in range(n):
                count = lambda k: sum(list(ids[j : j + k]) == list(ids[i : i + k]) for j in range(n - k + 1))  # noqa: E731, B023
                assert far[i] == max((k for k in range(1, n - i + 1) if count(k) >= times), default=0)


def test_a_run_inside_longer_lines_is_boilerplate(spark):
    rng = random.Random(3)
    prompt = "join the many readers who get our letter from the harbor each and every working day"
    pages = {}
    for i in range(40):
        body = [sentence(rng, 30) + ".", sentence(rng, 30) + "."]
        lead = sentence(rng, 3)
        pages[f"d{i}"] = ("\n".join(body), "\n".join(["# " + sentence(rng, 6), *body[:1], f"{lead}, {prompt}", *body[1:], "Terms of use"]))
    got = lines_of(spark, pages).where("field = 'raw_content' and not main").groupBy("line_no").count().collect()
    assert {r.line_no: r["count"] for r in got} == {3: 40, 5: 40}
    runs = p7.repeated_runs([[x.split() for x in r.split("\n")] for _, r in pages.values()], 4)
    assert ("run", tuple(prompt.split())) in {(k, tuple(w)) for k, w, _ in runs}


def test_long_lines_that_begin_alike_are_different_lines(spark):
    rng = random.Random(4)
    opening = sentence(rng, 80)
    pages = {f"d{i}": ("\n".join([sentence(rng, 12) + ".", opening + " " + sentence(rng, 90) + ".", sentence(rng, 9) + "."]), None) for i in range(30)}
    assert lines_of(spark, pages).where("not main").isEmpty()


@pytest.mark.parametrize("size", [400, 40])
def test_counts_are_exact_whatever_the_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(p7, "BLOCK_PAGES", size)
    rng = random.Random(5)
    rows = [("Host", f"d{i}", "\n".join([sentence(rng, 12), *(["stand by"] if i % 20 == 0 else []), *(["go on"] if i % 30 == 0 else [])]), None) for i in range(120)]
    pages = spark.createDataFrame(rows, "source string, doc_id string, text string, raw_content string")
    runs = p7.host_runs(pages).collect()
    assert {(r.kind, r.key) for r in runs} == {("note", p7.line_key(["stand", "by"]))}  # 6 of 120 pages are 5 %, 4 are under 4 %


def test_salted_hosts_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    pages = {f"d{i}": ("\n".join([sentence(rng, 12) + ".", "Share this page"]), None) for i in range(25)}
    plain = sorted(map(tuple, lines_of(spark, pages).collect()))
    monkeypatch.setattr(p7, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lines_of(spark, pages).collect())) == plain
    assert lines_of(spark, pages).where(~F.col("main")).count() == 25
