"""Truncated texts: planted cuts, words of any length, and what the tries decide."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import p6_truncated as p6

SUBJECTS = "harbormaster fisherman spokesperson lieutenant navigator shipwright lighthousekeeper".split()
VERBS = "inspected repaired abandoned photographed surrounded registered".split()
OBJECTS = "the breakwater|the minesweeper|the observatory|the southern anchorage|the grain terminal".split("|")
HEADS = ["Read more about the harbor", "Contact the newsroom", "All rights reserved"]


def planted(n: int, seed: int) -> tuple[list[tuple[str, str]], set[str]]:
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(f"The {rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} on day {rng.randint(1, 99)}." for _ in range(5))
        if i % 4 == 0:
            at = rng.randint(text.rindex(". The") + 12, len(text) - 12)
            text, _ = text[:at].rstrip(), cut.add(f"d{i}")
        elif i % 4 == 1:
            text += "\n" + rng.choice(HEADS)
        rows.append((f"d{i}", text))
    return rows, cut


def found(spark, rows) -> dict[str, str]:
    return {r.doc_id: r.evidence for r in p6.truncated(spark.createDataFrame(rows, "doc_id string, text string")).where("cut").collect()}


def test_planted_cuts_are_found_by_the_tries(spark):
    rows, cut = planted(300, 1)
    got = found(spark, rows)
    assert len(cut & got.keys()) >= 0.95 * len(cut) and len(cut & got.keys()) >= 0.97 * len(got)
    assert sum(e in ("prefix", "phrase") for e in got.values()) > 0.9 * len(got)


@pytest.mark.parametrize("both", [False, True])
def test_without_the_tries_most_are_lost(spark, monkeypatch, both):
    rows, cut = planted(200, 2)
    nodes, counts = p6._word_trie, p6.ending_counts
    monkeypatch.setattr(p6, "_word_trie", lambda docs, finals: nodes(docs, finals).where("false"))
    if both:
        monkeypatch.setattr(p6, "ending_counts", lambda docs, asked: counts(docs, asked).where("false"))
    got = found(spark, rows)
    assert "prefix" not in got.values() and (len(got) < 0.1 * len(cut)) == both


def test_words_of_any_length_are_known(spark):
    word = "anti" + "disestablishmentarianism" * 3
    rows = [(f"d{i}", f"They spoke of {word} at noon {i}.") for i in range(20)] + [("cut", f"On day two they heard much of {word[:60]}")]
    assert found(spark, rows) == {"cut": "prefix"}


@pytest.mark.parametrize("n", [0, 2, 1_381, 65_000, 10**12])
def test_lines_that_always_end_have_finite_odds(spark, n):
    df = spark.createDataFrame([(n, n), (n, 0)], "n long, ends long")
    always, never = (r.odds for r in df.select(p6._ending_odds([(F.col("n"), F.col("ends"))] * p6.CONTEXTS).alias("odds")).collect())
    want = math.log(2 * ((n + 2) / 2) ** p6.CONTEXTS - 1)  # each context takes the smaller share q to 2 q / (n + 2)
    assert never == pytest.approx(-want) and always == pytest.approx(max(want, math.log(9)) if n >= 3 else want)


def test_a_gap_that_is_two_kinds_of_end_counts_once():
    text = "完了。*\nnext\n"
    stream, place = p6._stream(p6.points(text))
    ends = p6._unit_starts(text, place, stream)[1].tolist()
    assert ends == sorted(set(ends)) and stream[ends[0]] == 10
