"""Sentence spans: long lines, long quotations, abbreviations learned from the corpus."""

from __future__ import annotations

import pandas as pd
import pytest

from strandline.llm import p4_sentences as p4


def learned(texts: list[str]) -> p4.Edges:
    counted = pd.concat(p4._count(iter([pd.DataFrame({"text": texts})])))
    summed = pd.concat(p4._sum(part.assign(part=0)) for _, part in counted.groupby("slice"))
    return p4.edges_of(list(summed.sort_values("slice")["counts"]))


def split(text: str, edges: p4.Edges | None = None) -> list[str]:
    return [text[a:b] for a, b in p4.sentence_ends([text], edges or p4.edges_of([]))[0]]


@pytest.mark.parametrize("decimals", [0, 38, 39, 200])
def test_a_row_of_decimals_loses_no_boundary(decimals):
    text = "One came. Two went. The list reads " + " ".join("1.5" for _ in range(decimals)) + " today. Four sat. Five left."
    assert len(split(text)) == 5


@pytest.mark.parametrize("inside", [2, 45, 60])
@pytest.mark.parametrize("marks", ["“”", '""'])
def test_a_long_quotation_is_one_sentence_with_its_attribution(inside, marks):
    quote = " ".join("We saw the ships there." for _ in range(inside))
    text = f"They met. He said {marks[0]}{quote}{marks[1]} to the crew. They left. It rained."
    assert len(split(text)) == 4


def test_abbreviations_are_learned_in_any_language():
    names = [a + b for a in ("Mar", "Tol", "Ven", "Kas", "Bor", "Ril", "Sund", "Pel") for b in ("low", "ner", "dik", "ova", "ham")]
    texts = [f"The depot of Brigdr. {name} held {i} crates. It was shut at noon." for i, name in enumerate(names)]
    texts += ["The gate is shut. The crates of the depot stand outside."] * 5
    edges = learned(texts)
    assert split("We met Brigdr. Quist at the gate. It was shut.", edges) == ["We met Brigdr. Quist at the gate.", "It was shut."]
    assert len(split("We met Brigdr. Quist at the gate. It was shut.")) == 3  # unknown without a corpus


def test_listed_abbreviations_yield_to_the_corpus():
    assert split("Dr. Kim met Prof. Lee on Jan. 5. They left.") == ["Dr. Kim met Prof. Lee on Jan. 5.", "They left."]
    said = learned([f"Number {i} said no.\nWe asked. They said no.\nAll of them said no." for i in range(60)])
    assert split("They said no. We left.", said) == ["They said no.", "We left."]


def test_no_gap_before_a_mark_ends_a_sentence():
    texts = ["The ships of the northern command entered the gulf early in the day and they left after six long hours of rain. The crews rested."] * 30
    edges = learned(texts)
    for text in texts[:1]:
        assert [s[-1] for s in split(text, edges)] == [".", "."]


def test_a_line_of_many_sentences_takes_linear_time():
    text = " ".join("The ship left the port." for _ in range(20_000))
    assert len(split(text)) == 20_000


def test_a_comma_within_a_number_ends_nothing():
    texts = ["The toll rose to 1,901 crates, the ships left, the crews rested, the port closed, the storm came, the bay froze"] * 40
    assert not any(s.endswith("1,") for s in split(texts[0], learned(texts)))


def test_packed_tables_come_back_whole():
    rng = p4.np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys = p4.distinct(rng.integers(0, 2**63, n).astype(p4.np.uint64) * p4.np.uint64(2))
        counts = rng.integers(0, 2**40, (2, 2, len(keys)))
        back = p4._unpacked(p4._packed(keys, counts))
        assert (back[0] == keys).all() and (back[1] == counts).all() and (p4._keys(p4._packed_keys(keys)) == keys).all()
