"""Passage functions, provider hooks and grounding operators."""

import pytest
from pyspark.sql import functions as F

from strandline import providers
from strandline.functions import passages as p
from strandline.plans import grounding as g


def test_paragraphs():
    text = "# Heading\n![x](y)\n* [menu](u)\nshort\n" + "A plain line of text.\n" + "Sentence number one is here. " * 30 + "\n" + "word " * 200
    got = p.paragraphs(text)
    assert got[0] == "A plain line of text." and all(15 <= len(x) <= 400 for x in got)
    assert " ".join(got).count("Sentence number one is here.") == 30 and " ".join(got).split().count("word") == 200
    assert p.paragraphs("") == []


def test_first_sentences():
    text = "The title here\n입력 2026-01-02 10:00\n홍길동 기자\nBy John Smith\nphoto: a ship\nDr. Kim of the U.S. team spoke at 3.5 km. Two. Another one came. 第三句。第四句在此。 Fifth is here. Sixth is not."
    assert p.first_sentences(text, "The title here") == "Dr. Kim of the U.S. team spoke at 3.5 km. Another one came. 第三句。 第四句在此。 Fifth is here."
    assert p.first_sentences("") == "" and p.first_sentences("यह पहला वाक्य है। यह दूसरा है।") == "यह पहला वाक्य है। यह दूसरा है।"


@pytest.mark.parametrize(
    "text,title,reason",
    [
        ("India moved troops to the border with Pakistan.", "India and Pakistan", None),
        ("Indiana moved troops to the border with Pakistan.", "x", "topic_anchors_missing"),
        ("India and Pakistan trade tea.", "India and Pakistan", "security_topic_missing"),
        ("A long lead about tea and coffee prices in the whole of the wide world today.\n\nIndia, Pakistan, troops.", "Tea", "topic_background_only"),
        ("India troops. " + "x" * 4000 + " Pakistan.", "India", "security_topic_missing"),
    ],
)
def test_topic_gate(text, title, reason):
    assert p.topic_gate([["인도"], ["파키스탄"]], True)(text, title)[0] == reason


def test_topic_gate_without_context():
    assert p.topic_gate([], True)("x", "")[0] == "topic_context_missing"


def test_restored_quotes():
    raw = "He met [the minister](https://a.b/c) *today* in town."
    assert p.restored_quote(raw, "the minister today", "markdown") == "the minister](https://a.b/c) *today"
    assert p.restored_quote("a b a b", "a b", "markdown") is None and p.restored_quote(raw, "absent", "markdown") is None
    assert p.restored_quote("[00:01] 我們 今天 [00:05] 出發 了", "今天出發", "transcript") == "今天 [00:05] 出發"


def test_fuzzy_and_lexicon():
    source = "Noise before. The ferry left the harbor at dawn. Noise after."
    a, b, r = p.fuzzy_candidates(source, "The ferry left the harbour at dawn.")[0]
    assert "ferry left the harbor" in source[a:b] and r > 0.9
    assert p.translated("대만해협 긴장 고조", {"대만": "Taiwan", "대만해협": "Taiwan Strait", "긴장": "tension"}) == "Taiwan Strait tension"


def test_wrappers(spark):
    df = spark.createDataFrame([("India moved troops to the border. It rained.", "India"), (None, None)], "t string, h string")
    rows = df.select(p.paragraphs_of(F.col("t")).alias("p"), p.snippet_of(F.col("t"), F.col("h")).alias("s"), p.topic_of(F.col("t"), F.col("h"), [["India"]], False).alias("g"), p.restored(F.col("t"), F.lit("moved troops"), "markdown").alias("q"), p.candidates_of(F.col("t"), F.lit("moved troops")).alias("c")).collect()
    assert rows[0].q == "moved troops" and rows[0].g.reason is None and rows[1].p == [] and rows[1].g.reason == "topic_anchors_missing" and rows[1].q is None


def test_budget_terms_and_ids(spark):
    rows = [("a", i, float(s), c) for i, (s, c) in enumerate([(9, 2000), (8, 900), (7, 200), (6, 10), (5, 10)])]
    got = [(r.o, r.used) for r in g.within_budget(spark.createDataFrame(rows, "g string, o int, s double, c int"), "g", "s", "c", "o", 2200, 3).orderBy("place").collect()]
    assert [o for o, _ in got] == ["0", "2"]
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(g.corrected(F.lit("賴清德 said"), F.lit("라칭덕 총통"))) == "라이칭더 총통" and one(g.corrected(F.lit("other"), F.lit("라칭덕"))) == "라칭덕"
    assert one(g.rebound(F.lit("a-1 a-12 xa-1 (a-1)"), F.lit("a-1"), F.lit("b"))) == "b a-12 xa-1 (b)"
    assert one(g.cooccurs(F.concat(F.lit("x"), F.repeat(F.lit("y"), 1600), F.lit("z")), ["y", "z"])) == 750 and one(g.cooccurs(F.lit(""), ["y"])) is None


def test_citations(spark):
    s = spark.createDataFrame([("1", "common", ["a"]), ("2", "judgment", []), ("3", "common", ["a", "b"]), ("4", "other", ["a", "a", "zz"])], "sentence_id string, kind string, citations array<string>")
    e = spark.createDataFrame([("a",), ("b",)], "evidence_id string")
    assert {tuple(r) for r in g.citation_problems(s, e, {"common": 2, "judgment": 1}).collect()} == {("1", "too_few"), ("2", "too_few"), ("4", "unknown"), ("4", "repeated")}


def test_scorers_and_vectors(spark, tmp_path):
    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\ndef score(df):\n    return df.select('id', F.lit(0.5).alias('reliability'))\ndef bad(df):\n    return df.select('id', F.lit(1.5).alias('reliability'))\n")
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.reliability for r in providers.score_with(providers.load_scorer(f"{tmp_path}/own.py:score"), docs).collect()} == {0.5}
    with pytest.raises(ValueError):
        providers.score_with(providers.load_scorer(f"{tmp_path}/own.py:bad"), docs)
    work = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "digest string, text string")
    known = spark.createDataFrame([("1", [1.0])], "digest string, embedding array<float>")
    assert {r.digest: r.embedding for r in providers.embed_missing(work, known, None).collect()} == {"1": [1.0], "2": None}
    assert {r.digest: r.embedding for r in providers.embed_missing(work, known, lambda ts: [[2.0]] * len(ts)).collect()} == {"1": [1.0], "2": [2.0]}
