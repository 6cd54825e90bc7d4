"""Whole runs and text functions against scalar models and known answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandline.functions import cleaning, passages, text
from strandline.plans import flow, known

CASES = [
    "Dr. Kim met U. S. envoys on Jan. 5. They left.",
    "U.S. ships left. “Stop!” he said. It ended (at last.) Then no. 5 came.\nA second line. Its end",
    "我們走了。他說：「回來。」然後。",
    "یہ ہوا۔ پھر وہ گیا؟ ہاں",
    "i.e. this is one. e.g. another etc. and more. The end",
    "",
    "...",
]


@pytest.mark.parametrize("value", CASES)
def test_sentences_of_columns_and_offsets_agree(spark, value):
    got = spark.range(1).select(text.quotes(F.lit(value)).alias("q")).first().q
    assert got == [line[a:b] for line in value.split("\n") for a, b in cleaning.quote_spans(line)]


def test_sentences(spark):
    cut = lambda v: spark.range(1).select(text.quotes(F.lit(v)).alias("q")).first().q
    assert cut(CASES[0]) == ["Dr. Kim met U. S. envoys on Jan. 5.", "They left."]
    assert cut(CASES[2]) == ["我們走了。", "他說：「回來。」", "然後。"]
    assert cut("Version 3.5 is here. It works.") == ["Version 3.5 is here.", "It works."]
    assert cut(None) is None


@pytest.mark.parametrize("name", sorted(known.QUERIES))
def test_known_answers(spark, name):
    import duckdb

    answers = duckdb.sql(known.SQL[name])
    got = known.QUERIES[name](spark, "")
    assert sorted(map(repr, (tuple(r[c] for c in answers.columns) for r in got.collect()))) == sorted(map(repr, answers.fetchall()))


def test_body_languages(spark):
    given = {
        "en": "The ferry services to the northern islands resumed after the storm warning was lifted.",
        "ko": "항만안전처에 따르면 도벨항 앞 항로는 보급 운항 때문에 열한 시간 동안 통제됐고 이후 정상화됐다고 밝혔다.",
        "ja": "沿岸警備隊は、十四隻のヘリコプターがヌアレン国境に入り、十時間後に離れたと発表した。これは二度目である。",
        "zh": "海岸警卫队表示共有八十五艘雷达车进入卡德水道五小时后离开北部指挥部解除警报后开往卡德水道的渡轮恢复运营",
        "zh-Hant": "海岸警衛隊表示共有八十五艘雷達車進入卡德水道五小時後離開北部指揮部解除警報後開往卡德水道的渡輪恢復運營",
        "hi": "सर्वेक्षण के कारण डोबेल बंदरगाह का मार्ग तीन घंटे बंद रहा और जहाज लौट गए। नाव के कप्तान ने पत्रकारों को बताया कि खोज अभियान जारी है।",
        "ur": "بندرگاہ اتھارٹی کی دستاویز پر دستیاب ہے اور سروے کی وجہ سے سامان دیر سے پہنچا۔",
        "unknown": "12 34",
    }
    rows = spark.createDataFrame([(k, v) for k, v in given.items()] + [("unknown", None)], "l string, t string")
    got = [(r.l, r.d.language) for r in rows.select("l", text.body_language(F.col("t")).alias("d")).collect()]
    assert [a for a, _ in got] == [b for _, b in got]


def test_snippet_source_and_briefings():
    lead = "Menus and notices of the site, nothing else of note here to be read.\n\nChina sent its navy to the strait at dawn, officials of the region said.\n\nMore."
    assert passages.snippet_source(lead, [["중국"]], True).startswith("China sent its navy")
    briefing = "Briefing.\n记者：中国海军的演习？\n" + "答：军事演习在中国沿海按计划进行，与任何国家无关，我们将继续保持必要的训练活动安排并及时发布。" * 2
    assert passages.topic_gate([["중국"]], True, True)(briefing, "Regular briefing")[0] is None
    assert passages.topic_gate([["중국"]], True)("x" * 700 + " China " + "y" * 3000 + " navy", "")[0] == "security_topic_missing"


def test_windows_of_matches():
    rng = random.Random(3)
    for _ in range(30):
        size = rng.randint(1, 6000)
        value = list("z" * size)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(size)
            value[at : at + 3] = "abc"
        value = "".join(value)
        import re

        got = passages.Places(value).windows(re.compile("abc"))
        assert list(got) == ["abc" in value[i : i + passages.WINDOW] for i in range(0, len(value), passages.STRIDE)]


def scalar_plan(rows, languages, per_country):
    """The collection plan as a loop over hits in order."""
    seen, kept, reasons = {"u": set(), "t": set(), "b": set()}, [], {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["kind"] != "ok":
            reasons[r["doc_id"]] = r["kind"]
            continue
        keys = {"u": r["url"], "t": r["title"].lower(), "b": r["article_text"]}
        if any(v and v in seen[k] for k, v in keys.items()):
            reasons[r["doc_id"]] = "duplicate"
            continue
        for k, v in keys.items():
            seen[k].add(v)
        kept.append(r)
    chosen = set()
    for country in {r["country"] for r in kept}:
        own = [r for r in kept if r["country"] == country and r["score"] >= 0.35]
        own.sort(key=lambda r: (r["score"] < 0.7, -r["score"], r["doc_id"]))
        chosen |= {r["doc_id"] for r in own[:per_country]}
    return chosen, reasons


def test_collection_plan_against_a_loop(spark):
    rng = random.Random(11)
    body = {"ok": "The ferry services to the northern islands resumed after the storm warning was lifted by the office.", "language_not_selected": "항만안전처에 따르면 도벨항 앞 항로는 보급 운항 때문에 열한 시간 동안 통제됐고 이후 정상화됐다고 밝혔다.", "body_unavailable": "Short."}
    rows = []
    for i in range(80):
        kind = rng.choice(["ok", "ok", "ok", "language_not_selected", "body_unavailable", "not_an_article"])
        tail = f" Day {rng.randint(1, 40)} word{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}."
        url = "https://a.example/" if kind == "not_an_article" else f"https://a.example/story{rng.randint(1, 60)}"
        rows.append({"doc_id": f"d{i:02}", "ord": f"{i:04}", "url": url, "title": f"headline {rng.randint(1, 70)}", "article_text": body.get(kind, body["ok"]) + (tail if kind != "body_unavailable" else ""), "published_date": None, "score": rng.choice([0.2, 0.4, 0.6, 0.75, 0.9]), "country": rng.choice(["US", "KR"]), "kind": kind})
    schema = "doc_id string, ord string, url string, title string, article_text string, published_date string, score double, country string"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    chosen, rejected = flow.collection_plan(frame, {}, ("en",), "2026-09-30", 30, 5)
    want, reasons = scalar_plan(rows, ("en",), 5)
    assert {r.doc_id for r in chosen.collect()} == want
    assert {r.doc_id: r.reason for r in rejected.collect()} == reasons
    assert flow.collection_plan(frame.limit(0), {}, ("en",), "2026-09-30", 30, 5)[0].isEmpty()


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
