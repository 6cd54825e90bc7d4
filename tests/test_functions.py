"""Known answers of the column functions."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import dates, keys, numbers, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://www.Ex.com/news/123/some-slug/?utm_source=a&x=1&b=#top", "ex.com/news/123?x=1"),
        ("http://ex.com/a/?reference=1&fromage=2", "ex.com/a"),
        ("https://ex.com/story/9", "ex.com/story/9"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url,want", [("https://a.com/x/1", True), ("https://a.com/", False), ("https://a.com/index_2.html", False), ("https://a.com/tag/x", False), ("not a url", False), (None, False)])
def test_article_url(spark, url, want):
    assert one(spark, urls.is_article_url(F.lit(url).cast("string"))) is want


@pytest.mark.parametrize("url,ok", [("https://a.b.com/x", True), ("http://b.com/", False), ("https://u@b.com/", False), ("https://1.2.3.4/", False), ("https://b.com:444/", False), ("https://notb.com/", False), ("https://b.com", True)])
def test_safe_link(spark, url, ok):
    assert (one(spark, urls.safe_link(F.lit(url), F.array(F.lit("b.com")))) is not None) is ok


def test_titles_and_hashes(spark):
    assert one(spark, text.canonical_title(F.lit("Hello, World! - BBC News"))) == "hello world"
    assert one(spark, text.fingerprint(F.lit(" .,"))) == "" and one(spark, text.fingerprint(F.lit("A b"))) == one(spark, text.fingerprint(F.lit("a, B!")))
    assert one(spark, text.content_hash(F.lit("a  b\n"))) == one(spark, text.content_hash(F.lit("a b")))


@pytest.mark.parametrize("value,want", [("대만해협", ["대만", "만해", "해협"]), ("a", []), ("Taiwan Strait", ["taiwan", "strait"]), ("海", []), ("", [])])
def test_terms(spark, value, want):
    assert one(spark, text.terms(text.nfkc_fold(F.lit(value)))) == want


def test_names(spark):
    fold = lambda s: text.nfkc_fold(F.lit(s))
    assert one(spark, text.contains_name(fold("Indian forces"), "India")) and not one(spark, text.contains_name(fold("Indiana"), "India"))
    assert one(spark, text.contains_name(fold("台湾海峡で"), "台湾海峡"))
    assert "Taiwan" in text.name_variants(["대만"]) and "대만" in text.name_variants(["臺灣"]) and "중국" in text.name_variants(["중국 정부"])


@pytest.mark.parametrize("quote,reason", [("Did it leave?”", "question_without_assertion"), ("下載檔案 複製連結", "navigation_or_download_text"), ("第 3 章 概要", "section_heading"), ("The ship left.", None)])
def test_claim_rejection(spark, quote, reason):
    assert one(spark, text.claim_rejection(F.lit(quote))) == reason


def test_substance_and_notices(spark):
    assert not one(spark, text.is_substantive(F.lit("https://a.b/c"))) and not one(spark, text.is_substantive(F.lit("References: x"))) and one(spark, text.is_substantive(F.lit("It left.")))
    assert one(spark, text.without_access_notices(F.lit("It left. Already a subscriber? Log in here. It came."))) == "It left. It came."
    assert one(spark, text.attribution(F.lit("It left, according to Harbor News today."))) == "Harbor News today"
    assert one(spark, text.strip_markup(F.lit("<nav>x</nav><p>A <b>b</b></p>\n* [m](u)\n[c](d)"))).split() == ["A", "b", "c"]


@pytest.mark.parametrize("clock,has", [("23시", "23:00"), ("23시 15분", "23:15"), ("23時15分", "23:15"), ("23：15", "23:15"), ("9:05", "09:05")])
def test_clocks(spark, clock, has):
    assert one(spark, dates.has_clock(text.nfkc_fold(F.lit(clock)), F.lit(has)))


def test_clock_to_the_minute(spark):
    assert not one(spark, dates.has_clock(F.lit("23시 15분"), F.lit("23:00"))) and not one(spark, dates.has_clock(F.lit("23시"), F.lit("bad")))


def test_utc(spark):
    at = lambda q, d="2026-10-10", t="01:00", z="KST": one(spark, dates.utc_time(F.lit(q), F.lit(d).cast("string"), F.lit(t), F.lit(z)))
    assert str(at("2026년 10월 10일 01:00 한국 시간")) == "2026-10-09 16:00:00"
    assert at("2026년 10월 10일 01:00") is None and at("01:00 KST") is None and at("2026-10-10 KST", d=None) is None


@pytest.mark.parametrize("quote,yes", [("on 2026-10-03", True), ("2026年10月3日", True), ("October 3rd, 2026", True), ("3 Oct. 2026", True), ("2026-10-30", False), ("Oct 3", False)])
def test_explicit_dates(spark, quote, yes):
    assert one(spark, dates.has_explicit_date(F.lit(quote), F.lit("2026-10-03").cast("date"))) is yes


def test_published(spark):
    d = lambda api, url, t: one(spark, dates.published_date(F.lit(api).cast("string"), F.lit(url), F.lit(t)))
    assert d("2026-01-02T03:04", "u", "") == "2026-01-02" and d(None, "https://a/2026/09/25/x", "") == "2026-09-25"
    assert d(None, "https://a/AKR20260930181100089", "") == "2026-09-30" and d(None, "u", "입력 2026.9.3 12:00") == "2026-09-03"
    assert d(None, "u", "Published Sept 5, 2026") == "2026-09-05" and d(None, "u", "none") is None
    assert str(one(spark, dates.roc_date(F.lit("x\n115年9月3日\ny")))) == "2026-09-03"
    assert one(spark, dates.lenient_date(F.lit("2026/1/2"))) is None and str(one(spark, dates.lenient_date(F.lit("2026-01-02T00:00:00Z")))) == "2026-01-02"


def test_numbers(spark):
    assert [one(spark, numbers.label(F.lit(x).cast("double"))) for x in (None, 0.5999, 0.6, 0.6999, 0.7, 1.0)] == [numbers.LABELS[i] for i in (2, 2, 1, 1, 0, 0)]
    assert [one(spark, numbers.banded(F.lit(x))) for x in (0.0, 0.5, 0.8, 2.0)] == [0.17, 0.22, 0.85, 0.99]
    assert one(spark, numbers.comparable_value(F.lit(1.5), F.lit("km"))) == one(spark, numbers.comparable_value(F.lit(1500.0), F.lit("m"))) == "1500 m"
    assert one(spark, numbers.comparable_value(F.lit(1.0), F.lit("mile"))) is None
    assert one(spark, numbers.states_number(F.lit("about 1,200 ships"), F.lit(1200.0))) and not one(spark, numbers.states_number(F.lit("12"), F.lit(1200.0)))
    assert one(spark, numbers.states_unit(F.lit("3 km away"), F.lit("km"))) and not one(spark, numbers.states_unit(F.lit("3 km"), F.lit("m")))
    v = lambda *x: numbers.unit_vector(F.array(*[F.lit(float(i)) for i in x]))
    assert one(spark, numbers.clipped_cosine(v(1, 2), v(2, 1))) == 0.8 and one(spark, numbers.clipped_cosine(v(1, 0), v(-1, 0))) == 0.0
    assert one(spark, v(0, 0)) is None and one(spark, v(1, float("nan"))) is None
    with pytest.raises(Exception, match="different sizes"):
        one(spark, numbers.clipped_cosine(v(1, 2), v(1, 2, 3)))


def test_keys(spark):
    assert one(spark, keys.source_key(F.lit(" The　Post  "))) == "the post"
    assert [one(spark, keys.country_key(F.lit(x).cast("string"))) for x in (" us", "", None)] == ["US", "UNKNOWN", "UNKNOWN"]
