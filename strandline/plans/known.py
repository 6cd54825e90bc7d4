"""Operators that no table of the project exercises in full, over small inputs with known answers.

Each query computes its operator over the rows given here; its SQL states the answers, worked
out by hand from the rule.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cleaning, dates, passages, text, urls
from strandline.functions.geometry import ring_in_box
from strandline.plans import claims, flow, grounding, reports
from strandline.session import shared_folder
from strandline.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def known(columns: str, answers: Sequence[tuple]) -> Callable:
    """Registers a query with its answers, the rows of ``columns``."""

    def wrap(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        rows = ", ".join("(" + ", ".join(map(_literal, a)) + ")" for a in answers)
        QUERIES[query.__name__] = query
        SQL[query.__name__] = f"SELECT * FROM (VALUES {rows}) t({columns})"
        return query

    return wrap


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _told(spark: SparkSession, given: Sequence[tuple], schema: str, answer: Column) -> DataFrame:
    """(no, answer) of numbered inputs."""
    rows = [(i, *row) for i, row in enumerate(given, 1)]
    return spark.createDataFrame(rows, f"no int, {schema}").select("no", answer.alias("answer"))


def meaning_problem(question: Column, event_date: Column, place: Column, parties: Column, focus: Column, event: Column) -> Column:
    """Why a search plan says more or less than its question (first reason), null if it says the same.

    Days stated in the question and the plan's day must agree, place and parties must stand in the
    question, both sides asked for must be two, and the plan adds neither a joint statement nor a war.
    """
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    asked = bare(question)
    form = r"(\d{4})(?:년|[-./])(\d{1,2})(?:월|[-./])(\d{1,2})일?"
    part = lambda i: F.regexp_extract_all(asked, F.lit(form), F.lit(i))
    days = F.array_compact(F.transform(F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")), lambda t: F.try_to_timestamp(F.concat_ws("-", t["y"], F.lpad(t["m"], 2, "0"), F.lpad(t["d"], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")))
    names = F.transform(parties, lambda p: F.regexp_replace(bare(p), "측$", ""))
    places = F.transform(F.split(place, "[,，、·]"), lambda p: F.regexp_replace(bare(p), "측$", ""))
    # A place that only repeats the parties is none.
    repeats = (F.size(places) > 1) & (F.size(F.array_distinct(places)) == F.size(places)) & (F.array_sort(places) == F.array_sort(F.array_distinct(names)))
    where = F.when(repeats, "").otherwise(bare(F.coalesce(place, F.lit(""))))
    reasons = {
        "date_not_stated": event_date.isNotNull() & ~F.array_contains(days, event_date),
        "date_missing": event_date.isNull() & (F.size(days) > 0),
        "name_not_stated": ((where != "") & ~F.contains(asked, where)) | F.exists(names, lambda n: (n == "") | ~F.contains(asked, n)),
        "party_missing": text.question_flags(question)["both_sides"] & (F.size(F.array_distinct(parties)) < 2),
        "joint_added": ~F.contains(question, F.lit("공동")) & F.contains(F.array_join(focus, " "), F.lit("공동")),
        "war_added": ~F.contains(question, F.lit("전쟁")) & F.contains(event, F.lit("전쟁")),
    }
    return F.coalesce(*[F.when(holds, name) for name, holds in reasons.items()])


def still_verified(cached: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Cached verified claims (paragraph_id, quote, translation, event_date) with ``valid``: the quote still stands
    in its paragraph, the translation holds Hangul, and a date is stated in full."""
    joined = cached.join(paragraphs.select("paragraph_id", "paragraph"), "paragraph_id", "left")
    stands = F.coalesce(F.contains("paragraph", "quote"), F.lit(False))
    dated = F.col("event_date").isNull() | dates.has_explicit_date(F.col("quote"), F.col("event_date"))
    return joined.withColumn("valid", stands & F.coalesce(F.col("translation").rlike("[가-힣]"), F.lit(False)) & dated).drop("paragraph")


def retained_statements(statements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Statements with their verdict; one without a verdict, or without a supporting one, is excluded with a reason."""
    told = statements.join(verdicts.groupBy("statement_id").agg(F.bool_and("supported").alias("supported"), F.count("*").alias("n")), "statement_id", "left")
    reason = F.when(F.col("n").isNull(), "not_checked").when(F.col("n") > 1, "checked_twice").when(~F.coalesce("supported", F.lit(False)), "not_supported")
    return told.withColumn("excluded", reason).drop("supported", "n")


def source_pieces(body: Column, most: int = 60_000, size: int = 1_400) -> Column:
    """(pieces, hash, truncated): the clipped body's lines in pieces of ``size``, and the digest of the whole body."""
    lines = F.filter(F.transform(F.split(F.substring(body, 1, most), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substring(x, i * size + 1, F.lit(size)))))
    return F.struct(cut.alias("pieces"), F.sha2(body, 256).alias("hash"), (F.length(body) > most).alias("truncated"))


@known("claim_id, reason, normalized", [("s-C1", None, "12000 m"), ("s-C2", "number_not_found", None), ("s-C3", "unit_not_found", None), ("s-C4", "not_asked", None), ("s-C5", "quote_not_found", None), ("s-C6", None, "2026-10-09T16:00:00+00:00")])
def kwn_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six drafts of one source, each but two with one fault; a seventh is beyond the limit."""
    given = "source_id string, ord int, target_id string, matches_event boolean, paragraph_id string, quote string, value_number double, unit string, event_date string, time_local string, timezone string"
    base = [
        ("s", 1, "t", True, "p", "It flew 12 km north", 12.0, "km", None, None, None),
        ("s", 2, "t", True, "p", "It flew 12 km north", 13.0, "km", None, None, None),
        ("s", 3, "t", True, "p", "It flew 12 km north", 12.0, "fl", None, None, None),
        ("s", 4, "u", True, "p", "It flew 12 km north", 12.0, "km", None, None, None),
        ("s", 5, "t", True, "p", "It flew south", None, None, None, None, None),
        ("s", 6, "t", True, "q", "2026년 10월 10일 1시 정각 한국 시간에 출발", None, None, "2026-10-10", "01:00", "KST"),
        ("s", 7, "t", True, "p", "It flew 12 km north", 12.0, "km", None, None, None),
    ]
    para = _rows(spark, "source_id string, id string, text string", ("s", "p", "At dawn. It flew １２ km north of the bay."), ("s", "q", "2026년 10월 10일 1시 정각 한국 시간에 출발했다."))
    return claims.admitted(spark.createDataFrame(base, given), _rows(spark, "id string", ("t",)), para).select("claim_id", "reason", "normalized")


@known("no, answer", [(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False)])
def kwn_explicit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = ["It left on 2026-10-03.", "2026년 10월 3일 출항", "On October 3rd, 2026 it left", "On 3 Oct. 2026 it left", "On 03/10/2026 it left", "12026-10-03", "yesterday"]
    return _told(spark, [(q,) for q in quotes], "q string", dates.has_explicit_date(F.col("q"), F.lit(datetime.date(2026, 10, 3))))


@known("no, answer", [(1, True), (2, True), (3, True), (4, False), (5, False), (6, False)])
def kwn_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("at 09:05 it left", "09:05"), ("오전 9시 5분", "09:05"), ("９時に出発", "09:00"), ("23시 15분", "23:00"), ("at 109:05", "09:05"), ("9시", "soon")]
    return _told(spark, given, "q string, t string", dates.has_clock(text.nfkc_fold(F.col("q")), F.col("t")))


@known("no, answer", [(1, "2026-01-02"), (2, "2026-09-03"), (3, "2026-09-04"), (4, "2026-08-01"), (5, "2026-05-06"), (6, "2026-07-08"), (7, None)])
def kwn_published_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's date before an official header, that before the address, that before the text."""
    given = [
        ("2026-01-02T00:00:00Z", "https://mnd.gov.tw/2026/08/01/x", "115年9月3日"),
        (None, "https://www.mnd.gov.tw/2026/08/01/x", "新聞\n發布日期：115年9月3日\n內文"),
        (None, "https://mod.gov.cn/2026/08/01/x", "发布时间：2026-9-4 10:00"),
        (None, "https://site.example/2026/08/01/x", "115年9月3日"),
        (None, "https://site.example/x", "By A. Writer, May 6, 2026 - the ship"),
        (None, "https://site.example/x", "2026年7月8日，北京"),
        (None, "https://site.example/x", "today"),
    ]
    return _told(spark, given, "a string, u string, t string", dates.published_date(F.col("a"), F.col("u"), F.col("t")))


@known("no, answer", [(1, None), (2, "date_not_stated"), (3, "date_missing"), (4, "name_not_stated"), (5, "party_missing"), (6, "joint_added"), (7, "war_added"), (8, None)])
def kwn_plan_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = datetime.date(2026, 9, 3)
    ask = "2026년 9월 3일 대만해협에서 중국과 대만 양측 발표 비교"
    given = [
        (ask, day, "대만해협", ["중국", "대만"], ["발표"], "훈련"),
        (ask, datetime.date(2026, 9, 4), "대만해협", ["중국", "대만"], ["발표"], "훈련"),
        (ask, None, "대만해협", ["중국", "대만"], ["발표"], "훈련"),
        (ask, day, "동해", ["중국", "대만"], ["발표"], "훈련"),
        (ask, day, "대만해협", ["중국"], ["발표"], "훈련"),
        (ask, day, "대만해협", ["중국", "대만"], ["공동 발표"], "훈련"),
        (ask, day, "대만해협", ["중국", "대만"], ["발표"], "전쟁"),
        (ask, day, "중국·대만", ["중국 측", "대만"], ["발표"], "훈련"),
    ]
    answer = meaning_problem(*map(F.col, "qdpnfe"))
    return _told(spark, given, "q string, d date, p string, n array<string>, f array<string>, e string", answer)


@known("quote, valid", [("It left on 2026-10-03.", True), ("It came back.", False), ("It left.", False), ("It sank.", False)])
def kwn_still_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = _rows(spark, "paragraph_id string, quote string, translation string, event_date date", ("p", "It left on 2026-10-03.", "출항", datetime.date(2026, 10, 3)), ("p", "It came back.", "귀항", None), ("q", "It left.", "left", None), ("q", "It sank.", "침몰", datetime.date(2026, 1, 1)))
    para = _rows(spark, "paragraph_id string, paragraph string", ("p", "Note. It left on 2026-10-03. End."), ("q", "It left. It sank."))
    return still_verified(cached, para).select("quote", "valid")


@known("statement_id, excluded", [("a", None), ("b", "not_supported"), ("c", "not_checked"), ("d", "checked_twice")])
def kwn_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _rows(spark, "statement_id string, supported boolean", ("a", True), ("b", False), ("d", True), ("d", True))
    return retained_statements(_rows(spark, "statement_id string", ("a",), ("b",), ("c",), ("d",)), verdicts)


@known("no, pieces, longest, truncated", [(1, 2, 1400, False), (2, 3, 1400, False), (3, 1, 100, True), (4, 0, 0, False)])
def kwn_source_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("no") == 1, F.concat(F.repeat(F.lit("a"), 1400), F.lit("\n\nb"))).when(F.col("no") == 2, F.concat(F.repeat(F.lit("a"), 2801), F.lit("\n  \n"))).when(F.col("no") == 3, F.repeat(F.lit("c"), 200)).otherwise("")
    made = F.when(F.col("no") == 3, source_pieces(body, 100)).otherwise(source_pieces(body))
    longest = F.coalesce(F.array_max(F.transform(F.col("m.pieces"), lambda x: F.length(x))), F.lit(0))
    return spark.range(1, 5).select(F.col("id").cast("int").alias("no")).withColumn("m", made).select("no", F.size("m.pieces").alias("pieces"), longest.alias("longest"), "m.truncated")


@known("no, answer", [(1, "92 컨센서스(1992년 합의)를 말했다"), (2, "9.2 합의를 말했다"), (3, "라이칭더 총통"), (4, "장한 대변인"), (5, "중국 국무원 대만사무판공실")])
def kwn_terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("他談九二共識", "9.2 합의를 말했다"), ("other", "9.2 합의를 말했다"), ("LAI CHING-TE said", "라칭덕 총통"), ("张晗说", "장한잉 대변인"), ("国务院台办", "국무원 대만총국")]
    return _told(spark, given, "o string, t string", grounding.corrected(F.col("o"), F.col("t")))


@known("no, answer", [(1, True), (2, False), (3, True), (4, True), (5, False)])
def kwn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("Indian forces", "India"), ("Indiana", "India"), ("ＰＡＫＩＳＴＡＮＩ crews", "Pakistan"), ("台湾海峡で", "台湾海峡"), ("대한", "대만")]
    folded = text.nfkc_fold(F.col("t"))
    answer = F.coalesce(*[F.when(F.col("n") == n, text.contains_name(folded, n)) for n in sorted({n for _, n in given})])
    return _told(spark, given, "t string, n string", answer)


@known("no, answer", [(1, "It left. It came."), (2, "It left."), (3, "Subscribers saw it.")])
def kwn_access_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["It left. Already a subscriber? Log in here. It came.", "It left. Register now to continue reading this article.", "Subscribers saw it."]
    return _told(spark, [(t,) for t in given], "t string", F.trim(text.without_access_notices(F.col("t"))))


@known("no, reason, word", [(1, None, "navy"), (2, "topic_anchors_missing", ""), (3, "security_topic_missing", ""), (4, "topic_background_only", ""), (5, None, "침공")])
def kwn_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = "The harbor was calm and the crews of the small boats rested all day long. " + "Calm. " * 20
    given = [
        ("China sent its navy to the strait. It left.", "China at sea"),
        ("The navy left.", "Navy"),
        ("China sent flowers.", "China"),
        (far + "Then China sent its navy.", "Harbor news"),
        ("중국의 침공 우려.", "중국"),
    ]
    told = _rows(spark, "no int, t string, h string", *[(i, *x) for i, x in enumerate(given, 1)]).withColumn("g", passages.topic_of(F.col("t"), F.col("h"), [["중국"]], True))
    return told.select("no", "g.reason", F.col("g.security_term").alias("word"))


@known("no, answer", [(1, "the minister](https://a.b/c) *today"), (2, None), (3, "今天 [00:05] 出發")])
def kwn_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [("He met [the minister](https://a.b/c) *today*.", "the minister today", "markdown"), ("a b a b", "a b", "markdown"), ("[00:01] 我們 今天 [00:05] 出發 了", "今天出發", "transcript")]
    answer = F.when(F.col("k") == "markdown", passages.restored(F.col("r"), F.col("q"), "markdown")).otherwise(passages.restored(F.col("r"), F.col("q"), "transcript"))
    return _told(spark, given, "r string, q string, k string", answer)


@known("no, found, close", [(1, "The ferry left the harbor at dawn.", True), (2, None, None)])
def kwn_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the candidates of a quote: the sentence of the source that is most like it."""
    given = [(1, "Noise before. The ferry left the harbor at dawn. Noise after.", "The ferry left the harbour at dawn."), (2, "", "x")]
    best = F.try_element_at(passages.candidates_of(F.col("s"), F.col("q")), F.lit(1))
    return _rows(spark, "no int, s string, q string", *given).withColumn("b", best).select("no", F.expr("substring(s, b.start + 1, b.end - b.start)").alias("found"), (F.col("b.ratio") > 0.9).alias("close"))


@known("no, answer", [(1, "A ship left.|It came."), (2, "One.|Two."), (3, "")])
def kwn_body_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by paragraph, by transcript, and of an empty body."""
    given = ["# Head\n\nA ship left.\n\nIt came.", "Intro text.\n## Transcript\nOne. Two.", ""]
    cut = F.transform(cleaning.candidates_of_body(F.col("t")), lambda s: F.substring("t", s["start"] + 1, s["end"] - s["start"]))
    return _told(spark, [(t,) for t in given], "t string", F.array_join(cut, "|"))


@known("no, body, removed", [(1, "Lead text.", "내비게이션/헤더/푸터 태그"), (2, "Line one.\n\nLine two.", "바이라인 링크|하단 추천기사/사이드바/댓글 블록 절단"), (3, "", ""), (4, "Said.", "유튜브 메타데이터(설명란 등) 배제 및 자막 우선 추출")])
def kwn_clean_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [
        "<html><body><nav>Menu</nav><div id='ad'>Buy</div><article>Lead text.</article></body></html>",
        "Line one.\n[Other story](https://a.example/1)\nLine two.\n## Related articles\nLine three.",
        " ",
        "About the channel\n### Transcript\nSaid.",
    ]
    told = _rows(spark, "no int, t string", *enumerate(given, 1)).withColumn("c", cleaning.cleaned(F.col("t")))
    return told.select("no", "c.body", F.array_join("c.removed", "|").alias("removed"))


@known("no, country", [(1, "TW"), (2, "CN"), (3, None), (4, None)])
def kwn_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["https://www.mnd.gov.tw/a", "https://mod.gov.cn/a", "https://notmod.gov.cn.example/a", "bad url"]
    told = _rows(spark, "no int, u string", *enumerate(given, 1))
    return told.select("no", F.coalesce(*[F.when(urls.is_official(F.col("u"), c), c) for c in ("CN", "TW")]).alias("country"))


@known("event_id, doc_id, version", [("e", "a", 1), ("e", "b", 2), ("e", "c", 2)])
def kwn_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's documents after an ingest: new ones in, known ones replaced."""
    kind = "event_id string, doc_id string, version int"
    return sinks.ingest(_rows(spark, kind, ("e", "a", 1), ("e", "b", 1)), _rows(spark, kind, ("e", "b", 2), ("e", "c", 2))).select("event_id", "doc_id", "version")


@known("label, consistent", [("right", True), ("wrong", False)])
def kwn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _rows(spark, "label string", ("x",), ("x",), ("y",))
    given = {"right": [("x", 2), ("y", 1), ("z", 0)], "wrong": [("x", 3)]}
    return _rows(spark, "label string, consistent boolean", *[(k, reports.consistent_summary(scored, _rows(spark, "label string, n bigint", *v), 0.6, 0.7)) for k, v in given.items()])


@known("no, answer", [(1, "Taiwan Strait tension"), (2, "")])
def kwn_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"대만": "Taiwan", "대만해협": "Taiwan Strait", "긴장": "tension"}
    answer = F.pandas_udf(lambda s: s.map(lambda t: passages.translated(t, words)), "string")(F.col("t"))
    return _told(spark, [("대만해협 긴장 고조",), ("날씨",)], "t string", answer)


def _written(spark: SparkSession, *lines: str, kind: str = "json") -> str:
    """A folder with one text file of these lines, where all executors see it."""
    path = f"{shared_folder(spark)}/known-{uuid.uuid4().hex}.{kind}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


COLLECTED = '{"output": {"by_country": {"KR": [{"doc_id": "1", "article_text": "body", "published_date": "x"}], "US": [{"doc_id": "2", "content": "short", "country": "JP"}]}}, "question": "q"}'


@known("doc_id, country, question", [("1", "KR", "q"), ("2", "JP", "q")])
def kwn_collection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enveloped collection by country: a document without a country takes its group's."""
    return readers.collection_json(spark, _written(spark, COLLECTED)).select("doc_id", "country", "question")


@known("doc_id, text, text_origin, content_kind, warnings", [("1", "body", "cleaned", "full", 1), ("2", "short", "paragraphs", "snippet", 0)])
def kwn_retrieval_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.retrieval_form(readers.collection_json(spark, _written(spark, COLLECTED)))
    return rows.select("doc_id", "text", "text_origin", "content_kind", F.size("warnings").alias("warnings"))


@known('"date", views', [("2026-01-01", 7), ("2026-01-02", 3)])
def kwn_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headed series: the last line of a repeated day counts, lines without a day go."""
    path = _written(spark, "date,views", "2026-01-01,5", "2026-01-01,7", "x,1", "2026-01-02,3", kind="csv")
    return readers.daily_series(spark, path).select(F.col("date").cast("string").alias("date"), "views")


@known("report_id, ord, title, text", [("r", 0, "A", "one\ntwo"), ("r", 2, "C", "three")])
def kwn_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "id string, sources array<struct<title:string,paragraphs:array<struct<text:string>>>>"
    reports_ = _rows(spark, kind, ("r", [("A", [("one",), ("two",)]), ("B", [(" ",)]), ("C", [("three",)])]), ("none", []))
    return readers.report_documents(reports_)


@known("id, problem", [(1, None), (2, "unreadable"), (3, "count"), (4, "count"), (5, "kind")])
def kwn_validated_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, "id int, body string", (1, '{"n": 3, "kind": "a"}'), (2, "not json"), (3, '{"n": -1, "kind": "a"}'), (4, '{"kind": "a"}'), (5, '{"n": 1, "kind": "z"}'))
    good, bad = readers.validated_json(rows, "body", "n int, kind string", {"count": F.col("parsed.n") >= 0, "kind": F.col("parsed.kind").isin("a", "b")})
    return good.select("id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("id", "problem"))


@known("id, version, state", [("a", 1, "draft"), ("a", 2, "approved"), ("b", 1, "draft")])
def kwn_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned log after one accepted change, one that came too late and one to a running item."""
    kind = "id string, state string"
    log = sinks.append_version(_rows(spark, "id string, version int, state string", ("b", 1, "draft")), _rows(spark, kind, ("a", "draft")), "id", 0)
    log = sinks.append_version(log, _rows(spark, kind, ("a", "approved")), "id", 1)
    try:
        log = sinks.append_version(log, _rows(spark, kind, ("a", "late")), "id", 1)
    except sinks.Conflict:
        pass
    stuck = sinks.append_version(log, _rows(spark, kind, ("b", "running")), "id", 1)
    try:
        log = sinks.append_version(stuck, _rows(spark, kind, ("b", "approved")), "id", 2)
    except sinks.Conflict:
        pass
    return log.select("id", "version", "state")


@known("id, state", [("1", "done"), ("2", "pending")])
def kwn_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = sinks.with_digest(_rows(spark, "id string, body string", ("1", "x"), ("2", "y")), ["body"], "m")
    done, pending = sinks.cached(work, work.where("id = '1'").select("digest", F.lit("r").alias("result")))
    return done.select("id", F.lit("done").alias("state")).unionByName(pending.select("id", F.lit("pending").alias("state")))


@known("report_id, markdown", [("r", "## A\n\nx\n\n[S1] [S2]\n\n## B\n\ny")])
def kwn_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_report(_rows(spark, "report_id string, ord int, heading string, body string, sources array<string>", ("r", 2, "B", "y", []), ("r", 1, "A", "x", ["S1", "S2"])))


@known("id, n", [(1, 2), (2, 1)])
def kwn_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and as partitioned tables and read again."""
    rows = _rows(spark, "id int, n int", (1, 2), (2, 1))
    path = f"{shared_folder(spark)}/known-{uuid.uuid4().hex}"
    sinks.write_json(rows, f"{path}.json")
    sinks.write_partitioned(rows, f"{path}.parquet", "id")
    back = spark.read.schema("id int, n int").json(f"{path}.json")
    return back.intersect(spark.read.parquet(f"{path}.parquet").select(F.col("id").cast("int").alias("id"), "n"))


@known("no, points", [(1, 5), (2, 0), (3, None)])
def kwn_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square that reaches out of the box is cut at its edge; one outside leaves nothing."""
    inside = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    rows = _rows(spark, "no int, ring array<array<double>>", (1, inside), (2, [[9.0, 9.0], [10.0, 9.0], [10.0, 10.0], [9.0, 9.0]]), (3, None))
    return rows.select("no", F.size(ring_in_box(F.col("ring"), (-1.0, -1.0, 2.0, 2.0))).alias("points"))


@known("language, query, retrieval, problem", [("en", "Drill; Taiwan; taiwan; official statements; 2026-09-03", "Drill Taiwan 2026-09-03", None), ("ko", "훈련; 대만; 공식 발표; 2026-09-03", "훈련 대만 2026-09-03", None), ("ja", "演習; 公式発表; 2026-09-03", "演習  2026-09-03", "fragment_missing")])
def kwn_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = _rows(spark, "language string, ord int, text string", ("en", 1, "Drill"), ("en", 2, "Taiwan"), ("en", 3, "taiwan "), ("ko", 1, "훈련"), ("ko", 2, "대만"), ("ko", 3, "대만"), ("ja", 1, "演習"), ("ja", 2, " "))
    purposes = _rows(spark, "language string, ord int, key string, text string", ("en", 1, "positions", "official statements"), ("en", 2, "sources", "sources"), ("ko", 1, "positions", "공식 발표"), ("ja", 1, "positions", "公式発表"))
    told = flow.search_queries(fragments, purposes, ["positions"], "2026-09-03")
    return told.withColumn("query", F.regexp_replace("query", "; ; ", "; ")).select("language", "query", "retrieval", "problem")


@known("id, body, cited", [("n-1", "see n-1 and x-10, not xa-1", "n-1|n-2")])
def kwn_rebound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids inside a nested value, old ones and new ones overlapping."""
    schema = "id string, body string, cited array<string>"
    value = _rows(spark, "v struct<id:string,body:string,cited:array<string>>", (("a-1", "see a-1 and x-10, not xa-1", ["a-1", "n-1"]),))
    return value.select(grounding.rebound_values(F.col("v"), {"a-1": "n-1", "n-1": "n-2"}, schema).alias("v")).select("v.id", "v.body", F.array_join("v.cited", "|").alias("cited"))
