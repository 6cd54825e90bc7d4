"""Operators of the core against scalar models on random small inputs, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import dedup, joins, pairs, ranking, windows
from strandline.plans import claims, reliability, reports, retrieval
from strandline.sources import readers, sinks
from strandline.streaming import hits


def test_greedy_dedup_is_the_ordered_fold(spark):
    rng = random.Random(1)
    rows = [(g * 100 + i, *(rng.choice([None, "", *"abcdef"]) if k else f"{g}{rng.choice('uvwxyz')}" for k in range(3)), g) for g in range(12) for i in range(9)]
    rows = [(o, u, t and f"{g}{t}", f and f"{g}{f}", "x") for o, u, t, f, g in rows]
    seen, want = set(), []
    for o, *ks, _ in rows:
        own = {(i, k) for i, k in enumerate(ks) if k}
        if not own & seen:
            seen |= own
            want.append(o)
    df = spark.createDataFrame(rows, "ord long, u string, t string, f string, component string")
    assert sorted(r.ord for r in dedup.greedy_dedup(df, ["u", "t", "f"], "ord").collect()) == want
    single = sorted(r.ord for r in dedup.greedy_dedup(df, ["t"], "ord").collect())
    first = {}
    assert single == [o for o, _, t, _, _ in rows if not t or first.setdefault(t, o) == o]


def test_first_last_and_sets(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (None, "c", 1), (None, "d", 0)], "k int, v string, o int")
    assert {(r.k, r.v) for r in dedup.first_by(df, ["k"], [F.col("o")]).collect()} == {(1, "b"), (None, "d")}
    assert {(r.k, r.v) for r in dedup.last_by(df, ["k"], "o").collect()} == {(1, "a"), (None, "c")}
    assert dedup.same_set(df, df) and not dedup.same_set(df, df.limit(1))
    more = spark.createDataFrame([(1, "z", 9), (2, "z", 9), (2, "y", 9)], "k int, v string, o int")
    assert dedup.added_by_key(df.where("k = 1"), more, "k").count() == 3


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in dedup.components(chain).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 0.2), ("a", 5, None), ("b", 6, 0.71)], "g string, o int, score double")
    top = {(r.g, r.o, r["rank"], r.backfilled) for r in ranking.adaptive_top_k(df, ["g"], 2, "o").collect()}
    assert top == {("a", 1, 1, False), ("a", 2, 2, True), ("b", 6, 1, False)}
    assert ranking.adaptive_top_k(df, ["g"], 5, "o", strict=True).count() == 2
    q = lambda n: [ranking.country_quotas(n, ["CN", "TW", "HK", "US"], ["CN", "TW", "HK"])[c] for c in ("CN", "TW", "HK", "US")]
    assert q(20) == [7, 7, 6, 20] and q(1) == [1, 0, 0, 1] and q(0) == [0, 0, 0, 0]


def test_round_robin_with_reserve(spark):
    df = spark.createDataFrame([("c", "x", 1, 0.9, False), ("c", "x", 2, 0.8, False), ("c", "y", 3, 0.7, True), ("c", "y", 4, 0.95, False)], "country string, lang string, o int, score double, official boolean")
    got = [r.o for r in ranking.round_robin_fill(df, "country", "lang", F.lit(4), 4, "o", F.col("official")).orderBy("turn").collect()]
    assert got == [3, 4, 1, 2]
    assert [r.o for r in ranking.round_robin_fill(df, "country", "lang", F.lit(2), 2, "o").orderBy("turn").collect()] == [4, 1]
    assert ranking.upper_median(df.select("country", F.expr("array(0, 3, 5, 9, 40)").alias("v")).limit(1).select("country", F.explode("v").alias("v")), ["country"], "v").first().median == 9


def test_windows_and_packs(spark):
    w = lambda n: [tuple(x) for x in spark.range(1).select(windows.char_windows(F.lit(n), 900, 120).alias("w")).first().w or []]
    assert w(900) == [(0, 900)] and w(901) == [(0, 900), (780, 901)] and w(0) == []
    text = "ab\n\n" + "x" * 1000 + "\r\nend"
    chunks = windows.line_chunks(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()
    assert all(text[c.start_char : c.end_char] == c.chunk for c in chunks) and len(chunks) == 4
    rng = random.Random(4)
    rows = [(g, i, rng.randint(1, 12)) for g in "abc" for i in range(20)]
    got = {(r.g, r.i): r["pack"] for r in windows.greedy_pack(spark.createDataFrame(rows, "g string, i int, n int"), "g", "i", "n", 10, 3).collect()}
    for g in "abc":
        pack, used, held = 1, 0, 0
        for _, i, n in (r for r in rows if r[0] == g):
            if held and (used + n > 10 or held >= 3):
                pack, used, held = pack + 1, 0, 0
            used, held = used + n, held + 1
            assert got[g, i] == pack


def test_joins(spark):
    reg = spark.createDataFrame([("gov.cn", 1), ("mod.gov.cn", 2), ("b.com", 3)], "domain string, tier int")
    docs = spark.createDataFrame([("1", "https://x.mod.gov.cn/a"), ("2", "https://notb.com/"), ("3", "https://B.com/"), ("4", None)], "doc_id string, url string")
    assert {r.doc_id: r.reg_tier for r in joins.suffix_join(docs, reg, "doc_id").collect()} == {"1": 2, "2": None, "3": 3, "4": None}
    days = spark.sql("select * from values (date'2026-01-31'), (date'2026-03-01'), (date'2027-01-01') t(d)")
    spans = spark.sql("select * from values ('b', date'2026-01-01', date'2026-02-01'), ('a', date'2026-01-15', date'2026-04-01') t(id, s, e)")
    assert {str(r.d): r.id for r in joins.first_interval(days, spans, "d", "s", "e", "id").collect()} == {"2026-01-31": "a", "2026-03-01": "a", "2027-01-01": None}
    quotes = spark.createDataFrame([("d", 1, "cat"), ("d", 2, "dog"), ("d", 3, "c")], "doc_id string, quote_id int, quote string")
    para = spark.createDataFrame([("d", 1, "a cat"), ("d", 2, "cc")], "doc_id string, paragraph_no int, paragraph string")
    assert {r.quote_id: r.paragraph_no for r in joins.containment_join(quotes, para).collect()} == {1: 1, 2: None, 3: None}


def test_pair_sums_follow_the_pairs(spark):
    rng = random.Random(5)
    vecs = [[rng.gauss(0.4, 1) for _ in range(6)] for _ in range(25)]
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in vecs]
    rows = [("e", i, rng.choice("AB"), rng.random(), unit[i]) for i in range(25)]
    df = spark.createDataFrame(rows, "event string, id int, country string, weight double, vec array<double>")
    sim = lambda i, j: min(1.0, max(0.0, sum(x * y for x, y in zip(unit[i], unit[j]))))
    for tile in (4, 1024):
        got = {(r.id, r.partner_country): (r.n, r.sims, r.weight) for r in pairs.pair_sums(df, "event", ((0.5, 0.1), (2.0, 0.9)), tile).collect()}
        for i in range(25):
            for c in "AB":
                other = [j for j in range(25) if j != i and rows[j][2] == c]
                assert got[i, c][0] == len(other) and got[i, c][1] == pytest.approx(sum(sim(i, j) for j in other), abs=1e-4) and got[i, c][2] == pytest.approx(sum(rows[j][3] for j in other))
        assert pairs.similar_pairs(df, "event", 0.3, tile).count() == sum(round(sim(i, j), 6) >= 0.3 for i in range(25) for j in range(i))


def test_country_discount_golden(spark):
    sims = {(0, 1): 0.97, (0, 2): 0.62, (0, 3): 0.71, (1, 2): 0.58, (1, 3): 0.66, (2, 3): 0.74}
    c, w = ["CN", "CN", "TW", "US"], [0.5, 0.4, 0.8, 0.9]
    rows = [("e", i, c[i], c[j], 1, sims[min(i, j), max(i, j)], w[j], 0.0) for i in range(4) for j in range(4) if i != j]
    sums = spark.createDataFrame(rows, "event string, id int, country string, partner_country string, n long, sims double, weight double, weighted double")
    docs = spark.createDataFrame([("e", i, c[i]) for i in range(4)], "event string, id int, country string")
    got = {r.country: (round(r.n_eff, 4), round(r.u, 4)) for r in reliability.country_discount(sums, docs, "event").collect()}
    assert got == {"CN": (1.0152, 0.5076), "TW": (1.0, 1.0), "US": (1.0, 1.0)}


def test_crosscheck_decisions(spark):
    cols = "target_id string, source_id string, claim_id string, subject string, event_date string, certainty string, polarity string, quantifier string, revision_note string, unit string, time_local string, normalized string"
    row = lambda t, s, v, d="2026-01-01", q="exact", rev=None, u="m": (t, s, f"{t}{s}", "x", d, "c", "p", q, rev, u, None, v)
    rows = [row("al", "1", "5 m"), row("al", "2", "5 m", u="km"), row("cf", "1", "5 m"), row("cf", "2", "6 m"), row("one", "1", "5 m"), row("nd", "1", "5 m"), row("nd", "2", "5 m", d=None), row("rv", "1", "5 m", rev="new"), row("q", "1", "5 m", q="least"), row("q", "2", "6 m", q="least"), row("un", "1", None), row("un", "2", "5 m"), row("sg", "1", "5 m"), row("sg", "3", "5 m")]
    groups = spark.createDataFrame([("1", "g1"), ("2", "g2"), ("3", "g1")], "source_id string, publisher_group string")
    targets = spark.createDataFrame([(x,) for x in ("al", "cf", "one", "nd", "rv", "q", "un", "sg", "none")], "id string")
    got = {r.id: (r.status, r.confidence) for r in claims.crosscheck(targets, spark.createDataFrame(rows, cols), groups).collect()}
    assert got == {"al": ("aligned", "medium"), "cf": ("conflict", "low"), "one": ("insufficient", "low"), "nd": ("not_comparable", "low"), "rv": ("revision_review", "low"), "q": ("not_comparable", "low"), "un": ("not_comparable", "low"), "sg": ("aligned", "low"), "none": ("insufficient", "unassessed")}


def test_claim_admission(spark):
    cols = "source_id string, ord int, target_id string, matches_event boolean, event_date string, value_number double, unit string, time_local string, timezone string, paragraph_id string, quote string"
    para = spark.createDataFrame([("s", "p", "The ship is 12 km away at 01:00 KST on 2026-10-10.")], "source_id string, id string, text string")
    rows = [("s", 1, "t", True, None, 12.0, "km", None, None, "p", "ship is 12 km"), ("s", 2, "t", True, None, 13.0, "km", None, None, "p", "ship is 12 km"), ("s", 3, "t", True, None, 12.0, "fl", None, None, "p", "ship is 12 km"), ("s", 4, "zz", True, None, None, None, None, None, "p", "ship"), ("s", 5, "t", True, None, None, None, None, None, "p", "absent"), ("s", 6, "t", True, "2026-10-10", None, None, "01:00", "KST", "p", "at 01:00 KST on 2026-10-10"), ("s", 7, "t", True, None, 12.0, "km", None, None, "p", "12 km")]
    got = {r.ord: (r.reason, r.normalized) for r in claims.admitted(spark.createDataFrame(rows, cols), spark.createDataFrame([("t",)], "id string"), para).collect()}
    assert got == {1: (None, "12000 m"), 2: ("number_not_found", None), 3: ("unit_not_found", None), 4: ("not_asked", None), 5: ("quote_not_found", None), 6: (None, "2026-10-09T16:00:00+00:00")}


def test_tampering(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "x")], "id string, s double, t string")
    back = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("c", 2.0, "x")], "id string, s double, t string")
    assert {tuple(r) for r in reports.tampered(rows, back, "id", ["s", "t"]).collect()} == {("a", "duplicate"), ("b", "missing"), ("c", "unknown")}
    assert reports.tampered(rows, rows, "id", ["s", "t"]).isEmpty()
    s = spark.createDataFrame([("x", 2)], "label string, n long")
    assert reports.consistent_summary(spark.createDataFrame([("x",), ("x",)], "label string"), s, 0.6, 0.7) and not reports.consistent_summary(spark.createDataFrame([("x",)], "label string"), s, 0.6, 0.7)


def test_retrieval_status_and_suppression(spark):
    docs = spark.createDataFrame([("a", "patrol ships"), ("b", "patrol ships"), ("c", "a tax law")], "doc_id string, text string")
    chunks, postings = retrieval.index_terms(docs)
    scores = retrieval.bm25(chunks, postings, spark.createDataFrame([(1, "patrol"), (2, "ships")], "query_no int, term string"))
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("cluster"))
    kept, lost = retrieval.best_hits(scores, hashes, 5)
    assert [r.doc_id for r in kept.collect()] == ["a"] and [r.doc_id for r in lost.collect()] == ["b"]
    none = docs.limit(0)
    assert [retrieval.status(*x) for x in ((docs, kept, docs), (docs, none, docs), (none, none, docs), (none, none, none))] == ["evidence_found", "no_match", "no_eligible_documents", "empty_event"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"output": {"question": "q", "by_country": {"KR": [{"doc_id": "1", "article_text": "body", "published_date": "bad"}]}}}')
    (tmp_path / "d.json").write_text('{"results": [{"url": "https://a.b/c", "content": "short", "country": "US"}, {"url": "https://a.b/d"}]}')
    rows = readers.collection_json(spark, str(tmp_path))
    assert {(r.doc_id, r.country) for r in rows.collect()} == {("1", "KR"), (None, "US"), (None, None)}
    form = {r.text: (r.text_origin, r.content_kind, len(r.warnings)) for r in readers.retrieval_form(rows).collect()}
    assert form == {"body": ("cleaned", "full", 1), "short": ("paragraphs", "snippet", 0)}
    (tmp_path / "s.csv").write_text("date,views\n2026-01-01,5\n2026-01-01,7\nx,1\n")
    assert [(str(r.date), r.views) for r in readers.daily_series(spark, str(tmp_path / "s.csv")).collect()] == [("2026-01-01", 7)]
    old = spark.createDataFrame([("e", "1", 1), ("e", "2", 1)], "event_id string, doc_id string, v int")
    new = spark.createDataFrame([("e", "2", 2), ("e", "3", 2)], "event_id string, doc_id string, v int")
    assert {(r.doc_id, r.v) for r in sinks.upsert(old, new, ["event_id", "doc_id"], "v").collect()} == {("1", 1), ("2", 2), ("3", 2)}
    assert sinks.ingest(old, new, 3).count() == 3
    with pytest.raises(sinks.Conflict):
        sinks.ingest(old, new, 2)
    log = sinks.append_version(spark.createDataFrame([], "id string, version int"), spark.createDataFrame([("a",)], "id string"), "id", 0)
    with pytest.raises(sinks.Conflict):
        sinks.append_version(log, spark.createDataFrame([("a",)], "id string"), "id", 0)
    work = sinks.with_digest(old, ["doc_id", "v"], "m")
    done, pending = sinks.cached(work, work.limit(1).select("digest", F.lit("r").alias("result")))
    assert done.count() == 1 and pending.count() == 1
    with pytest.raises(sinks.Conflict):
        sinks.unique_export(old, ["v"], "v")
    md = sinks.markdown_report(spark.createDataFrame([("r", 2, "B", "y", []), ("r", 1, "A", "x", ["S1", "S2"])], "report_id string, ord int, heading string, body string, sources array<string>"))
    assert md.first().markdown == "## A\n\nx\n\n[S1] [S2]\n\n## B\n\ny"


def test_validated_json(spark):
    rows = spark.createDataFrame([(1, '{"n": 3, "kind": "a"}'), (2, "not json"), (3, '{"n": -1, "kind": "a"}'), (4, '{"kind": "a"}'), (5, '{"n": 1, "kind": "z"}'), (6, None)], "id int, body string")
    good, bad = readers.validated_json(rows, "body", "n int, kind string", {"count": F.col("parsed.n") >= 0, "kind": F.col("parsed.kind").isin("a", "b")})
    assert [r.id for r in good.collect()] == [1] and {r.id: r.problem for r in bad.collect()} == {2: "unreadable", 3: "count", 4: "count", 5: "kind", 6: "unreadable"}


def test_stream_upsert_and_windows(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2026-01-01 00:00:00', 1), ('a', timestamp'2026-01-01 01:00:00', 2), ('b', timestamp'2026-01-02 00:00:00', 3) t(doc_id, at, v)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = hits.hit_stream(spark, str(tmp_path / "in"), rows)
    target = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(hits.upsert_batches(target, ["doc_id"], "at")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.read.parquet(hits.latest_version(spark, target))
    assert {(r.doc_id, r.v) for r in got.collect()} == {("a", 2), ("b", 3)}
    assert {(str(r.start)[:10], r.n) for r in hits.windowed(rows, "at", []).collect()} == {("2026-01-01", 2), ("2026-01-02", 1)}
    assert hits.fresh(stream, ["doc_id"], "at").isStreaming


def test_stream_upserts_touch_their_buckets_only(spark, tmp_path):
    target = str(tmp_path / "table")
    write = hits.upsert_batches(target, ["k"], "at", buckets=4)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, at int, v string")
    assert hits.current(spark, target) is None
    state = {}
    for number, rows in enumerate([[(i, 1, "a") for i in range(20)], [(1, 2, "b"), (30, 1, "c")], [(1, 1, "late"), (2, 5, "d")], [(1, 3, "e")], [(1, 4, "f")]]):
        for _ in range(2):  # a batch run again gives the same table
            write(frame(*rows), number)
        for k, at, v in rows:
            if at >= state.get(k, (0, ""))[0]:
                state[k] = (at, v)
        assert {r.k: (r.at, r.v) for r in hits.current(spark, target).collect()} == state
    folders = hits._versions(spark, target)
    assert len(folders) == 4 and max(len(f) for f in folders.values()) <= 3


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "rel_scores" in entry.queries()
