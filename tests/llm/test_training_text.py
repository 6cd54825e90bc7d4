"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.llm import p1_repeated_lines as p1
from strandline.llm import p2_oversized as p2
from strandline.llm import p3_language as p3
from strandline.llm import p4_sentences as p4
from strandline.llm import p5_contributor_cap as p5
from strandline.llm import p6_truncated as p6
from strandline.llm import p7_boilerplate as p7
from strandline.llm import p8_packing as p8
from strandline.llm import p9_leakage as p9
from strandline.llm import p10_reading_level as p10

DOCS = "doc_id string, text string, raw_content string, title string, paragraphs array<struct<id: string, text: string>>, source string, line string, drop string, n int"
SOURCES = "doc_id string, source_name string, source string"


def docs(spark, rows):
    """Rows (doc_id, text[, raw_content]) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "Headline of it", None, "x", "y", "z", 1) for r in rows], DOCS)


def sources(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SOURCES)


# --- problem 1


def test_p1_against_brute_force(spark):
    rng = random.Random(1)
    lines = [f"Share this {'abcdefgh'[i]}!" for i in range(8)] + ["12 34", "", "--"]
    rows, names = [], []
    for d in range(60):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 5))] + [f"unique words {'x' * d}"]
        rows.append((f"d{d}", "\n".join(own)))
        names.append((f"d{d}", rng.choice(["Big", " big ", "BIG", "Small"])))
    rows += [rows[0], (None, "Share this a!"), ("dn", None), ("de", "")]
    got = {tuple(r) for r in p1.repeated_lines(docs(spark, rows), sources(spark, names)).collect()}
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    of, by = {d: n.strip().lower() for d, n in names}, {}
    texts = dict(r for r in rows if r[0] and r[1] is not None)
    for d, t in texts.items():
        for x in {key(x) for x in t.split("\n")} - {""}:
            by.setdefault((of.get(d), x), set()).add(d)
    size = {s: sum(of.get(d) == s for d in texts) for s in of.values()}
    hit = {k for k, v in by.items() if k[0] and len(v) >= 4 and len(v) * 20 >= size[k[0]]}
    want = {(d, i) for d, t in texts.items() for i, x in enumerate(t.split("\n"), 1) if (of.get(d), key(x)) in hit}
    assert got == want and want
    clean = {r.doc_id: r.text for r in p1.without_repeated_lines(docs(spark, rows), spark.createDataFrame(sorted(got), "doc_id string, line_no int")).collect()}
    assert clean["d1"] == "\n".join(x for i, x in enumerate(texts["d1"].split("\n"), 1) if ("d1", i) not in got)


def test_p1_hot_line_beyond_the_summary(spark):
    rows = [(f"d{i}", "Subscribe now\n" + "\n".join(f"only {chr(97 + j)}{'q' * i}" for j in range(9))) for i in range(120)]
    got = p1.repeated_lines(docs(spark, rows), sources(spark, [(r[0], "One") for r in rows])).collect()
    assert {tuple(r) for r in got} == {(f"d{i}", 1) for i in range(120)}


# --- problem 2


def test_p2_pieces_hold_the_limits():
    rng = random.Random(2)
    for n in (901, 1500, 5000):
        for alphabet in ("ab .", "ab", "漢字。", "a, b. c　"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            cut, parts = p2.pieces(text)
            assert cut == ("forced" if re.search(r"[^\s.,。　]{901}", text) else "natural")
            assert parts[0][0] == 0 and parts[-1][1] == n and all(b - a <= 900 for a, b, _ in parts)
            assert all(x[1] - y[0] == 120 for x, y in zip(parts, parts[1:]))


def test_p2_range_maximum_breaks_ties_rightward():
    values = p2.np.array([random.Random(3).randint(0, 4) for _ in range(200)])
    table = p2.sparse_table(values)
    for a in range(0, 200, 7):
        for b in range(a, 200, 5):
            part = values[a : b + 1]
            assert p2.strongest(table, values, a, b) == a + max(i for i, v in enumerate(part) if v == part.max())


def test_p2_items(spark):
    long = "word " * 300
    df = spark.createDataFrame([("a", f"short\n{long}", [("1", long), ("2", None)], 1), ("a", f"short\n{long}", [("1", long), ("2", None)], 1), ("b", None, None, 1), ("c", "", [], 1), (None, long, None, 1)], "doc_id string, text string, paragraphs array<struct<id: string, text: string>>, item int")
    got = p2.split_oversized(df).select("doc_id", "field", "item_no", "cut").distinct().collect()
    assert {tuple(r) for r in got} == {("a", "text", 2, "natural"), ("a", "paragraphs", 1, "natural")}


# --- problem 3

SAMPLES = {
    "en": "The northern command said that two ships had left the bay before the storm reached the coast.",
    "ko": "북부사령부는 폭풍이 해안에 닿기 전에 배 두 척이 만을 떠났다고 밝혔다. 주민들은 소리를 들었다.",
    "zh": "北部指挥部表示，风暴到达海岸之前，两艘船已经离开海湾。居民说听到了发动机的声音。发言人对记者说。",
    "zh-Hant": "北部指揮部表示，風暴到達海岸之前，兩艘船已經離開海灣。居民說聽到了發動機的聲音。發言人對記者說。",
    "ja": "北部司令部は、嵐が海岸に達する前に二隻の船が湾を離れたと発表した。住民は音を聞いたと話している。",
    "hi": "उत्तरी कमान ने कहा कि तूफान के तट तक पहुंचने से पहले दो जहाज खाड़ी से निकल गए।",
    "ur": "شمالی کمان نے کہا کہ طوفان کے ساحل تک پہنچنے سے پہلے دو جہاز خلیج سے نکل گئے۔",
}


def test_p3_labels_and_segments(spark):
    model = p3.train(spark.createDataFrame(list(SAMPLES.items()), "lang string, text string"))
    rows = [(k, v + "\n" + v) for k, v in SAMPLES.items()]
    rows += [("mix", SAMPLES["en"] + "\n" + SAMPLES["en"] + "\n" + SAMPLES["ja"] + "\nhttps://www.a.example/" + "x" * 60), ("none", "123 456"), ("empty", ""), ("null", None), rows[0]]
    found = p3.languages(docs(spark, rows), model)
    got = {(r.doc_id, r.seg_no): r.lang for r in found.collect()}
    assert all(got[k, 0] == k for k in SAMPLES)
    assert {k for k in got if k[1]} == {("mix", 3)} and got["mix", 3] == "ja" and got["none", 0] is None and got["empty", 0] is None
    labels = [("en", "EN_us"), ("ko", "kr"), ("zh", "zh-Hans-CN"), ("zh-Hant", "zh"), ("ja", "jpn"), ("hi", " "), ("ur", None), ("mix", "eng")]
    wrong = p3.mislabelled(found, spark.createDataFrame(labels, "doc_id string, language string")).collect()
    assert {tuple(r) for r in wrong} == {("ko", 0, "ko"), ("zh-Hant", 0, "zh-Hant"), ("hi", 0, "hi"), ("ur", 0, "ur"), ("mix", 3, "ja")}


# --- problem 4


def ends(text):
    spans = p4.sentence_ends([text], p4.edges_of([]))[0]
    return [text[a:b] for a, b in spans]


@pytest.mark.parametrize(
    "sentences",
    [
        ["The Lt. Cmdr. on duty met U.S. crews at 13.1 knots.", "It was over."],
        ["Items incl. fuel, rope, etc. were sent.", "See www.a.example/p/1.html now!"],
        ["“We saw nothing. We heard nothing,” an analyst said.", "An analyst replied: “Ask the port.”", "It ended."],
        ["「航路は閉鎖された。直ちに戻れ。」と通信員は述べた。", "（訓練は始まった。）", "実際には、終わった。"],
        ["“航道已经关闭。请立即返航。”发言人说。", "引航员反问：“谁下的命令？”"],
        ["“누가 명령했나?”라는 질문에 부국장은 답하지 않았다.", "보고서 No. 64는 보관 중이다."],
        ["“حکم کس نے دیا؟” اس سوال پر افسر خاموش رہے۔", "ہوا ٹھنڈی ہے۔"],
        ["रिपोर्ट क्र. 6 कार्यालय के पास है।", "समुद्र शांत था।"],
    ],
)
def test_p4_sentences(sentences):
    joiner = "" if re.search(r"[぀-ヿ]|^“航", sentences[0]) else " "
    assert ends(joiner.join(sentences)) == sentences


def test_p4_lines_and_marks():
    assert ends("Heading\n\n- item one\nUnfinished text [+799 chars]") == ["Heading", "- item one", "Unfinished text [+799 chars]"]
    assert ends("Done. |") == ["Done. |"] and ends("--\n***") == [] and ends("") == []


def test_p4_table(spark):
    rows = [("t", "a", "One. Two."), ("t", "a", "One. Two."), ("t", "b", None), ("t", "c", " "), ("t", None, "x")]
    texts = spark.createDataFrame(rows, "tbl string, doc_id string, text string")
    got = p4.sentences(texts, p4.learn_edges(texts)).select("doc_id", "end_char").collect()
    assert {tuple(r) for r in got} == {("a", 4), ("a", 9)}


def test_p4_evidence_does_not_fade_with_the_corpus():
    rng = random.Random(4)
    known = ["Nobody answered from the northern pier. Later reports named another captain."] * 5
    noise = [" ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=7)) for _ in range(5_000)) for _ in range(30)]
    (counted,) = p4._count(iter([pd.DataFrame({"text": known + noise})]))
    scores, _ = p4._gap_scores("from the northern pier Later reports named", p4.edges_of(list(counted["counts"])))
    assert scores[22] == scores.max() > 12


# --- problem 5


def test_p5_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"d{i % 180:03}", rng.choice(["US", "us ", None, " ", "KR"]) if i < 180 else None, rng.choice(["A", " a", "B", "C"]), rng.choice([None, 0.1, 0.5, 0.5, 0.9, float("nan")]), 1, 2) for i in range(180)]
    rows += [(d, c, s, x, 1, 2) for d, c, s, x, *_ in rows[:20]] + [(None, "US", "A", 1.0, 1, 2)]
    got = {r.doc_id for r in p5.capped(spark.createDataFrame(rows, "doc_id string, country string, source_name string, score double, bin int, keep int"), bins=3).where("not keep").collect()}
    best = {}
    for d, c, s, x, *_ in rows:
        if d:
            k = ((c or "").strip().upper() or "UNKNOWN", s.strip().lower(), d)
            best[k] = max(best.get(k, 0), 0 if x is None or x != x else x)
    want = set()
    for c in {k[0] for k in best}:
        n = len({k[2] for k in best if k[0] == c})
        for s in {k[1] for k in best if k[0] == c}:
            order = sorted((k[2] for k in best if k[:2] == (c, s)), key=lambda d: (-best[c, s, d], d))
            want.update(order[max(1, n * 15 // 100) :])
    assert got == want and want


# --- problem 6


def test_p6_cuts(spark):
    whole = ["The ship left the harbor before dawn.", "Crews repaired the buoy near the harbor.", "Reporting by the sea desk"]
    rows = [(f"w{i}", "\n".join(whole)) for i in range(12)]
    rows += [("cut", whole[0] + "\n" + "Crews repaired the bu"), ("mark", whole[0] + " Crews [+99 chars]"), ("dots", "The ship left the…"), ("full", whole[1] + "\n" + whole[0]), ("null", None), ("empty", ""), ("full", whole[1] + "\n" + whole[0])]
    verdicts = p6.truncated(docs(spark, rows))
    got = {r.doc_id for r in verdicts.where("cut").collect()}
    assert got == {"cut", "mark", "dots"}
    rates = {r.source: (r.docs, r.cut_docs) for r in p6.truncation_rates(verdicts, sources(spark, [("cut", "S"), ("full", " s "), ("mark", None)])).collect()}
    assert rates == {"s": (2, 1)}


def test_p6_whole_units_are_counted_by_their_own_key(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=7))
    heads = [f"{word()} {word()} {word()}" for _ in range(40)]
    rows = [(f"h{i}-{j}", f"Noted.\n{h}") for i, h in enumerate(heads) for j in range(2)]
    rows += [(f"n{i}", " ".join(word() for _ in range(20_000)) + ".") for i in range(30)]
    cut = p6.truncated(docs(spark, rows)).where("cut")
    assert [r.doc_id for r in cut.collect()] == []


# --- problem 7


def test_p7_suffix_array_and_runs():
    ids = p7.np.array([3, 1, 2, 3, 1, 2, 9, 1, 2])
    order, common = p7.suffix_array(ids)
    plain = sorted(range(len(ids)), key=lambda i: list(ids[i:]))
    assert list(order) == plain and common[1] == 2
    pages = [[["home"], ["a", "b"]], [["home"], ["read", ":", "x"]], [["a", "c"], ["read", ":", "y"], ["home"]]]
    got = {(k, tuple(w), tuple(p)) for k, w, p in p7.repeated_runs(pages)}
    assert got == {("line", ("home",), (0, 1, 2)), ("label", ("read", ":"), (1, 2))}


def test_p7_pages(spark):
    rows, names = [], []
    for i in range(40):
        word = chr(97 + i % 26) + chr(97 + i // 26)
        body = [f"Paragraph {word} of the story.", f"Second {word} part of it."]
        raw = ["Home", "# Headline of it", *[f"<p>{b}</p>" for b in body], f"Related: teaser {word} here", "Share this page", "Most read", f"Other story {word}", "Terms of use"]
        rows.append((f"d{i}", "\n".join([*body, "Share this page"]), "\n".join(raw)))
        names.append((f"d{i}", "Host"))
    rows += [("null", None, None), ("empty", "", ""), rows[0]]
    lines = p7.page_lines(docs(spark, rows), sources(spark, names))
    got = {(r.field, r.line_no) for r in lines.where("not main and doc_id = 'd3'").collect()}
    assert got == {("text", 3), *(("raw_content", n) for n in (1, 5, 6, 7, 8, 9))}
    assert lines.where("doc_id in ('null', 'empty')").isEmpty()


# --- problem 8


def test_p8_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(20):
        hist = p8.np.zeros(13, int)
        for _ in range(9):
            hist[rng.randint(1, 12)] += rng.randint(1, 5)
        sizes = [int(s) for s in p8.np.flatnonzero(hist)]
        pad = lambda cuts: sum(hist[s] * (min(c for c in cuts if c >= s) - s) for s in sizes)
        from itertools import combinations

        k = min(3, len(sizes))
        best = min(pad({*c, sizes[-1]}) for c in combinations(sizes, k - 1))
        assert pad([int(x) for x in p8.boundaries(hist, 3)]) == best


def test_p8_containers(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(1, 300), 1) for i in range(300)] + [(900, "word " * 5000, 1), (901, None, 1), (902, "", 1), (0, "again", 1)][:3]
    packed = p8.containers(spark.createDataFrame(rows, "doc_id bigint, text string, bucket int"), capacity=512, buckets=16).toPandas()
    per = packed.groupby("container_id").n_tokens.sum()
    assert per.max() <= 512 and set(per.index) == set(range(len(per)))
    assert packed.groupby("doc_id").size().drop(900).eq(1).all() and per.sum() / (512 * len(per)) > 0.9
    one = packed[packed.doc_id == 900].sort_values("piece_no")
    assert list(one.start_token) == [512 * i for i in range(len(one))] and one.n_tokens.iloc[:-1].eq(512).all()


# --- problem 9


def test_p9_against_brute_force(spark):
    rng = random.Random(10)
    words = ["ship", "bay", "storm", "left", "north", "two", "ﬁve", "港", "灣", "जहाज"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))), 1) for i in range(25)] + [(90, None, 1), (91, "...", 1), (92, "a", 1)]
    corpus = []
    for d in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        if d % 3 == 0:
            src = items[d % 25][1].split()
            a = rng.randint(0, len(src) - 1)
            base[3:3] = [w.upper() + "," for w in src[a:]]
        corpus.append((d, " ".join(base), 1))
    corpus += [(500, None, 1), (501, "", 1), corpus[0]]
    got = {(r.doc_id, r.item_id) for r in p9.leaks(spark.createDataFrame(corpus, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string, doc_id int")).collect()}
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()) if unicodedata.category(c)[0] in "LN")
    want = set()
    for i, t, _ in items:
        q = bare(t)
        h = (len(q) + 1) // 2
        subs = {q[a : a + h] for a in range(len(q) - h + 1)} if h else set()
        want |= {(d, i) for d, x, _ in corpus if any(s in bare(x) for s in subs)}
    assert got == want and want


# --- problem 10


def test_p10_levels(spark):
    rng = random.Random(11)
    simple = ["The sea is calm.", "He went home.", "The boat is big.", "We had tea."]
    press = ["The port authority said that ferry services resumed after the storm warning was lifted.", "Officials asked the office to explain why the exercise had not been announced."]
    hard = ["Notwithstanding the verification regimes invoked by the directorate, the memorandum circumscribes the discretion of the tribunal, whose jurisdiction remains contested.", "Such susceptibility necessitates contemporaneous documentation of escalatory signalling under the proportionality doctrine."]
    rows = [(i, "en", lv, " ".join(rng.choice(pool) for _ in range(8))) for i, (lv, pool) in enumerate([(1, simple), (2, press), (3, hard)] * 8)]
    grader = p10.train(spark.createDataFrame(rows, "item_id bigint, lang string, reading_level int, text string"))
    assert grader.accuracy >= 0.95
    texts = [(1, " ".join(simple * 8), None, 0), (2, " ".join(press * 4), 400, 0), (3, " ".join(hard * 4), 400, 0), (4, "short", 5, 0), (5, None, 900, 0), (6, "1 2 3", 400, 0)]
    got = {r.doc_id: r.reading_level for r in p10.reading_levels(spark.createDataFrame(texts, "doc_id bigint, text string, n_chars bigint, score int"), grader).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 1, 2: 2, 3: 3} and set(got) == {1, 2, 3, 6}


# --- all: empty tables


def test_empty_tables(spark):
    none, src = docs(spark, []), sources(spark, [])
    assert p1.repeated_lines(none, src).isEmpty() and p2.split_oversized(none).isEmpty()
    assert p3.languages(none, p3.fit([])).isEmpty()
    texts = none.select(F.lit("t").alias("tbl"), "doc_id", "text")
    assert p4.sentences(texts, p4.learn_edges(texts)).isEmpty()
    assert p5.capped(spark.createDataFrame([], "doc_id string, country string, source_name string, score double")).isEmpty()
    assert p6.truncated(none).isEmpty() and p7.page_lines(none, src).isEmpty()
    empty = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert p8.containers(empty).isEmpty()
    assert p9.leaks(empty, spark.createDataFrame([], "item_id bigint, text string")).isEmpty()


def test_very_long_texts(spark):
    long = ("The ship left the bay. " * 20_000).strip()
    rows = [("a", long), ("b", "界" * 200_000)]
    assert p2.split_oversized(docs(spark, rows)).count() > 500
    texts = docs(spark, rows).select(F.lit("t").alias("tbl"), "doc_id", "text")
    assert p4.sentences(texts, p4.learn_edges(texts)).where("doc_id = 'a'").count() == 20_000
    assert p3.languages(docs(spark, rows), p3.fit(list(SAMPLES.items()))).where("seg_no = 0").count() == 2
    assert p6.truncated(docs(spark, rows)).count() == 2


def test_p1_summaries_sent_early_lose_no_line(spark, monkeypatch):
    rng = random.Random(41)
    rows = [(f"d{i}", "\n".join(["Share this page", *(f"line {chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}{chr(97 + i % 26)}" for _ in range(20))])) for i in range(60)]
    names = [(f"d{i}", f"S{i % 7}") for i in range(60)]
    plain = {tuple(r) for r in p1.repeated_lines(docs(spark, rows), sources(spark, names)).collect()}
    monkeypatch.setattr(p1, "HELD", 5)
    monkeypatch.setattr(p1, "BROADCAST_ROWS", 1)
    assert {tuple(r) for r in p1.repeated_lines(docs(spark, rows), sources(spark, names)).collect()} == plain and len(plain) >= 60


def test_p8_boundaries_of_many_lengths():
    rng = p8.np.random.default_rng(3)
    hist = p8.np.zeros(120, int)
    hist[1:] = rng.integers(0, 4, 119)
    sizes = p8.np.flatnonzero(hist)
    cost = lambda i, j: int((hist[sizes[i:j]] * (sizes[j - 1] - sizes[i:j])).sum())
    for buckets in (1, 2, 7):
        best = [0] + [10**12] * len(sizes)
        for _ in range(buckets):
            best = [0] + [min(best[i] + cost(i, j) for i in range(j)) for j in range(1, len(sizes) + 1)]
        cuts = p8.boundaries(hist, buckets)
        edges = [0, *(p8.np.searchsorted(sizes, cuts) + 1).tolist()]
        assert len(cuts) == buckets and sum(cost(a, b) for a, b in zip(edges, edges[1:])) == best[-1]


def test_p2_table_has_no_more_levels_than_windows_need():
    values = p2.np.array([random.Random(4).randint(0, 5) for _ in range(5000)])
    table = p2.sparse_table(values, 901)
    assert len(table) == 10 and table[0].dtype == p2.np.int32
    for low in range(0, 4000, 137):
        at = p2.strongest(table, values, low, low + 900)
        assert values[at] == values[low : low + 901].max() and (values[at + 1 : low + 901] < values[at]).all()
