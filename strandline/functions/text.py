"""Text functions as Column expressions; only Unicode normal forms need an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions import fixed

CJK = r"぀-ヿ㐀-鿿가-힯"


@F.pandas_udf(StringType())
def nfkc_fold(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which the JVM functions lack."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_title(title: Column) -> Column:
    """Lower case without a publisher's suffix and without marks, single spaces."""
    low = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), fixed.PUBLISHER_SUFFIX, "")
    return squeezed(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", ""))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the letters and digits in lower case; empty for a text without any."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]", "")
    return F.when(bare == "", F.lit("")).otherwise(F.sha2(bare, 256))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space squeezed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def comparable(text: Column) -> Column:
    """NFKC, folded, without white space: equality up to width and spacing."""
    return F.regexp_replace(nfkc_fold(text), r"(?U)\s+", "")


def terms(folded: Column) -> Column:
    """Retrieval terms of a folded text: words over one character, character bigrams of CJK words."""
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    single = lambda w: F.when(F.length(w) > 1, F.array(w)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"[{CJK}]"), pairs(w)).otherwise(single(w))))


def relevance_terms(text: Column, han: bool = False) -> Column:
    """Distinct Hangul bigrams and Latin words over one character; with ``han`` Han and kana bigrams too."""
    scripts = "가-힣" + ("㐀-鿿぀-ヿ" if han else "")
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"[{scripts}]+"), F.lit(0))
    bigrams = F.flatten(F.transform(F.filter(runs, lambda w: F.length(w) > 1), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.array_distinct(F.concat(bigrams, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))))


def text_cost(text: Column) -> Column:
    """Length plus twice the CJK characters: what a text costs a model."""
    return F.length(text) + 2 * F.length(F.regexp_replace(text, f"[^{CJK}]", ""))


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def name_regex(names: list[str]) -> str:
    """One pattern, for the JVM and for Python, of the folded names: Latin ones as whole words, others anywhere."""
    parts = []
    for name in sorted({fold(n).strip() for n in names} - {""}, key=len, reverse=True):
        if re.fullmatch("[a-z ]+", name):
            parts.append(f"(?<![a-z]){name}{fixed.NAME_ENDINGS.get(name, '')}{'?' if name in fixed.NAME_ENDINGS else ''}(?![a-z])")
        else:
            parts.append(re.sub(r"[^\w ]", lambda m: "\\" + m.group(), name))
    return "|".join(parts) or "(?!)"


def contains_name(folded: Column, *names: str) -> Column:
    """Whether a folded text holds one of the names."""
    return folded.rlike(name_regex(list(names)))


def name_variants(group: list[str]) -> list[str]:
    """The names of a group, then the other names of the same entities, then those without qualifiers, each once."""
    families = {}
    for canonical, others in fixed.ENTITY_VARIANTS.items():
        for name in (canonical, *others):
            families.setdefault(fold(name), []).append((canonical, *others))
    related = [name for g in group for family in families.get(fold(g), ()) for name in family]
    bare = [g.removesuffix(q) for g in group for q in fixed.QUALIFIERS if g.endswith(q)]
    return [n for n in dict.fromkeys([*group, *related, *bare]) if n.strip()]


def attribution(text: Column) -> Column:
    """The source a text names in its first 1000 characters, if of 2 to 40 characters."""
    head = F.substring(text, 1, 1000)
    found = [F.trim(F.regexp_extract(head, p, 1)) for p in fixed.ATTRIBUTIONS]
    return F.coalesce(*[F.when(F.length(f).between(2, 40), f) for f in found])


def without_access_notices(text: Column) -> Column:
    """The text without sentences that only ask to subscribe or log in."""
    return F.regexp_replace(text, rf"(?im)(?:^|(?<=[.!?]))\s*(?:{fixed.ACCESS_NOTICE})[.!?]*(?=\s|$)", "")


def claim_rejection(text: Column) -> Column:
    """Why a quote is no claim (first reason that holds), null if it may be one."""
    seen = F.trim(F.regexp_replace(text, fixed.TRANSCRIPT_TIME, ""))
    markers = F.size(F.filter(F.array(*map(F.lit, fixed.MENU_MARKERS)), lambda m: F.contains(seen, m)))
    reasons = {
        "question_without_assertion": F.regexp_replace(seen, "[」』”\"']+$", "").rlike("[?？]$"),
        "unfinished_introductory_clause": seen.rlike(fixed.UNFINISHED_CLAUSE),
        "deictic_answer_without_assertion": seen.rlike(fixed.DEICTIC_QUESTION) & seen.rlike(fixed.DEICTIC_ANSWER),
        "navigation_or_download_text": seen.rlike(f"(?iU){fixed.MENU_START}") | (markers >= 2),
        "section_heading": seen.rlike(fixed.SECTION_HEADING) & (F.length(seen) < 120) & ~seen.rlike(fixed.PREDICATE_END),
    }
    return F.coalesce(*[F.when(holds, reason) for reason, holds in reasons.items()])


def is_substantive(quote: Column) -> Column:
    """Whether a quote is more than a link, a piece of an address or a list of references."""
    q = F.trim(quote)
    return ~F.exists(F.array(*[F.lit(f"(?i){p}") for p in (fixed.LINK_ONLY, fixed.ADDRESS_PIECE, fixed.FOOTER_ADDRESS, fixed.BROKEN_ADDRESS, fixed.LINK_LIST)]), lambda p: F.regexp_like(q, p))


def quotes(text: Column) -> Column:
    """The sentences of a text as an array: each line cut after its final marks, but not after the period of an
    abbreviation or of single letters that follow each other; what is left of a line is a sentence."""
    guarded, cut = "\u0002", "\u0001"
    out = F.translate(text, guarded + cut, "  ")
    out = F.regexp_replace(out, r"(?iU)\b([a-z])\.(?=\s*[a-z]\.)", f"$1{guarded}")
    out = F.regexp_replace(out, rf"(?iU)({guarded}\s*[a-z])\.", f"$1{guarded}")
    out = F.regexp_replace(out, rf"(?iU)\b({'|'.join(fixed.ABBREVIATIONS)})\.", f"$1{guarded}")
    out = F.regexp_replace(F.regexp_replace(out, f"({fixed.QUOTE_MARKS})", f"$1{cut}"), r"[\r\n]+", cut)
    tidy = lambda x: F.regexp_replace(F.translate(x, guarded, "."), r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(F.split(out, cut), tidy), lambda x: x != "")


def review_flags(raw: Column, cleaned: Column) -> Column:
    """(paywall, review): a page that asks for a subscription and has little text; one to be looked at."""
    little = F.length(F.coalesce(cleaned, F.lit("")))
    asks = F.exists(F.array(*map(F.lit, fixed.PAYWALL)), lambda w: F.contains(F.lower(F.coalesce(raw, F.lit(""))), w))
    paywall = asks & (little < 400)
    return F.struct(paywall.alias("paywall"), (paywall | (little < 200)).alias("review"))


def question_flags(question: Column) -> Column:
    """What a question asks for, as a struct of booleans."""
    compact = F.regexp_replace(question, r"(?U)\s+", "")
    return F.struct(*[compact.rlike(words).alias(name) for name, words in fixed.QUESTION_FLAGS.items()])


def script_shares(text: Column) -> Column:
    """(letters, hangul, kana, han, latin, devanagari, arabic): letters of a text and how many of each script."""
    letters = r"\p{L}"
    scripts = {"hangul": r"\p{IsHangul}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "latin": r"\p{IsLatin}", "devanagari": r"\p{IsDevanagari}", "arabic": r"\p{IsArabic}"}
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(count(letters).alias("letters"), *[count(f"[{p}&&{letters}]").alias(n) for n, p in scripts.items()])


#: Frequent characters that only one of the two Chinese scripts has.
SIMPLIFIED_ONLY = "们这国来时对发经过还进说边关动现会员业东车马长门问间见让认议论讯识试该详调谈请课贸费质资赛软达运连远适选递际陆险随难顺须预领频题风飞饭馆驻验鱼鸟龙军报护达岛湾击审"
TRADITIONAL_ONLY = "們這國來時對發經過還進說邊關動現會員業東車馬長門問間見讓認議論訊識試該詳調談請課貿費質資賽軟達運連遠適選遞際陸險隨難順須預領頻題風飛飯館駐驗魚鳥龍軍報護達島灣擊審"


def body_language(text: Column, least_letters: int = 40, least_share: float = 0.8) -> Column:
    """(language, confidence) by the scripts of a whole body; ``unknown`` for few letters or no script in the lead.

    Kana makes Han Japanese, Hangul makes it Korean; Chinese is told apart by characters only one of
    its scripts has. Latin counts as English and Arabic script as Urdu, the languages handled.
    """
    body = F.coalesce(text, F.lit(""))
    only = lambda chars: F.regexp_count(body, F.lit(f"[{chars}]"))
    counted = F.struct(script_shares(body).alias("n"), only(SIMPLIFIED_ONLY).alias("simplified"), only(TRADITIONAL_ONLY).alias("traditional"))

    def told(c: Column) -> Column:
        n = c["n"]
        kana, hangul, han = n["kana"], n["hangul"], n["han"]
        east = F.when(hangul >= F.greatest(kana, han), "ko").when((kana > 0) & (kana * 10 >= han), "ja").when(c["traditional"] > c["simplified"], "zh-Hant").otherwise("zh")
        letters = F.when(east == "ko", hangul + F.when(hangul >= han, han).otherwise(0)).when(east == "ja", kana + han).otherwise(han)
        ways = [F.struct(k.alias("k"), name.alias("l")) for k, name in ((letters, east), (n["latin"], F.lit("en")), (n["devanagari"], F.lit("hi")), (n["arabic"], F.lit("ur")))]
        return F.struct(F.greatest(*ways).alias("best"), n["letters"].alias("letters"))

    def judged(c: Column) -> Column:
        confidence = F.when(c["letters"] >= least_letters, F.round(c["best"]["k"] / c["letters"], 4)).otherwise(0.0)
        return F.struct(F.when(confidence >= least_share, c["best"]["l"]).otherwise("unknown").alias("language"), confidence.alias("confidence"))

    # The lambdas bind the counts, so that each pattern runs over a body once.
    return F.element_at(F.transform(F.transform(F.array(counted), told), judged), 1)


def body_display(text: Column, limit: int = 1600) -> Column:
    """Plain text for display: mark-up stripped, repeated paragraphs once, cut at ``limit`` with an ellipsis."""
    plain = F.regexp_replace(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^[#>*\-\s]+|[*_`]", "")
    once = F.array_join(F.array_distinct(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")), "\n\n")
    return F.when(F.length(once) > limit, F.concat(F.substring(once, 1, limit), F.lit("…"))).otherwise(once)


def strip_markup(page: Column) -> Column:
    """Text of an HTML or Markdown page: scripts and styles out, tags to line breaks, links to their words."""
    out = F.regexp_replace(page, r"(?is)<(script|style|nav|header|footer|aside|noscript|iframe|svg)\b.*?</\1>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "\n")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?m)^\s*[*+\-]\s*\[[^\]]*\]\([^)]*\)\s*$", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(out, r"\n\s*\n+", "\n"))
