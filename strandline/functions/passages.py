"""Text functions that need more than expressions: splitters, snippets, topic evidence, quote restoration.

Each is a plain function on strings with an Arrow wrapper, so that tests and workers share it.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from strandline.functions import fixed
from strandline.functions.text import fold, name_regex, name_variants

#: Paragraph limits and sentence ends.
SHORTEST, LONGEST = 15, 400
SENTENCE = re.compile(r"(?<=[.!?。！？۔؟।॥])\s+")
MARKUP_LINE = re.compile(r"^(?:!\[.*?\]\(.*?\)|\s*[*-]?\s*\*{0,2}\[.*?\]\(.*?\)\*{0,2}\s*|#{1,6}\s+.*)$")
NOISE = [re.compile(p) for p in fixed.SNIPPET_NOISE]
WINDOW, STRIDE = 1500, 750


def _joined(units: list[str], limit: int) -> list[str]:
    """Neighbouring units joined by blanks as long as the limit allows."""
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) + 1 + len(unit) <= limit:
            out[-1] += " " + unit
        else:
            out.append(unit)
    return out


def paragraphs(text: str, shortest: int = SHORTEST, longest: int = LONGEST) -> list[str]:
    """Lines as paragraphs, without mark-up lines; long ones cut between sentences, then between words."""
    out = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        if MARKUP_LINE.match(line):
            continue
        units = [line]
        if len(line) > longest:
            units = [u for s in SENTENCE.split(line) if s.strip() for u in ([s.strip()] if len(s) <= longest else _joined(s.split(), longest))]
        out += [p for p in _joined(units, longest) if len(p) >= shortest]
    return out


def is_noise(line: str) -> bool:
    """Whether a line is a time stamp, byline, caption, portal notice, address or control of a page."""
    if any(p.search(line) for p in NOISE) or any(w in line for w in fixed.PORTAL_NOTICES):
        return True
    return bool(re.match(fixed.BRACKETED, line)) and any(w in line for w in fixed.CAPTION_AGENCIES)


def first_sentences(text: str, title: str = "", count: int = 5) -> str:
    """The first sentences of an article without title, times, bylines, captions and notices."""
    bare = lambda s: re.sub(r"[\W]", "", s.lower())
    kept, name = [], bare(title or "")
    text = re.sub(rf"(?im)(?:^|(?<=[.!?]))\s*(?:{fixed.ACCESS_NOTICE})[.!?]*(?=\s|$)", "", text)
    for raw in text.splitlines():
        shown = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", raw.strip())
        heading, line = shown.startswith("#"), re.sub(r"[*_`~]", "", shown.lstrip("#")).strip()
        key = bare(line)
        repeats = name and (len(key) > 5 and key == name or heading and name in key)
        small = heading and len(line) < 30 and not re.search(r"[.!?。！？۔؟।॥]$", line)
        if line and not repeats and not small and not is_noise(line):
            kept.append(line)
    # Periods of numbers and abbreviations are no ends: a place where neither stands, after a mark, is a cut.
    joined = " ".join(kept)
    inner = {m.start() for m in re.finditer(r"(?<=\d)\.(?=\d)", joined)} | {i for m in SHORT_FORMS.finditer(joined) for i in range(*m.span()) if joined[i] == "."}
    cuts = [m.end() for m in re.finditer(r"[.!?。！？۔؟।॥]", joined) if m.start() not in inner]
    out: list[str] = []
    for a, b in zip([0, *cuts], [*cuts, len(joined)]):
        piece = joined[a:b].strip()
        long_enough = len(piece) >= 6 or len(piece) >= 4 and re.search(r"[一-鿿]", piece)
        if long_enough and not any(w in piece for w in fixed.NOTICE_SENTENCES):
            out.append(piece)
            if len(out) == count:
                break
    return " ".join(out)


SHORT_FORMS = re.compile(rf"(?i)\b(?:u\.s|{'|'.join(fixed.ABBREVIATIONS)})\.")


class Places:
    """A text folded character by character, so that what is found keeps its place."""

    def __init__(self, text: str):
        parts = [fold(c) for c in text]
        self.folded = "".join(parts)
        self.at = np.repeat(np.arange(len(text)), [len(p) for p in parts])
        self.size = len(text)

    def windows(self, pattern: re.Pattern) -> np.ndarray:
        """For each window of the text whether it holds a match whole."""
        steps = max(1, -(-self.size // STRIDE))
        edges = np.zeros(steps + 1, np.int64)
        for m in pattern.finditer(self.folded):
            first, last = int(self.at[m.start()]), int(self.at[m.end() - 1])
            low, high = max(0, -(-(last + 1 - WINDOW) // STRIDE)), min(steps - 1, first // STRIDE)
            if low <= high:
                edges[low] += 1
                edges[high + 1] -= 1
        return np.cumsum(edges)[:steps] > 0


def topic_gate(groups: list[list[str]], security: bool, briefing: bool = False) -> Callable[[str, str], tuple[str | None, str, int]]:
    """A function (text, title) -> (reason, security word, offset of the window that holds the topic).

    Every anchor group must be named; with ``security`` the headline or the lead must name the
    parties, and a security word must stand in the same window as all groups. An official
    ``briefing`` passes by one question that has an answer and is about the topic.
    """
    patterns = [re.compile(name_regex(name_variants(g))) for g in groups if g]
    words = [(w, re.compile(name_regex([w]))) for w in fixed.SECURITY_TERMS]
    danger = re.compile(name_regex(list(fixed.SECURITY_TERMS)))

    def focused(text: str, title: str) -> bool:
        """Whether the headline names a party or the lead all of them."""
        heading = re.search(r"^#{1,2}\s+[^\n]+", text, re.M)
        head = fold(f"{title} {heading.group() if heading else ''}")
        if any(p.search(head) for p in patterns):
            return True
        rest = re.split(r"\n\s*\n", text[heading.end() if heading else 0 :])
        lead = next((b.strip() for b in rest if sum(map(str.isalpha, b)) >= 60 and not b.strip().startswith(("#", "*   "))), "")
        lead = fold(re.split(r"(?<=[.!?۔。،])\s*", lead, maxsplit=1)[0][:400])
        return all(p.search(lead) for p in patterns)

    def answered(text: str) -> str | None:
        """The security word of the first question with an answer that is about the topic."""
        starts = [m.start() for m in re.finditer(fixed.BRIEFING_QUESTION, text, re.I)]
        for a, b in zip(starts, [*starts[1:], len(text)]):
            asked = re.split(r"[?？]", text[a:b], maxsplit=1)
            if len(asked) == 2 and sum(map(str.isalpha, asked[1])) >= 40:
                reason, word, _ = connected(text[a:b].strip())
                if reason is None:
                    return word
        return None

    def connected(text: str) -> tuple[str | None, str, int]:
        places = Places(text)
        if not all(p.search(places.folded) for p in patterns):
            return "topic_anchors_missing", "", -1
        held = np.logical_and.reduce([places.windows(p) for p in patterns])
        near = places.windows(danger)
        fits = np.flatnonzero(held & near if security else held)
        if not len(fits):
            return ("security_topic_missing" if security else "topic_anchors_not_connected"), "", -1
        at = int(fits[0]) * STRIDE
        window = fold(text[at : at + WINDOW])
        return None, next((w for w, p in words if p.search(window)), "") if near[fits[0]] else "", at

    def judge(text: str, title: str) -> tuple[str | None, str, int]:
        if not patterns:
            return "topic_context_missing", "", -1
        found = connected(text)
        if found[0] == "topic_anchors_missing":
            return found
        if briefing and (word := answered(text)) is not None:
            return None, word, -1
        if security and title and not focused(text, title):
            return "topic_background_only", "", -1
        return found

    return judge


def snippet_source(text: str, groups: list[list[str]], security: bool) -> str:
    """The text from its first paragraph about the topic on, else the whole text."""
    patterns = [re.compile(name_regex(name_variants(g))) for g in groups if g]
    judge = topic_gate(groups, security)
    heading = re.search(r"^#{1,2}\s+[^\n]+", text, re.M)
    start = heading.end() if heading else 0
    for block in re.finditer(r"(?:[^\n]*\S[^\n]*\n?)+", text[start:]):
        part = block.group().strip("\n")
        if part.lstrip().startswith(("#", "Image ")) or sum(map(str.isalpha, part)) < 40 or not re.search(r"[.!?。！？]", part):
            continue
        at, folded = start + block.start(), fold(part)
        if sum(bool(p.search(folded)) for p in patterns) >= max(1, len(patterns) - 1) and judge(text[at : at + WINDOW], "")[0] is None:
            return text[at:]
    return text


HIDDEN = {"markdown": re.compile(r"!?\[|\]\([^)]*\)|[*_`]"), "transcript": re.compile(r"\[\d{1,2}:\d{2}(?::\d{2})?\]|\d{1,2}:\d{2}(?::\d{2})?(?=\s)|\s+")}


def restored_quote(raw: str, quote: str, kind: str) -> str | None:
    """The stretch of ``raw`` that reads as ``quote`` once hidden marks are skipped; null unless there is just one."""
    hidden = HIDDEN[kind]
    shown, at, last = [], [], 0
    for m in [*hidden.finditer(raw), None]:
        end = m.start() if m else len(raw)
        shown.append(raw[last:end])
        at += range(last, end)
        last = m.end() if m else end
    text, want = "".join(shown), hidden.sub("", quote)
    first = text.find(want) if want else -1
    if first < 0 or text.find(want, first + 1) >= 0:
        return None
    return raw[at[first] : at[first + len(want) - 1] + 1]


def fuzzy_candidates(source: str, quote: str, top: int = 3, anchors: int = 8) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the runs of whole sentences of ``source`` most like ``quote``.

    Looked at are the sentences that the longest common stretches touch, with or without the one before
    and the one after; a run is as long as a quote may be.
    """
    ends = [m.end() for m in re.finditer(r"\n+|[。！？]|[.!?](?=\s|$)", source)]
    sentences = [(a, b) for a, b in zip([0, *ends], [*ends, len(source)]) if a < b]
    stretches = [m for m in difflib.SequenceMatcher(None, quote, source, autojunk=False).get_matching_blocks() if m.size]
    runs: dict[tuple[int, int], float] = {}
    for m in sorted(stretches, key=lambda m: -m.size)[:anchors]:
        touched = [i for i, (a, b) in enumerate(sentences) if a < m.b + m.size and m.b < b]
        for first in {max(0, touched[0] - 1), touched[0]}:
            for last in {touched[-1], min(len(sentences) - 1, touched[-1] + 1)}:
                a, b = sentences[first][0], sentences[last][1]
                text = source[a:b]
                a, b = a + len(text) - len(text.lstrip()), a + len(text.rstrip())
                if 0 < b - a <= fixed.QUOTE_CHARS and (a, b) not in runs:
                    runs[a, b] = round(difflib.SequenceMatcher(None, quote, source[a:b], autojunk=False).ratio(), 4)
    return [(a, b, r) for (a, b), r in sorted(runs.items(), key=lambda x: (-x[1], x[0]))[:top]]


def translated(text: str, lexicon: dict[str, str]) -> str:
    """``text`` with the longest known phrases replaced and what is left of their script removed."""
    phrases = sorted(lexicon, key=len, reverse=True)
    if phrases:
        text = re.sub("|".join(map(re.escape, phrases)), lambda m: f" {lexicon[m.group()]} ", text)
    return " ".join(re.sub(r"[가-힣]+", " ", text).split())


def paragraphs_of(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: paragraphs(t or "")), ArrayType(StringType()))(text)


def snippet_of(text: Column, title: Column) -> Column:
    return F.pandas_udf(lambda s, t: pd.Series([first_sentences(a or "", b or "") for a, b in zip(s, t)]), StringType())(text, title)


def topic_of(text: Column, title: Column, groups: list[list[str]], security: bool) -> Column:
    kind = StructType([StructField("reason", StringType()), StructField("security_term", StringType()), StructField("offset", IntegerType())])

    def run(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        judge = topic_gate(groups, security)
        return pd.DataFrame([judge(a or "", b or "") for a, b in zip(s, t)], columns=["reason", "security_term", "offset"])

    return F.pandas_udf(run, kind)(text, title)


def restored(raw: Column, quote: Column, kind: str) -> Column:
    return F.pandas_udf(lambda r, q: pd.Series([restored_quote(a or "", b or "", kind) for a, b in zip(r, q)], dtype=object), StringType())(raw, quote)


def candidates_of(source: Column, quote: Column) -> Column:
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("ratio", DoubleType())]))
    return F.pandas_udf(lambda s, q: pd.Series([[{"start": a, "end": b, "ratio": r} for a, b, r in fuzzy_candidates(x or "", y or "")] for x, y in zip(s, q)]), kind)(source, quote)
