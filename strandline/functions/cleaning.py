"""The article inside a page: best block of an HTML page, lines that are no article text, and labels of what went."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strandline.functions import fixed

LAYOUT = {"script", "style", "nav", "header", "footer", "aside"}
DROPPED = LAYOUT | {"noscript", "iframe", "svg"}
PICTURES = {"img", "picture", "figure"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PAGE = re.compile(r"<html|<body|<div|<p", re.I)
LINK_LINE = re.compile(dict(fixed.PAGE_LINES)["단독 링크 라인"])
FOOTER = re.compile("|".join(f"(?:{p})" for p in fixed.FOOTERS), re.I)
LINES = [(label, re.compile(p, re.I)) for label, p in fixed.PAGE_LINES]


class _Blocks(HTMLParser):
    """The text pieces of a page with the blocks they stand in; dropped elements give none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []  # (tag, number of its block if it is one)
        self.kinds: list[str] = []
        self.pieces: list[tuple[str, tuple[int, ...]]] = []
        self.gone: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.gone |= {"layout"} if tag in LAYOUT else {"picture"} if tag in PICTURES else set()
        if tag in VOID:
            return
        given = dict(attrs)
        named = f"{given.get('id') or ''} {given.get('class') or ''}".lower()
        kind = "article" if tag == "article" else "body" if tag == "body" else "named" if tag in ("main", "div", "section") and any(w in named for w in fixed.ARTICLE_ATTRIBUTES) else ""
        self.open.append((tag, len(self.kinds) if kind else None))
        if kind:
            self.kinds.append(kind)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not any(tag in DROPPED or tag in PICTURES for tag, _ in self.open):
            self.pieces.append((data, tuple(n for _, n in self.open if n is not None)))

    def best(self) -> str:
        """Text of the longest article, else of the longest block named like one, else of the body, else of the page."""
        for kind in ("article", "named", "body"):
            sizes = {n: 0 for n, k in enumerate(self.kinds) if k == kind}
            for piece, blocks in self.pieces:
                for n in blocks:
                    if n in sizes:
                        sizes[n] += len(piece.strip())
            if sizes:
                chosen = max(sizes, key=lambda n: (sizes[n], -n))
                return "\n".join(piece for piece, blocks in self.pieces if chosen in blocks)
        return "\n".join(piece for piece, _ in self.pieces)


def clean_body(text: str) -> tuple[str, list[str]]:
    """The article text of a page, a blank line between its lines, and sorted labels of what was removed."""
    if not (text or "").strip():
        return "", []
    gone: set[str] = set()
    head, mark, tail = text.rpartition("### Transcript")
    if mark:
        text = tail
        gone.add(fixed.CUT_LABELS["transcript"])
    if PAGE.search(text):
        page = _Blocks()
        page.feed(text)
        page.close()
        gone |= {fixed.CUT_LABELS[g] for g in page.gone}
        text = page.best()
    text = re.sub(r"<[^>]+>", " ", text)
    for label, pattern, instead in (
        ("access", rf"(?im)(?:^|(?<=[.!?]))\s*(?:{fixed.ACCESS_NOTICE})[.!?]*(?=\s|$)", ""),
        ("image", r"\[!\[.*?\]\(.*?\)\]\(.*?\)|!\[.*?\]\(.*?\)", ""),
        ("menu", r"(?m)^\s*[\*\+\-]\s*\[.*?\]\(.*?\)\s*$", ""),
        (None, r"\[.*?\]\(#[^\)]*\)", ""),
    ):
        text, times = re.subn(pattern, instead, text)
        if times and label:
            gone.add(fixed.CUT_LABELS[label])
    kept: list[str] = []
    links = 0
    for line in filter(None, map(str.strip, text.splitlines())):
        if FOOTER.search(line):
            gone.add(fixed.CUT_LABELS["footer"])
            break
        if len(kept) >= 3 and sum(map(len, kept)) > 200:
            links = links + 1 if LINK_LINE.match(line) else 0
            if links == 2:  # two links in a row after an article are a list of others
                gone.add(fixed.CUT_LABELS["links"])
                break
        label = _page_line(line)
        if label:
            gone.add(label)
        else:
            kept.append(line)
    return "\n\n".join(kept), sorted(gone)


def _page_line(line: str) -> str | None:
    """The label of a line that belongs to the page, null for article text."""
    low = line.lower()
    if any(w in low for w in fixed.BANNER_WORDS) and (len(line) < 150 or any(w in low for w in fixed.STRONG_BANNER_WORDS)):
        return fixed.CUT_LABELS["banner"]
    return next((label for label, pattern in LINES if pattern.match(line)), None)


def cleaned(text: Column) -> Column:
    """(body, removed) of a page by ``clean_body``; null gives an empty body."""
    kind = StructType([StructField("body", StringType()), StructField("removed", ArrayType(StringType()))])
    return F.pandas_udf(lambda s: pd.DataFrame([clean_body(t) for t in s], columns=["body", "removed"]), kind)(text)


def body_candidates(body: str) -> list[tuple[int, int]]:
    """(start, end) offsets of the sentences of a body: of its transcript, of all of it where lines carry time stamps,
    else of each paragraph that is no heading."""
    transcript = re.search(r"(?im)^#{1,6}\s*Transcript\s*$", body)
    if transcript:
        regions = [(transcript.end(), len(body))]
    elif len(re.findall(r"(?m)^\s*\[\d{1,2}:\d{2}(?::\d{2})?\]", body)) >= 3:
        regions = [(0, len(body))]
    else:
        cuts = [0, *(m.end() for m in re.finditer(r"\n\s*\n", body)), len(body)]
        regions = list(zip(cuts, cuts[1:]))
    return [(a + x, a + y) for a, b in regions if body[a:b].strip() and not re.match(r"\s*#{1,6}\s", body[a:b]) for x, y in quote_spans(body[a:b])]


MARK = re.compile(fixed.QUOTE_MARKS)
GUARD = re.compile(rf"(?i)\b(?:[a-z]\.\s*)+[a-z]\.|\b(?:{'|'.join(fixed.ABBREVIATIONS)})\.")


def quote_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one paragraph, blanks around them left out; periods of abbreviations end none."""
    guarded = {i for m in GUARD.finditer(text) for i in range(*m.span())}
    cuts = [m.end() for m in MARK.finditer(text) if not (text[m.start()] == "." and m.start() in guarded)]
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        part = text[a:b]
        if part.strip():
            out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return out


def candidates_of_body(body: Column) -> Column:
    kind = "array<struct<start:int,end:int>>"
    return F.pandas_udf(lambda s: s.map(lambda t: [{"start": a, "end": b} for a, b in body_candidates(t or "")]), kind)(body)
