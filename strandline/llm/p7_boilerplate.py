"""The main body of web pages, freed from what a host prints around it.

The token streams of the pages of one host are concatenated, in blocks of bounded size, and
indexed by a suffix array. Its sorted suffixes show the long substrings that stand on several
distinct pages: whole lines, line openings up to a colon, and runs of tokens inside longer
lines. These candidates are then counted exactly over all pages of the host. The counts tell
boilerplate that cleaning usually leaves in a text (bylines, share prompts) from boilerplate
it strips (menus, cookie notices, teaser headings). Lines that boilerplate covers go; of the
unique runs those are kept that lie in the article's place on their page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import source_key
from strandline.operators.joins import sized
from strandline.session import settled

#: Pages of a block; at least 200 then, so that what reaches a threshold on a larger host stands on several pages of one block.
BLOCK_PAGES = 400
BROADCAST_ROWS = 300_000
SALTS = 32
#: Least tokens of a run inside a line, and the share of a line's tokens that such runs must cover.
LEAST_RUN, COVERED = 8, 0.6
#: Share of the raw pages with a substring whose cleaned text may keep it, if it is stripped: lines and openings, and runs of any text.
KEPT, RUN_KEPT = 0.2, 0.05

TAG = re.compile(r"<[^>]*>")
LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)")
WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(rf"[{WIDE}]|[^\W\d_{WIDE}]+|[:：]")
KEEP = re.compile(r"[\W_]+")
LETTERS = re.compile(r"[\W\d_]+")
CUT_MARK = re.compile(r"\s*(?:\[\+\d+ chars\]|…|\.\.\.|�|&#?\w{0,6})\s*$")
HEADING = re.compile(r"\s*(?:<h1\b|#\s)", re.I)
AROUND = re.compile(r"\s*<(?:nav|aside|footer|header)\b|\s*<div class=\"menu\"|\s*[*-]?\s*!?\[[^\]]*\]\([^)]*\)\s*$", re.I)

#: Openings of picture and correction notes, which every outlet prints rarely.
NOTES = re.compile(
    r"\W*(?:photo(?:graph)?\s*:|picture\s*:|image\s*:|correction\s*:|corrections?\b.{0,40}earlier version|사진\s*[:=]|자료\s*사진|정정\s*[:：]|바로잡습니다|资料图片|图片\s*[:：]|更正\s*[:：]|資料圖片|圖片\s*[:：]|資料写真|写真\s*[:：]|訂正\s*[:：]|फोटो\s*:|चित्र\s*:|तस्वीर\s*:|सुधार\s*:|भूल सुधार|فائل فوٹو|تصویر\s*:|فوٹو\s*:|تصحیح\s*:)",
    re.I,
)


def visible(line: str) -> str:
    """What a reader sees of a line: without tags, link targets and heading marks."""
    if "<" in line:
        line = TAG.sub("", line)
    if "](" in line:
        line = LINK.sub(r"\1", line)
    return html.unescape(line) if "&" in line else line


def tokens(line: str) -> list[str]:
    return WORD.findall(line.lower())


def line_key(words: list[str]) -> int:
    """64-bit key of a line by its letters alone."""
    key = xxhash.xxh64_intdigest("".join(words).replace(":", "").replace("：", ""))
    return key - (1 << 64) if key >> 63 else key


def label_of(words: list[str]) -> list[str] | None:
    """The opening of a line up to its first colon, if more follows."""
    i = next((i for i, w in enumerate(words) if w in ":："), 0)
    return words[: i + 1] if 0 < i < len(words) - 1 else None


def suffix_array(ids: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``longest`` ids at least (all if not given), and the common prefix of each with the one before.

    Ranks are refined by doubling; only suffixes that still share their rank are sorted again.
    """
    n = len(ids)
    longest = n if longest is None else longest
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    rank, k, levels = _dense(ids), 1, []
    if n and ids.max() < (1 << 15) - 1:  # four ids fit one key, which is sorted at once
        pad = np.concatenate((ids + 1, np.zeros(3, np.int64)))
        pair = pad[:-1] << 15 | pad[1:]
        levels += [(1, ids), (2, pair[:n])]
        rank, k = _dense(np.unique(pair[:-2] << 30 | pair[2:], return_inverse=True)[1]), 4
    while True:
        levels.append((k, rank))
        if k >= longest:
            break
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(shared):
            break
        ahead = np.zeros(len(shared), np.int64)
        inside = shared + k < n
        ahead[inside] = rank[shared[inside] + k] + 1
        key = rank[shared] * (n + 1) + ahead
        by = np.argsort(key)
        key, at = key[by], shared[by]
        old = rank[at]
        place = np.arange(len(at))
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        groups = np.concatenate(([True], old[1:] != old[:-1]))
        rank = rank.copy()
        rank[at] = old + np.maximum.accumulate(np.where(begins, place, 0)) - np.maximum.accumulate(np.where(groups, place, 0))
        k *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k, rank in reversed(levels):
        inside = (a < n) & (b < n)
        same = np.zeros(max(n - 1, 0), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        common[1:][same] += k
        a[same] += k
        b[same] += k
    return order, common


def _dense(ids: np.ndarray) -> np.ndarray:
    """Each id as the place of its first in sorted order."""
    counts = np.bincount(ids)
    return (np.cumsum(counts) - counts)[ids]


def _sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def repeats(order: np.ndarray, common: np.ndarray, times: int) -> np.ndarray:
    """For each suffix the longest prefix of it that occurs ``times`` times or more."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n >= times > 1:
        least = _sliding(common[1:], times - 1, np.minimum)  # of ``times`` neighbours in the order
        pad = np.zeros(times - 1, np.int64)
        out[order] = _sliding(np.concatenate((pad, least, pad)), times, np.maximum)
    return out


class Hashes:
    """Keys of any stretch of a token stream, from running sums."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, flat: list[str]):
        code, words = pd.factorize(np.array(flat, object))
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[code]
        powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(flat), b, np.uint64))))
        with np.errstate(over="ignore"):
            self.down = powers(self.INVERSE)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(self.BASE)[:-1])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[stop] - self.sums[start]) * self.down[start]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _flat(streams: list[list[list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All pages in one stream, with the page of each token, and the beginning and size of each line."""
    flat: list[str] = []
    page, begin, sizes = [], [], []
    for p, lines in enumerate(streams):
        for words in lines:
            begin.append(len(flat))
            sizes.append(len(words))
            flat += words
            flat.append("\n")
        flat.append(f"\x00{p}")  # unique, so that no run crosses pages
        page.append(len(flat))
    of = np.repeat(np.arange(len(streams)), np.diff([0, *page]))
    return flat, of, np.array(begin, np.int64), np.array(sizes, np.int64)


def repeated_runs(streams: list[list[list[str]]], times: int = 2) -> list[tuple[str, list[str], list[int]]]:
    """(kind, tokens, pages) of the substrings that stand on two or more of the pages.

    ``streams`` holds for each page its lines as tokens. A ``line`` is repeated if the suffixes
    from its start share it to its break; a ``label`` if they share it to its colon; a ``run``
    is a stretch of ``LEAST_RUN`` tokens or more inside a line that occurs ``times`` times and
    cannot be extended.
    """
    flat, page, begin, sizes = _flat(streams)
    if not len(begin):
        return []
    ids = pd.factorize(np.array(flat, object))[0]
    order, common = suffix_array(ids, int(sizes.max()) + 1)
    spot = np.full(len(ids), -1)
    spot[begin] = np.arange(len(begin))
    # Among the suffixes that begin a line, the common prefix with the line before is the least in between.
    at = np.flatnonzero(spot[order] >= 0)
    line = spot[order[at]]
    share = np.minimum.reduceat(common, np.concatenate(([0], at[:-1] + 1)))
    share[0] = 0
    out = _grouped("line", np.cumsum(share < sizes[line] + 1), begin[line], sizes[line], page, flat)
    labels = [label_of(flat[b : b + n]) for b, n in zip(begin, sizes)]
    has = np.array([i for i, label in enumerate(labels) if label], np.int64)
    if len(has):
        text = pd.factorize(np.array([" ".join(labels[i]) for i in has], object))[0]
        out += _grouped("label", text, begin[has], np.array([len(labels[i]) for i in has]), page, flat)
    # Inside lines: how far the text from each token on is repeated, up to the line's end.
    number = np.repeat(np.arange(len(begin)), sizes)
    inside = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = begin[number] + inside
    far = np.minimum(repeats(order, common, times)[where], sizes[number] - inside)
    extends = np.concatenate(([False], (far[:-1] == far[1:] + 1) & (inside[1:] > 0)))
    use = (far >= LEAST_RUN) & ~extends & ((inside > 0) | (far < sizes[number]))
    start, size = where[use], far[use]
    if len(start):
        keys = Hashes(flat).of(start, start + size)
        out += _grouped("run", pd.factorize(keys)[0], start, size, page, flat)
    return out


def _grouped(kind: str, group: np.ndarray, start: np.ndarray, size: np.ndarray, page: np.ndarray, flat: list[str]) -> list[tuple[str, list[str], list[int]]]:
    pairs = pd.DataFrame({"g": group, "p": page[start], "a": start, "n": size})
    pairs = pairs[pairs["n"] > 0].drop_duplicates(["g", "p"])
    pairs = pairs[pairs.groupby("g")["p"].transform("size") > 1].sort_values(["g", "p"])
    edges = np.flatnonzero(np.diff(pairs["g"].to_numpy(), prepend=-1, append=-1))
    p, a, n = (pairs[c].to_numpy() for c in ("p", "a", "n"))
    return [(kind, flat[a[i] : a[i] + n[i]], p[i:j].tolist()) for i, j in zip(edges, edges[1:])]


CANDIDATE = "source string, kind string, key bigint, anchor bigint, size int"


def _lines(text: str | None) -> list[list[str]]:
    return [w for x in (text or "").split("\n") if (w := tokens(visible(x)))]


RAW, TEXT = 0, 1


def _parts(block: pd.DataFrame) -> list[list[list[str]]]:
    """The lines of each page as streams: those of its raw content only, of its text only, and of both, each line
    once, so that an article is not its own repetition."""
    raws, texts, both = [], [], []
    for raw, text in zip(block["raw_content"], block["text"]):
        r, t = ({tuple(w): w for w in _lines(x)} for x in (raw, text))
        raws.append([w for k, w in r.items() if k not in t])
        texts.append([w for k, w in t.items() if k not in r])
        both.append([w for k, w in t.items() if k in r])
    return raws + texts + both


def _candidates(note_percent: float, strip_percent: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """The repeated substrings of one block that may be judged boilerplate: what reaches a threshold on a host reaches
        half of it in blocks that hold half of its pages or more, so in one of these texts show it at most twice as
        often as a judgement allows."""
        n, raw = len(block), int(block["raw_content"].notna().sum())
        least_raw, least_text = max(2.0, raw * strip_percent / 200), max(2.0, n * note_percent / 200)
        rows, runs, source = set(), [], block["source"].iloc[0]
        for kind, words, pages in repeated_runs(_parts(block), int(np.ceil(least_raw))):
            part, page = np.divmod(np.array(pages), n)
            in_raw, in_text = len(set(page[part != TEXT].tolist())), len(set(page[part != RAW].tolist()))
            strip = in_raw >= least_raw and in_text <= 2 * (RUN_KEPT if kind == "run" else KEPT) * in_raw
            if not strip and (kind != "line" or in_text < least_text):
                continue
            if kind == "run":
                runs.append(words)
            else:
                rows.add((source, kind, line_key(words), 0, 0))
        if runs:
            size = np.array([len(w) for w in runs])
            start = np.cumsum(size) - size
            keys = Hashes([w for words in runs for w in words])
            rows |= {(source, "run", *r) for r in zip(keys.of(start, start + size).tolist(), keys.of(start, start + LEAST_RUN).tolist(), size.tolist())}
        return pd.DataFrame(sorted(rows), columns=["source", "kind", "key", "anchor", "size"])

    return run


class Runs:
    """Runs of tokens of one host, found in any line through their first tokens."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.anchor = np.array([a for a, _, _ in rows], np.int64)
        self.size = np.array([n for _, n, _ in rows], np.int64)
        self.key = np.array([k for _, _, k in rows], np.int64)

    def found(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the run, line, place in it) of all that stand in the lines."""
        none = np.zeros(0, np.int64)
        if not len(self.key):
            return none, none, none
        sizes = np.array([len(w) for w in lines], np.int64)
        flat = [w for words in lines for w in words]
        line = np.repeat(np.arange(len(lines)), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        start = np.flatnonzero(np.arange(len(flat)) + LEAST_RUN <= end)
        if not len(start):
            return none, none, none
        hashes = Hashes(flat)
        gram = hashes.of(start, start + LEAST_RUN)
        low, high = np.searchsorted(self.anchor, gram, "left"), np.searchsorted(self.anchor, gram, "right")
        times = high - low
        at = np.repeat(start, times)
        run = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        fits = at + self.size[run] <= end[at]
        at, run = at[fits], run[fits]
        same = hashes.of(at, at + self.size[run]) == self.key[run]
        at, run = at[same], run[same]
        return run, line[at], at - (end[at] - sizes[line[at]])

    def covered(self, lines: list[list[str]]) -> np.ndarray:
        """The share of each line's tokens that runs cover."""
        run, line, at = self.found(lines)
        out = np.zeros(len(lines))
        for i in np.unique(line):
            mask = np.zeros(len(lines[i]), bool)
            for r, a in zip(run[line == i], at[line == i]):
                mask[a : a + self.size[r]] = True
            out[i] = mask.mean()
        return out


class Wanted:
    """Candidates of one host, by kind."""

    def __init__(self, rows: list[tuple]):
        self.line = {r[1] for r in rows if r[0] == "line"}
        self.label = {r[1] for r in rows if r[0] == "label"}
        self.runs = Runs([(r[2], r[3], r[1]) for r in rows if r[0] == "run"])

    def standing(self, pages: list[list[list[str]]]) -> set[tuple[int, str, int]]:
        """(page, kind, key) of the candidates that stand in each of the pages."""
        out = set()
        for p, lines in enumerate(pages):
            for words in lines:
                if (key := line_key(words)) in self.line:
                    out.add((p, "line", key))
                label = label_of(words) if self.label else None
                if label and (key := line_key(label)) in self.label:
                    out.add((p, "label", key))
        run, line, _ = self.runs.found([words for lines in pages for words in lines])
        page = np.repeat(np.arange(len(pages)), [len(lines) for lines in pages])[line]
        return out | {(p, "run", k) for p, k in zip(page.tolist(), self.runs.key[run].tolist())}


def _count(batch: pd.DataFrame, host: dict[str, Wanted]) -> pd.DataFrame:
    """Pages of a batch on which each candidate stands: in raw content, in the text of pages with raw content, in any text."""
    found: dict[tuple, list[int]] = {}
    for source, part in batch.groupby("source", sort=False):
        wanted = host.get(source)
        if wanted is None:
            continue
        has = part["raw_content"].notna().tolist()
        for p, kind, key in wanted.standing([_lines(r) if h else [] for r, h in zip(part["raw_content"], has)]):
            found.setdefault((source, kind, key), [0, 0, 0])[0] += 1
        for p, kind, key in wanted.standing([_lines(t) for t in part["text"]]):
            row = found.setdefault((source, kind, key), [0, 0, 0])
            row[1] += has[p]
            row[2] += 1
    return pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["source", "kind", "key", "raw_pages", "both_pages", "text_pages"])


def by_host(pages: DataFrame, table: DataFrame, columns: list[str], build: Callable[[list[tuple]], object], run: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``run(batch, {source: build(rows of the host)})`` over all pages; ``table`` holds the rows (source, *columns), settled."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows: dict[str, list[tuple]] = {}
        for r in table.select("source", *columns).collect():
            rows.setdefault(r[0], []).append(tuple(r[1:]))
        shared = pages.sparkSession.sparkContext.broadcast(rows)

        def run_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hosts = {source: build(x) for source, x in shared.value.items()}
            for batch in batches:
                yield run(batch, hosts)

        return pages.mapInPandas(run_shared, schema)
    # Too many hosts to broadcast: each host's rows, bounded by its lines per page over the least share, travel to its salted pages.
    packed = table.groupBy("source").agg(F.collect_list(F.struct(*columns)).alias("rows")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(packed, ["source", "salt"], "left").drop("salt")

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, part in batch.groupby("source", sort=False):
                rows = part["rows"].iloc[0]
                yield run(part, {source: build([tuple(r[c] for c in columns) for r in (rows if rows is not None else [])])})

    return salted.mapInPandas(run_joined, schema)


def host_runs(pages: DataFrame, note_percent: float = 4.0, strip_percent: float = 3.0, least: int = 4) -> DataFrame:
    """(source, kind, key, anchor, size): per host the substrings judged boilerplate, of ``pages`` (source, doc_id, text, raw_content).

    ``note``: a line on ``note_percent`` of the host's texts; ``strip``: a line, ``label``: a
    line opening, that ``strip_percent`` of the raw pages show but the cleaned texts of the same
    pages lack; ``run``: a stretch inside lines that the raw pages show as often, but hardly any text.
    """
    # Pages with raw content have blocks of their own, so that few of them never spread over many blocks.
    placed = pages.select("source", "doc_id", "text", "raw_content", F.col("raw_content").isNotNull().alias("has_raw"))
    sizes = placed.groupBy("source", "has_raw").agg(F.count("*").alias("n"))
    sizes = settled(sizes)
    blocks = sizes.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("n") / BLOCK_PAGES)).cast("int")).drop("n")
    placed = placed.join(sized(blocks, BROADCAST_ROWS), ["source", "has_raw"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    found = placed.groupBy("source", "has_raw", "block").applyInPandas(_candidates(note_percent, strip_percent), CANDIDATE)
    candidates = settled(found.distinct())
    counted = by_host(pages.select("source", "doc_id", "text", "raw_content"), candidates, ["kind", "key", "anchor", "size"], Wanted, _count, "source string, kind string, key bigint, raw_pages bigint, both_pages bigint, text_pages bigint")
    counted = counted.groupBy("source", "kind", "key").agg(*[F.sum(c).alias(c) for c in ("raw_pages", "both_pages", "text_pages")])
    whole = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("has_raw"), F.col("n")).otherwise(0)).alias("n_raw"))
    strip = (F.col("raw_pages") >= least) & (F.col("raw_pages") * 100 >= F.col("n_raw") * strip_percent) & (F.col("both_pages") < KEPT * F.col("raw_pages"))
    note = (F.col("text_pages") >= least) & (F.col("text_pages") * 100 >= F.col("n") * note_percent)
    run = strip & (F.col("raw_pages") >= 2 * least) & (F.col("text_pages") < RUN_KEPT * F.col("raw_pages"))
    kind = F.when((F.col("kind") == "line") & strip, "strip").when((F.col("kind") == "label") & strip, "label").when((F.col("kind") == "run") & run, "run").when((F.col("kind") == "line") & note, "note")
    judged = counted.join(sized(whole, BROADCAST_ROWS), "source").join(candidates, ["source", "kind", "key"])
    return judged.select("source", kind.alias("kind"), "key", "anchor", "size").where("kind is not null")


class Known:
    """The boilerplate of one host, by key."""

    def __init__(self, rows: list[tuple]):
        self.strip = {r[1] for r in rows if r[0] == "strip"}
        self.label = {r[1] for r in rows if r[0] == "label"}
        self.note = {r[1] for r in rows if r[0] == "note"}
        self.runs = Runs([(r[2], r[3], r[1]) for r in rows if r[0] == "run"])

    def kinds(self, shown: list[str]) -> list[str]:
        """For each line as shown what it is: strip, note, label, run, or nothing known."""
        words = [tokens(s) for s in shown]
        out = [self._of(s, w) if w else "" for s, w in zip(shown, words)]
        left = [i for i, k in enumerate(out) if not k]
        for i, share in zip(left, self.runs.covered([words[i] for i in left])):
            if share >= COVERED:
                out[i] = "run"
        return out

    def _of(self, shown: str, words: list[str]) -> str:
        key = line_key(words)
        if key in self.strip:
            return "strip"
        if key in self.note or NOTES.match(shown):
            return "note"
        label = label_of(words)
        if label and line_key(label) in self.label:
            return "label"
        return ""


def _place(lines: list[str], shown: list[str], kinds: list[str], title: str, start: int = 0, seen: bool = False) -> list[bool]:
    """Main-body verdicts by place: from the headline to the first stripped line after the body began."""
    keys = [KEEP.sub("", s).lower() for s in shown]
    head = next((i for i in range(start, len(lines)) if keys[i] and (HEADING.match(lines[i]) or title and keys[i] == title)), None) if not seen else None
    if head is None and not seen:
        head = next((i for i in range(start, len(lines)) if keys[i] and not kinds[i] and not AROUND.match(lines[i]) and len(keys[i]) > 12), len(lines))
    main, tail = [False] * len(lines), False
    for i in range(start if seen else head, len(lines)):
        if not keys[i]:
            continue
        if i == head:
            main[i] = not kinds[i] or keys[i] == title
            continue
        if kinds[i] == "strip":
            tail = tail or seen
        elif not tail and not kinds[i] and not AROUND.match(lines[i]):
            main[i] = seen = True
    return main


def verdicts(text: str, raw: str | None, title: str | None, known: Known) -> list[tuple[str, int, bool]]:
    """(field, line_no, main) of every line of both fields that carries text."""
    name = KEEP.sub("", html.unescape(title or "")).lower()
    lines = text.split("\n")
    shown = [visible(x) for x in lines]
    kinds = known.kinds(shown)
    carries = [bool(KEEP.sub("", s)) for s in shown]
    last = max((i for i, c in enumerate(carries) if c), default=-1)
    page = sum(k in ("strip", "label", "run") for k in kinds) >= 2  # the text is the raw page still
    if page:
        main = _place(lines, shown, kinds, name)
    else:
        main = [c and not k for c, k in zip(carries, kinds)]
    out_text = [("text", i + 1, m) for i, (m, c) in enumerate(zip(main, carries)) if c]
    if raw is None:
        return out_text
    raw_lines = raw.split("\n")
    raw_shown = [visible(x) for x in raw_lines]
    raw_keys = [KEEP.sub("", s).lower() for s in raw_shown]
    raw_kinds = [kind if k else "" for kind, k in zip(known.kinds(raw_shown), raw_keys)]
    keys = {KEEP.sub("", s).lower() for s, c in zip(shown, carries) if c}
    stub = KEEP.sub("", CUT_MARK.sub("", shown[last])).lower() if last >= 0 else ""
    matched = [bool(k) and k in keys for k in raw_keys]
    if page or not any(m and not k for m, k in zip(matched, raw_kinds)):
        raw_main = _place(raw_lines, raw_shown, raw_kinds, name)
    else:
        # The cleaned text says which lines of the page it kept; beyond a cut, the place on the page does.
        raw_main = [m and not k or bool(key) and (key == name or bool(HEADING.match(x)) and not k) for m, k, key, x in zip(matched, raw_kinds, raw_keys, raw_lines)]
        cut = next((i for i, k in enumerate(raw_keys) if stub and k != stub and k.startswith(stub)), None) if stub not in raw_keys else None
        if cut is not None:
            raw_main[cut] = not raw_kinds[cut]
            rest = _place(raw_lines, raw_shown, raw_kinds, name, cut + 1, True)
            raw_main[cut + 1 :] = rest[cut + 1 :]
            if raw_kinds[cut]:  # the cut line is the beginning of a boilerplate line
                out_text = [(f, n, m and n != last + 1) for f, n, m in out_text]
    return out_text + [("raw_content", i + 1, m) for i, (m, k) in enumerate(zip(raw_main, raw_keys)) if k]


def page_lines(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, field, line_no, main) of every line of text and raw_content that carries text.

    A document without a source is a host of its own kind (the empty name). Null texts count as
    empty, a repeated document counts once, empty tables give no rows, other columns are ignored.
    """
    once = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "raw_content", "title").where("doc_id is not null").dropDuplicates(["doc_id"])
    named = sources.select("doc_id", source_key(F.col("source_name")).alias("source")).where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    pages = once.join(named, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    pages = settled(pages)
    known = settled(host_runs(pages))
    schema = "doc_id string, field string, line_no int, main boolean"

    def judge(batch: pd.DataFrame, host: dict[str, Known]) -> pd.DataFrame:
        ids, fields, nos, mains = [], [], [], []
        empty = Known([])
        for doc_id, text, raw, title, source in zip(batch["doc_id"], batch["text"], batch["raw_content"], batch["title"], batch["source"]):
            for field, no, main in verdicts(text, raw, title, host.get(source, empty)):
                ids.append(doc_id)
                fields.append(field)
                nos.append(no)
                mains.append(main)
        return pd.DataFrame({"doc_id": ids, "field": fields, "line_no": nos, "main": mains})

    return by_host(pages.select("doc_id", "text", "raw_content", "title", "source"), known, ["kind", "key", "anchor", "size"], Known, judge, schema)


def main_bodies(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, body): both fields without the lines that are not of the main body."""
    drop = lines.where("not main").groupBy("doc_id", "field").agg(F.collect_set("line_no").alias("drop"))
    once = docs.select("doc_id", "text", "raw_content").where("doc_id is not null").dropDuplicates(["doc_id"])
    fields = once.select("doc_id", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("value")), F.struct(F.lit("raw_content").alias("field"), F.col("raw_content").alias("value")))).alias("f")).select("doc_id", "f.*")
    kept = F.filter(F.split("value", "\n", -1), lambda x, i: ~F.array_contains(F.col("drop"), i + 1))
    return fields.join(drop, ["doc_id", "field"], "left").select("doc_id", "field", F.when(F.col("drop").isNull(), F.col("value")).otherwise(F.array_join(kept, "\n")).alias("body"))
