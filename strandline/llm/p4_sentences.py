"""Sentence units with exact positions, across scripts and with or without punctuation.

Counts of what stands before and after clear sentence ends, taken over the whole corpus,
kept by 64-bit key and joined back to the texts that ask for them, give every gap of a text
a log-odds of closing and opening a sentence. Counts of how often a word with its full stop
ends a line tell abbreviations from closing words in any language.
Each line is then cut by semi-Markov dynamic programming over whole candidate spans: the
score of a span joins its length, how it opens, how it closes and whether its quotations
balance.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.chars import DIGIT, LETTER, MARK, classes, points
from strandline.session import settled

#: Least number of ranges the keys are counted in, and the characters of a part of the texts; both ranges and parts grow with the corpus.
SLICES, PART = 16, 4_000_000
COUNTED = "slice int, counts binary"
#: Log-odds a comma or semicolon adds, and the least log-odds of a sentence
#: end without any mark, in a stretch without and with such weak marks.
WEAK_BIAS, BARE_BIAS, MARKED_BIAS = 0.5, 0.0, 3.0
#: What speaks against a sentence end right after a quotation that began the sentence.
GOES_ON = 9.0
CHUNK = 1_000_000
#: Characters beyond which length speaks against a span.
USUAL = 400
#: Weight of the words around a mark next to the mark itself, and of what the counts say about a word with a full stop.
WORDS, STOPPED = 0.25, 2.0
#: What a word shaped like an abbreviation, or listed below, counts as before the corpus speaks: occurrences with a full stop inside a line.
LISTED, MAYBE, INITIAL = 60, 6, 30
#: Kinds of keys, in their last two bits.
SHORT, LONG, STOP = range(3)

#: Full stops of scripts that have their own, closing marks, and abbreviations the
#: counts start from, such as rarely end a sentence and such as may.
FULL_STOPS = "。！？｡．！？۔؟।॥"
CLOSERS = "\"'”’」』）)]】》〉»"
NEVER_LAST = frozenset("no. nos. lt. dr. mr. mrs. ms. prof. gen. col. capt. cmdr. sgt. maj. adm. gov. sen. rep. st. mt. vs. incl. approx. i.e. e.g. al. cf. fig. vol. pp. jan. feb. mar. apr. jun. jul. aug. sept. sep. oct. nov. dec. pct. क्र. डॉ. श्री.".split())
MAYBE_LAST = frozenset("u.s. u.k. u.n. p.m. a.m. etc. inc. ltd. co. corp. jr. sr.".split())

QUOTED = re.compile(r"“[^”]*”|‘[^’]*’|「[^」]*」|『[^』]*』|«[^»]*»|《[^》]*》|\"[^\"]*\"|（[^）]*）|\([^)]*\)|【[^】]*】|\[[^\]]*\]")
BRACKETS = "（(【["
CANDIDATE = re.compile(r"(?:[。！？｡．۔؟।॥]|[.!?…]|(?<=[ऀ-ॿ])\|)+[\"'”’」』）)\]】》〉»]*")
FOLLOWING = re.compile(r"\s*(\S?)")
LIST_MARKS = re.compile(r"[*•»—\-\s]*")
COLON = re.compile(r"[:：][\s“\"「『‘«]*[^“\"「『‘«]*$")
ITEM_NUMBER = re.compile(r"[\d. ]*\d{1,3}\.")
WEAK = re.compile(r"[,，、،;；؛:：]+|　+")
STOPPED_WORD = re.compile(r"(?<!\S)[(“\"'‘\[「『]*(\S+\.)(?=\s|$)")
THOUSANDS = re.compile(r"\d,\d{3}(?!\d)")
CUT_MARK = re.compile(r"\s*(?:\[\+\d+ chars\]|\.{3,}|…+)\s*$")
ALNUM = re.compile(r"[^\W_]")


@dataclass
class Edges:
    """Counts over n-grams before (0) and after (1) a gap, as float32 of shape (side, length, 2, keys):
    how often the n-gram of the short or long length occurs, and how often at a sentence end. ``keys`` are
    the index of 64-bit hashes, their last two bits tell the kind. ``stops`` holds for each key of a word with
    its full stop how often it occurs, and how often at the end of a line. ``priors`` are the shares of
    closing gaps, opening gaps and full stops at the end of a line."""

    keys: Index
    counts: np.ndarray
    stops: np.ndarray
    priors: tuple[float, float, float]


@dataclass
class CountedEdges:
    """The counts of a whole corpus as rows (slice, counts), a range of keys in each of ``slices``."""

    rows: DataFrame
    slices: int
    priors: tuple[float, float, float]


def _stream(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters, numbers (as one 0) and line breaks of a text, and for each gap its place among them."""
    kind = classes()[at]
    digit = kind == DIGIT
    kept = (kind == LETTER) | (kind == MARK) | (at == 10)
    kept[:1] |= digit[:1]
    kept[1:] |= digit[1:] & ~digit[:-1]
    folded = np.where(digit, 48, at)[kept].astype(np.uint64)
    return folded, np.concatenate(([0], np.cumsum(kept)))


def _wide(stream: np.ndarray) -> np.ndarray:
    """Characters of scripts whose words take few characters: three say what six letters say elsewhere."""
    return (stream >= 0x3040) & (stream < 0xE000) | (stream >= 0x20000)


def _hashes(stream: np.ndarray) -> list[list[np.ndarray]]:
    """[side][length]: for each gap 0..n of the stream the key of the short and the long text before and after it."""
    n = len(stream)
    pad = np.concatenate((np.full(12, 10, np.uint64), stream, np.full(12, 10, np.uint64)))

    def join(a: np.ndarray, by: int) -> np.ndarray:
        h = (a[:-by] * np.uint64(0x9E3779B97F4A7C15)) ^ a[by:]
        return h ^ (h >> np.uint64(31))

    h1 = (pad + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h3 = (join(h1, 1)[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h1[2:]
    h6 = join(h3, 3)
    h12 = join(h6, 6)
    by = {k: mixed(h) for k, h in ((3, h3), (6, h6), (12, h12))}
    wide = np.concatenate(([False], _wide(stream), [False]))
    out = []
    for flag, place in ((wide[:-1], lambda k: 12 - k), (wide[1:], lambda k: 12)):
        at = lambda k: by[k][place(k) : place(k) + n + 1]  # noqa: B023, E731
        short, long = np.where(flag, at(3), at(6)), np.where(flag, at(6), at(12))
        out.append([short & ~np.uint64(3) | np.uint64(SHORT), long & ~np.uint64(3) | np.uint64(LONG)])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread evenly over 64 bits."""
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xC4CEB9FE1A85EC53)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys sorted, each once."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


class Index:
    """Sorted, evenly spread keys, found by their top bits and then step by step."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, len(keys).bit_length())
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if len(keys) else keys

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Where each of ``asked`` stands among the keys, or -1."""
        keys = self.keys
        if not len(keys):
            return np.full(len(asked), -1)
        at = self.first[(asked >> np.uint64(64 - self.bits)).astype(np.int64)]
        at[at == len(keys)] = len(keys) - 1
        todo = np.flatnonzero(keys[at] < asked)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] < len(keys)]
            todo = todo[keys[at[todo]] < asked[todo]]
        at[at == len(keys)] = len(keys) - 1
        at[keys[at] != asked] = -1
        return at


def _clear_ends(text: str) -> np.ndarray:
    """Positions after marks that end a sentence beyond doubt and are followed by more of the line."""
    found = [m.end() for m in re.finditer(r"[。！？｡۔؟।॥](?=[^\s。！？”’」』）)\"'])|[。！？۔؟।॥] (?=\w)|(?<=[^\W\d_]{3})[.!?] (?=[^\Wa-z_])|(?<=\d)[.!?] (?=[^\W\da-z_])", text)]
    return np.array(found, np.int64)


def _stopped(word: str) -> str:
    """A word with its full stop, in the form it is counted in: lower case, numbers as one 0."""
    return re.sub(r"\d+", "0", word.lower())


def _stop_key(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~3 | STOP


def _tally(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a text and their counts of shape (side, 2, keys); those of words with a full stop are on side 0."""
    stream, place = _stream(points(text))
    ends = place[_clear_ends(text)]
    # A line begins with an opening too; its end proves nothing, as it may be cut or a heading's.
    begins = np.union1d(ends, np.flatnonzero(stream == 10) + 1)
    hashes = _hashes(stream)
    stops: Counter[str] = Counter()
    last: Counter[str] = Counter()
    for m in STOPPED_WORD.finditer(text):
        word = _stopped(m.group(1))
        stops[word] += 1
        last[word] += text[m.end() : m.end() + 1] in ("", "\n")
    words = np.array([_stop_key(w) for w in stops], np.uint64)
    keys = distinct(np.concatenate([words, *(ids for lengths in hashes for ids in lengths)]))
    index = Index(keys)
    counts = np.zeros((2, 2, len(keys)), np.int64)
    counts[0, :, np.searchsorted(keys, words)] = np.array([(n, last[w]) for w, n in stops.items()], np.int64).reshape(-1, 2)
    for side, (lengths, at_edge) in enumerate(zip(hashes, (ends, begins))):
        for ids in lengths:
            at = index.places(ids)
            counts[side, 0] += np.bincount(at, minlength=len(keys))
            counts[side, 1] += np.bincount(at[at_edge], minlength=len(keys))
    return keys, counts


def _added(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of keys and counts as one."""
    if len(tables) == 1:
        return tables[0]
    keys = distinct(np.concatenate([k for k, _ in tables]))
    counts = np.zeros((2, 2, len(keys)), np.int64)
    for k, c in tables:
        counts[:, :, np.searchsorted(keys, k)] += c
    return keys, counts


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, first all lowest bytes: what most of them share compresses to nothing."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    if not planes:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _packed_keys(keys) + _planes(counts.astype(np.int64).reshape(-1))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 40
    return _keys(blob[: 8 * n]), _numbers(blob[8 * n :]).view(np.int64).reshape(2, 2, n)


def _cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each of equal ranges of the key space begins among sorted keys, and the end."""
    inner = np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


def _count(batches: Iterator[pd.DataFrame], slices: int = SLICES) -> Iterator[pd.DataFrame]:
    def sliced(tables: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        keys, counts = _added(tables)
        at = _cuts(keys, slices)
        rows = [(i, _packed(keys[a:b], counts[:, :, a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        return pd.DataFrame(rows, columns=["slice", "counts"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for text in _joined(x for batch in batches for x in batch["text"]):
        held.append(_tally(text))
        if sum(len(k) for k, _ in held) > PART:  # keys that many texts share are sent once
            yield sliced(held)
            held = []
    if held:
        yield sliced(held)


def _joined(texts: Iterable[str]) -> Iterator[str]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > CHUNK:
            yield "\n".join(part)
            part, size = [], 0
    if part:
        yield "\n".join(part)


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = _added([_unpacked(c) for c in rows["counts"]])
    return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "counts": [_packed(*total)], "part": [int(rows["part"].iloc[0])]})


def _characters(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("text"))).first()[0] or 0


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for keys, counts in map(_unpacked, batch["counts"]):
            kind = keys & np.uint64(3)
            yield pd.DataFrame([[*counts[..., kind == SHORT].sum(axis=2).reshape(-1), *counts[0][:, kind == STOP].sum(axis=1)]], columns=TOTALS)


TOTALS = ["n0", "e0", "n1", "e1", "n2", "e2"]


def _priors(n0: int, e0: int, n1: int, e1: int, n2: int, e2: int) -> tuple[float, float, float]:
    return max(e0, 1) / max(n0, 2), max(e1, 1) / max(n1, 2), (e2 + 1) / (n2 + 4)


def learn_edges(texts: DataFrame) -> CountedEdges:
    """Exact counts over all of ``texts`` (text). They stay in ranges of keys, as many as the corpus needs
    for one to fit a task; only their totals come to the driver."""
    slices = max(SLICES, _characters(texts) // PART)
    counted = texts.select("text").where("text is not null").mapInPandas(lambda batches: _count(batches, slices), COUNTED)
    rows = settled(counted.withColumn("part", F.lit(0)).groupBy("slice").applyInPandas(_sum, f"{COUNTED}, part int").drop("part"))
    totals = rows.mapInPandas(_totals, ", ".join(f"{c} long" for c in TOTALS)).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in TOTALS)).first()
    return CountedEdges(rows, slices, _priors(*totals))


def edges_of(slices: list[bytes], priors: tuple[float, float, float] | None = None) -> Edges:
    """The table put together again from its slices, in order; without any, gaps have no opinion."""
    if not slices:
        return Edges(Index(np.zeros(0, np.uint64)), np.zeros((2, 2, 2, 0), np.float32), np.zeros((2, 0), np.float32), priors or (0.5, 0.5, 0.25))
    tables = [_unpacked(c) for c in slices]
    keys, both = np.concatenate([k for k, _ in tables]), np.concatenate([c for _, c in tables], axis=-1)
    kind = keys & np.uint64(3)
    counts = np.stack([np.where(kind == k, both, 0) for k in (SHORT, LONG)], axis=1).astype(np.float32)
    stops = np.where(kind == STOP, both[0], 0).astype(np.float32)
    return Edges(Index(keys), counts, stops, priors or _priors(*counts[:, 0].sum(axis=-1, dtype=np.float64).reshape(-1), *stops.sum(axis=-1, dtype=np.float64)))


def _gap_scores(text: str, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of every gap 0..len(text) to lie between two sentences, by its words alone, and by what follows alone."""
    stream, place = _stream(points(text))
    total = np.full(len(stream) + 1, -np.log(edges.priors[1] / (1 - edges.priors[1])), np.float32)
    for counts, prior, hashes in zip(edges.counts, edges.priors, _hashes(stream)):
        p = prior
        for table, ids, weight in zip(counts, hashes, (4, 2)):
            n, ends = _seen(edges.keys, table, ids)
            p = (ends + weight * p) / (n + weight)
        p = np.clip(p, 1e-5, 1 - 1e-5)
        side = np.log(p / (1 - p))
        total += side
    return total[place], side[place]


def _stop_evidence(text: str, edges: Edges) -> dict[str, float]:
    """For each word with a full stop in ``text`` the log of how much rarer it ends a line than full stops do,
    0 at most: strongly negative for abbreviations, whatever the language."""
    words = list({_stopped(m.group(1)) for m in STOPPED_WORD.finditer(text)})
    n, last = _seen(edges.keys, edges.stops, np.array([_stop_key(w) for w in words], np.uint64)).astype(float) if words else ((), ())
    share = edges.priors[2]
    out = {}
    for word, all_, at_end in zip(words, n, last):
        if word in NEVER_LAST:
            all_ += LISTED
        elif re.fullmatch(r"[^\W\d_]\.", word):
            all_ += INITIAL
        elif word in MAYBE_LAST or re.fullmatch(r"(?:[^\W\d_]\.)+", word):
            all_ += MAYBE
        out[word] = min(0.0, float(np.log((at_end + 2 * share) / ((all_ + 2) * share))))
    return out


def _seen(keys: Index, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The two counts of each key, 0 for one that occurs nowhere."""
    if not len(keys.keys):
        return np.zeros((2, len(ids)), np.float32)
    at = keys.places(ids)
    return np.stack([np.where(at < 0, 0, c[at]) for c in table])


def _line_ends(line: str, gap: np.ndarray, opens: np.ndarray, stops: dict[str, float], longest: int) -> list[int]:
    """Offsets just after each sentence of one line; ``gap`` and ``opens`` hold the scores of its gaps, ``stops`` those of its stopped words."""
    last = len(line.rstrip())
    if not ALNUM.search(line):
        return []
    mark = CUT_MARK.search(line, 0, last)
    quiet = mark.start() if mark else last  # a cut mark is no sentence of its own
    quotes = _Quotes(line)
    marks: dict[int, float] = {}
    taken: set[int] = set()  # gaps right before a mark: the sentence ends after it
    for m in CANDIDATE.finditer(line):
        end = m.end()
        taken.update(range(_trimmed(line, m.start()), m.start() + 1))
        if end < quiet:
            marks[end] = _mark_score(line, m, gap, opens, stops, quotes)
    edges = [0, *marks, last]
    for a, b in zip(edges, edges[1:]):
        if b - a > longest:
            _unmarked(line, gap, a, min(b, quiet), taken, marks)
    if not marks:
        return [last]
    spots = [0, *sorted(p for p, v in marks.items() if v >= -6 and not quotes.inside(p)), last]
    value = [0.0, *(marks[p] for p in spots[1:-1]), 0.0]
    best, most, back = [0.0] * len(spots), [0.0] * len(spots), [0] * len(spots)
    for j in range(1, len(spots)):
        end, top, came = spots[j], -1e9, 0
        for i in range(j - 1, -1, -1):
            # No earlier start can win: none had a better score, and the span only grows.
            if most[i] - max(0, end - spots[i] - USUAL) / 100 <= top:
                break
            score = best[i] + _span(line, spots[i], end, last, quotes)
            if score > top:
                top, came = score, i
        best[j], back[j] = top + value[j], came
        most[j] = max(most[j - 1], best[j])
    out, j = [], len(spots) - 1
    while j:
        out.append(spots[j])
        j = back[j]
    return out[::-1]


def _trimmed(line: str, end: int) -> int:
    """Where ``line[:end]`` ends without its last blanks."""
    while end and line[end - 1].isspace():
        end -= 1
    return end


def _word_at(line: str, end: int) -> str:
    """The blank-free stretch of ``line`` that ends at ``end``."""
    start = max(line.rfind(" ", 0, end), line.rfind("\t", 0, end), line.rfind("\u3000", 0, end), line.rfind("\u00a0", 0, end)) + 1
    return line[start:end]


class _Quotes:
    """The quoted and bracketed stretches of a line."""

    def __init__(self, line: str):
        self.line = line
        self.pairs = [(m.start(), m.end()) for m in QUOTED.finditer(line)]
        self.starts = [a for a, _ in self.pairs]
        self.closing: dict[int, int] = {}
        for a, b in self.pairs:
            self.closing[b] = a

    def inside(self, p: int) -> bool:
        """Whether a gap lies inside one; they never overlap."""
        k = bisect_left(self.starts, p) - 1
        return k >= 0 and p < self.pairs[k][1]

    def ending(self, end: int) -> int | None:
        """Where the stretch begins that ends at ``end``, blanks aside."""
        while end and end not in self.closing and self.line[end - 1].isspace():
            end -= 1
        return self.closing.get(end)

    def opens_sentence(self, end: int) -> bool:
        """Whether a quotation that begins a sentence ends here: it goes on with its attribution or its rest."""
        x = self.ending(end)
        if x is None or self.line[x] in BRACKETS:
            return False
        at = _trimmed(self.line, x)
        before = self.line[at - 1 : at]
        return LIST_MARKS.match(self.line).end() >= at or before in FULL_STOPS or before in ".!?" and _word_at(self.line, at).lower() not in NEVER_LAST


def _span(line: str, a: int, b: int, last: int, quotes: _Quotes) -> float:
    """Length and balance of a span as one sentence."""
    body = line[a:b]
    if not ALNUM.search(body):
        return -20.0  # without letters and digits it belongs to what stands before it
    score = 0.0
    inside = body.strip()
    if len(inside) < 4:
        score -= 2
    if b - a > USUAL:
        score -= (b - a - USUAL) / 100
    if b < last and quotes.pairs:
        x = quotes.ending(b)
        start = a + len(body) - len(body.lstrip())
        if x == start and line[x] not in BRACKETS and not quotes.opens_sentence(b):
            score -= GOES_ON  # a bare quotation goes on with its attribution or the rest of its sentence
    return score


def _mark_score(line: str, m: re.Match, gap: np.ndarray, opens: np.ndarray, stops: dict[str, float], quotes: _Quotes) -> float:
    """How far a mark with its closers ends a sentence: what the mark itself says, plus the words before and after it."""
    end, marks = m.end(), m.group()
    words = min(max(float(gap[end]), -6.0), 6.0)
    own = _shape_score(line, m, words, float(opens[end]), stops)
    return own + WORDS * words - (GOES_ON if quotes.opens_sentence(end) else 0)


def _shape_score(line: str, m: re.Match, words: float, opening: float, stops: dict[str, float]) -> float:
    end, marks = m.end(), m.group()
    core = marks.rstrip(CLOSERS)
    closed = len(core) < len(marks)
    after = line[end : end + 1]
    following = FOLLOWING.match(line, end).group(1)
    if any(c in FULL_STOPS or c == "|" for c in core):
        if closed and after and not after.isspace():
            # The quotation ends and the line goes on: with an opening known from sentence starts, or with the rest of its sentence.
            if marks[len(core)] in "）)】]":
                return 5.0
            said = max(line.rfind(c, 0, m.start()) for c in ":：")
            colon = said >= 0 and COLON.match(line[said : m.start()])
            return 4.0 if colon else min(3.0, words - 3)
        return 6.0
    if core.endswith("…") or core.endswith("..."):
        return -4.0 if not after or following.islower() else words - 2.0
    if not after:
        return 6.0
    if not after.isspace():
        wide = bool(_wide(np.array([ord(after)], np.uint64))[0])
        return -8.0 if closed or not wide or "." in core else 3.0 + words / 4
    if following.islower():
        return -8.0
    if "!" in core or "?" in core or closed:
        return 5.0
    if m.start() < 12 and ITEM_NUMBER.fullmatch(line, 0, m.start() + 1):
        return -8.0  # a number that opens a list item
    word = _word_at(line, m.start() + 1).lstrip("(“\"'‘[「『")
    against = STOPPED * stops.get(_stopped(word), 0.0)
    if against < -4 and word.islower() and word.count(".") == 1 and following.isupper() and word not in NEVER_LAST:
        return 2.0 + max(0.0, min(opening, 4.0))  # a small word before a capital more likely closes a phrase that always goes on
    # The less the word is known to close sentences, the more the words after it decide.
    return 5.0 + against + (min(max(opening, -4.0), 4.0) if against < -2 else 0.0)


def _unmarked(line: str, gap: np.ndarray, a: int, b: int, taken: set[int], marks: dict[int, float]) -> None:
    """Candidates inside a stretch without full stops: weak marks, wide blanks, and bare gaps whose words say so."""
    seen = set()
    for m in WEAK.finditer(line, a, b):
        end = m.end()
        if end < b and not THOUSANDS.match(line, max(m.start() - 1, 0)):
            wide_blank = line[m.start()] == "\u3000"
            marks[m.start() if wide_blank else end] = min(max(float(gap[end]), -8.0), 8.0) + (2.0 if wide_blank else WEAK_BIAS)
            seen.update(range(m.start(), end + 1))
    bare = BARE_BIAS if not seen else MARKED_BIAS  # where other marks stand, a sentence end without any is rarer
    for p in (np.flatnonzero(gap[a + 1 : b] > bare) + a + 1).tolist():
        before, after = line[p - 1], line[p]
        if p in seen or p in taken or before.isspace() or before.isdigit() and after.isdigit() or not (before.isalnum() or classes()[ord(before)] == MARK) or classes()[ord(after)] == MARK:
            continue
        if gap[p] >= gap[max(a + 1, p - 3) : p + 4].max():
            marks.setdefault(p, float(min(gap[p], 8.0)) - bare)


def _longest(line: str) -> int:
    """The stretch beyond which a line is searched for sentences that no mark ends."""
    c = next((c for c in line if c.isalpha()), "a")
    return 30 if "぀" <= c <= "鿿" else 60 if "가" <= c <= "힣" else 90


def sentence_ends(texts: list[str], edges: Edges) -> list[list[tuple[int, int]]]:
    """For each text its sentences as (start, end) code point offsets, in order."""
    out: list[list[tuple[int, int]]] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        joined = "\n".join(texts[i:j])
        gaps, opens = _gap_scores(joined, edges)
        stops = _stop_evidence(joined, edges)
        base = 0
        for text in texts[i:j]:
            spans, at = [], 0
            for line in text.split("\n"):
                if line and not line.isspace():
                    start = 0
                    here = slice(base + at, base + at + len(line) + 1)
                    for end in _line_ends(line, gaps[here], opens[here], stops, _longest(line)):
                        body = line[start:end]
                        first = start + len(body) - len(body.lstrip())
                        spans.append((at + first, at + start + len(body.rstrip())))
                        start = end
                at += len(line) + 1
            out.append(spans)
            base += len(text) + 1
        i = j
    return out


def _asked(texts: list[str]) -> np.ndarray:
    """Sorted keys of all gaps and stopped words of ``texts``."""
    held = []
    for t in _joined(texts):
        words = np.array([_stop_key(w) for w in {_stopped(m.group(1)) for m in STOPPED_WORD.finditer(t)}], np.uint64)
        held.append(distinct(np.concatenate([words, *(ids for lengths in _hashes(_stream(points(t))[0]) for ids in lengths)])))
    return distinct(np.concatenate(held))


def _answered(asks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """For each ask (slice, part, keys) the counts of its keys that occur."""
    rows = []
    if len(asks) and len(counted):
        keys, counts = _unpacked(counted["counts"].iloc[0])
        index = Index(keys)
        for part, asked in zip(asks["part"], asks["keys"]):
            at = index.places(_keys(asked))
            at = at[at >= 0]
            rows.append((part, int(asks["slice"].iloc[0]), _packed(keys[at], counts[:, :, at])))
    return pd.DataFrame(rows, columns=["part", "slice", "counts"])


def sentences(texts: DataFrame, edges: CountedEdges) -> DataFrame:
    """(tbl, doc_id, sent_no, start_char, end_char, sentence) of ``texts`` (tbl, doc_id, text).

    Null, empty and blank texts give no rows, lines without letters and digits neither; a
    repeated document counts once; offsets are code points from 0; other columns are ignored.
    The texts are dealt into parts, and each part asks the ranges of keys for its own.
    """
    slices, priors = edges.slices, edges.priors
    size = _characters(texts)
    parts = 1 + max(size // PART, min(texts.sparkSession.sparkContext.defaultParallelism, size // (PART // 16)))

    def once(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values(["tbl", "doc_id", "text"]).drop_duplicates(["tbl", "doc_id"])

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        keys = _asked(list(once(part)["text"]))
        at = _cuts(keys, slices)
        rows = [(i, int(part["part"].iloc[0]), _packed_keys(keys[a:b])) for i, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        return pd.DataFrame(rows, columns=["slice", "part", "keys"])

    def run(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        edges = edges_of(list(answers.sort_values("slice")["counts"]), priors)
        part = once(part)
        cols: list[list] = [[], [], [], [], [], []]
        for tbl, doc_id, text, spans in zip(part["tbl"], part["doc_id"], part["text"], sentence_ends(list(part["text"]), edges)):
            n = len(spans)
            cols[0] += [tbl] * n
            cols[1] += [doc_id] * n
            cols[2] += range(1, n + 1)
            cols[3] += [a for a, _ in spans]
            cols[4] += [b for _, b in spans]
            cols[5] += [text[a:b] for a, b in spans]
        return pd.DataFrame(dict(zip(("tbl", "doc_id", "sent_no", "start_char", "end_char", "sentence"), cols)))

    dealt = texts.select("tbl", "doc_id", "text").where("doc_id is not null and text is not null").withColumn("part", F.pmod(F.xxhash64("tbl", "doc_id"), F.lit(parts)).cast("int"))
    asks = dealt.groupBy("part").applyInPandas(ask, "slice int, part int, keys binary")
    answers = asks.groupBy("slice").cogroup(edges.rows.groupBy("slice")).applyInPandas(_answered, "part int, slice int, counts binary")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(run, "tbl string, doc_id string, sent_no int, start_char int, end_char int, sentence string")
