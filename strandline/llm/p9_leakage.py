"""Evaluation passages inside a corpus, found through a distributed positional inverted index.

Terms are hashed k-grams of letters and digits. A first pass counts in how many documents
each test term stands; of every test item the rarest term of each block is kept, the blocks
being so short that any stretch of half the item covers four whole (fewer in items of a few
letters). A second pass stores the postings (term, document, position) of those terms as a
table. Joined to the terms' places in the items, postings become offsets; where the lists of
half as many terms meet at one offset, or at neighbouring ones, the document is read again and the
exact common stretches are measured.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.chars import DIGIT, LETTER, classes, points
from strandline.llm.p4_sentences import distinct
from strandline.operators.joins import sized
from strandline.session import settled

SIZES = (16, 8, 4, 2, 1)
CHUNK = 1_000_000
SIEVE_BITS = 24
#: Characters of items that are searched for at once; larger sets are run block after block.
BLOCK_CHARS = 4_000_000
#: Items of which half is shorter than this are searched for as they stand.
TINY = 4
#: Stretches whose offsets differ by up to half of this many letters lie in proximity.
BAND = 64


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in one array, compatibility forms, case and all else removed,
    and the bounds of each text; a 0 ends every text."""
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    # Text by text: most are in normal form already, which is found out fast.
    at = points("\x00".join(nfkc(nfkc(t.replace("\x00", " ")).casefold()) for t in texts) + "\x00")
    kind = classes()[at]
    at = at[(kind == LETTER) | (kind == DIGIT) | (at == 0)]
    return at, np.concatenate(([0], np.flatnonzero(at == 0) + 1))


def grams(at: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the k letters from each position, for every k of SIZES."""
    h = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, k = {1: h}, 1
    while k < SIZES[0]:
        if len(h) <= k:
            h = h[:0]
        else:
            h = (h[:-k] * np.uint64(0x9E3779B97F4A7C15)) ^ h[k:]
            h ^= h >> np.uint64(31)
        k *= 2
        out[k] = h
    return out


def _sieve(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


@dataclass
class Terms:
    """Test terms of one gram size: sorted hashes, and a bit table that lets most of the corpus pass by."""

    k: int
    hashes: np.ndarray

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        bits[_sieve(self.hashes)] = True
        return bits

    def hits(self, h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a test term, and its number."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.flatnonzero(table[_sieve(h)])
        found = np.searchsorted(self.hashes, h[where])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == h[where]
        return where[same], found[same]


@dataclass
class Places:
    """Where the terms of one gram size stand: number of the item, place in it, number of the term; items in order."""

    terms: Terms
    item: np.ndarray
    at: np.ndarray
    term: np.ndarray


def _places(items: list[np.ndarray]) -> list[Places]:
    """Every term of every item, in the largest gram size of which half the item holds two."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, at in enumerate(items):
        half = (len(at) + 1) // 2
        if half >= TINY:
            k = next(k for k in SIZES if k <= half // 2)
            by.setdefault(k, []).append((i, grams(at)[k]))
    out = []
    for k, own in by.items():
        hashes, term = np.unique(np.concatenate([h for _, h in own]), return_inverse=True)
        out.append(Places(Terms(k, hashes), np.concatenate([np.full(len(h), i) for i, h in own]), np.concatenate([np.arange(len(h)) for _, h in own]), term))
    return out


def blocks_of(letters_: int, k: int) -> tuple[int, int]:
    """(length of a block in terms, how many rare terms must meet): half of the whole blocks that any
    unbroken stretch of half the item holds, so that broken ones are measured too."""
    terms = (letters_ + 1) // 2 - k + 1
    block = max(1, (terms + 1) // 5)
    return block, max(1, ((terms + 1) // block - 1) // 2)


def _anchors(places: Places, items: list[np.ndarray], docs_with: np.ndarray) -> Places:
    """The rarest term of each block of each item."""
    keep = []
    edges = np.flatnonzero(np.diff(places.item, prepend=-1, append=-1))
    for start, stop in zip(edges, edges[1:]):
        rare = docs_with[places.term[start:stop]]
        block, _ = blocks_of(len(items[places.item[start]]), places.terms.k)
        keep += [start + a + int(rare[a : a + block].argmin()) for a in range(0, stop - start, block)]
    keep = np.array(keep)
    used, term = np.unique(places.term[keep], return_inverse=True)
    return Places(Terms(places.terms.k, places.terms.hashes[used]), places.item[keep], places.at[keep], term)


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    group = batch["text"].str.len().cumsum() // CHUNK
    for _, part in batch.groupby(group, sort=False):
        yield part


def stretches(doc: np.ndarray, item: np.ndarray, shifts: list[int], least: int, share: float) -> list[tuple[int, int, int, str]]:
    """(doc_at, item_at, common, kind) of the longest unbroken common stretch, and of the best set of stretches
    of ``least`` letters or more at neighbouring offsets, each if it makes up ``share`` of the item."""
    runs = []  # (shift, begin in the item, end)
    for shift in sorted(set(shifts)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        if low >= high:
            continue
        same = np.concatenate(([False], doc[shift + low : shift + high] == item[low:high], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] >= least]
        runs += [(shift, int(low + a), int(low + b)) for a, b in edge]
    if not runs:
        return []
    shift, a, b = max(runs, key=lambda r: (r[2] - r[1], -r[0]))
    if b - a >= share * len(item):
        return [(shift + a, a, b - a, "exact" if b - a == len(item) else "partial")]
    if least < SIZES[0]:
        return []
    best, at, first = 0, None, 0
    for r, (shift, _, _) in enumerate(runs):  # in order of the offsets
        while runs[first][0] < shift - BAND // 2:
            first += 1
        mask = np.zeros(len(item), bool)
        for _, a, b in runs[first : r + 1]:
            mask[a:b] = True
        if mask.sum() > best:
            best, at = int(mask.sum()), min(runs[first : r + 1], key=lambda x: x[1])
    return [(at[0] + at[1], at[1], best, "near")] if best >= share * len(item) else []


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, common, letters, kind): what each document shares with each item of which
    it holds ``share`` or more, counted in letters and digits.

    ``doc_at`` and ``item_at`` are offsets among the letters and digits; kind is ``exact`` for a whole
    item, ``partial`` for one unbroken stretch, ``near`` for stretches in proximity: at offsets that
    differ by up to 32 letters, holding at least half as many of the item's rare terms as any unbroken
    stretch does; items under 64 letters are searched for unbroken only. Null and empty texts and items
    without letters or digits give no rows, repeated rows give equal rows once, other columns are
    ignored. Items are a stated query set, held in every worker ``block_chars`` at a time; as many
    blocks are run as the set needs.
    """
    if not 0.5 <= share <= 1:
        raise ValueError("share must be from 0.5 to 1")
    known = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    blocks = 1 + (known.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    found = [_block_leaks(docs, known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), share) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _block_leaks(docs: DataFrame, known: DataFrame, share: float) -> DataFrame:
    spark = docs.sparkSession
    rows = known.orderBy("item_id", "text").collect()
    at, bounds = letters([r.text for r in rows])
    own = [at[a : b - 1] for a, b in zip(bounds, bounds[1:])]
    corpus = docs.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    kind = dict(corpus.dtypes)["doc_id"]
    places = _places(own)
    anchors = [_anchors(p, own, n) for p, n in zip(places, _documents_with(corpus, [p.terms for p in places]))]
    postings = settled(_postings(corpus, [a.terms for a in anchors]))
    # One row per anchor, a few for each item of the block: bounded, whatever the corpus.
    table = pd.DataFrame(
        [(g, int(t), int(i), int(a), blocks_of(len(own[i]), p.terms.k)[1]) for g, p in enumerate(anchors) for t, i, a in zip(p.term, p.item, p.at)],
        columns=["g", "term", "item", "item_at", "need"],
    )
    schema = "g int, term int, item int, item_at int, need int"
    spots = spark.createDataFrame(table, schema) if len(table) else spark.createDataFrame([], schema)
    met = postings.join(F.broadcast(spots), ["g", "term"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    half = F.lit(BAND // 2)
    bands = F.array(2 * F.floor(F.col("shift") / BAND), 2 * F.floor((F.col("shift") + half) / BAND) + 1)
    met = met.select("doc_id", "item", "need", "item_at", "shift", F.explode(bands).alias("band"))
    met = met.groupBy("doc_id", "item", "band").agg(F.max("need").alias("need"), F.collect_set("item_at").alias("terms"), F.collect_set("shift").alias("shifts"))
    met = met.where(F.size("terms") >= F.col("need")).select("doc_id", "item", F.explode("shifts").alias("shift"))
    wanted = settled(met.groupBy("doc_id").agg(F.collect_set(F.struct("item", "shift")).alias("spots")))
    shared = spark.sparkContext.broadcast((own, [r.item_id for r in rows], {int(i): p.terms.k for p in anchors for i in p.item}))
    columns = ["doc_id", "item_id", "doc_at", "item_at", "common", "letters", "kind"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids, least = shared.value
        for batch in batches:
            out = []
            for part in _chunks(batch):
                at, bounds = letters(list(part["text"]))
                for n, (doc_id, spots) in enumerate(zip(part["doc_id"], part["spots"])):
                    doc, by = at[bounds[n] : bounds[n + 1] - 1], {}
                    for spot in spots:
                        by.setdefault(spot["item"], []).append(spot["shift"])
                    for i, shifts in by.items():
                        out += [(doc_id, ids[i], *x[:3], len(own[i]), x[3]) for x in stretches(doc, own[i], shifts, least[i], share)]
            yield pd.DataFrame(out, columns=columns)

    def tiny(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids, least = shared.value
        short = [(i, "".join(map(chr, at))) for i, at in enumerate(own) if len(at) and i not in least]
        for batch in batches:
            out = []
            for part in _chunks(batch):
                at, bounds = letters(list(part["text"]))
                for n, doc_id in enumerate(part["doc_id"]):
                    doc = "".join(map(chr, at[bounds[n] : bounds[n + 1] - 1]))
                    for i, text in short:
                        tries = ((doc.find(text[a : a + size]), a, size) for size in range(len(text), int(np.ceil(share * len(text))) - 1, -1) for a in range(len(text) - size + 1))
                        hit = next((t for t in tries if t[0] >= 0), None)
                        if hit:
                            out.append((doc_id, ids[i], *hit, len(text), "exact" if hit[2] == len(text) else "partial"))
            yield pd.DataFrame(out, columns=columns)

    out_schema = f"doc_id {kind}, item_id {dict(known.dtypes)['item_id']}, doc_at int, item_at int, common int, letters int, kind string"
    found = corpus.join(sized(wanted), "doc_id").mapInPandas(measure, out_schema)
    if any(0 < (len(a) + 1) // 2 < TINY for a in own):
        found = found.unionByName(corpus.mapInPandas(tiny, out_schema))
    rank = F.struct(F.col("kind") != "near", "common", -F.col("doc_at"), -F.col("item_at"))
    # Repeated rows of a document and texts that give several items one id give one row, the longest.
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*columns[2:]), rank).alias("x")).select("doc_id", "item_id", "x.*")


def _documents_with(corpus: DataFrame, terms: list[Terms]) -> list[np.ndarray]:
    """For each size the number of documents that hold each term."""
    shared = corpus.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        tables = [t.table() for t in terms]
        totals = [np.zeros(len(t.hashes), np.int64) for t in terms]
        for batch in batches:
            for part in _chunks(batch):
                at, bounds = letters(list(part["text"]))
                of_size = grams(at)
                for t, table, total in zip(terms, tables, totals):
                    where, term = t.hits(of_size[t.k], table)
                    doc = np.searchsorted(bounds, where, side="right")
                    pair = distinct(doc * len(t.hashes) + term)
                    total += np.bincount(pair % max(1, len(t.hashes)), minlength=len(t.hashes))
        for g, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pd.DataFrame({"g": g, "term": some, "n": total[some]})

    counts = [np.zeros(len(t.hashes), np.int64) for t in terms]
    # At most one row per term of the block of items, whatever the corpus.
    for r in corpus.select("text").mapInPandas(count, "g int, term bigint, n bigint").groupBy("g", "term").agg(F.sum("n").alias("n")).collect():
        counts[r.g][r.term] = r.n
    return counts


def _postings(corpus: DataFrame, terms: list[Terms]) -> DataFrame:
    """(g, term, doc_id, doc_at): every place of every term in the corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        tables = [t.table() for t in terms]
        for batch in batches:
            for part in _chunks(batch):
                at, bounds = letters(list(part["text"]))
                of_size, ids = grams(at), part["doc_id"].to_numpy()
                for g, (t, table) in enumerate(zip(terms, tables)):
                    where, term = t.hits(of_size[t.k], table)
                    doc = np.searchsorted(bounds, where, side="right") - 1
                    yield pd.DataFrame({"g": g, "term": term, "doc_id": ids[doc], "doc_at": where - bounds[doc]})

    return corpus.mapInPandas(run, f"g int, term int, doc_id {dict(corpus.dtypes)['doc_id']}, doc_at int").distinct()
