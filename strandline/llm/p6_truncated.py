"""Texts that stop before their end, and how often each source lets that happen.

The corpus vocabulary is laid out as two prefix tries, joined to how the documents end. The
nodes of the first are prefixes of words: a final token that is no word, but that words begin
with, is a fragment. The nodes of the second are what precedes each gap of the corpus: its
last words in three lengths and its whole unit so far, counted exactly for the nodes that
last lines ask for, with how often a unit ends there. It serves scripts without spaces and
cuts after whole words: a final phrase that elsewhere only leads on is cut, one that units
end with is complete. A length shared by suspiciously many unfinished texts adds its
likelihood to the evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import source_key
from strandline.llm.chars import LETTER, MARK, classes, points
from strandline.llm.p4_sentences import NEVER_LAST, _clear_ends, _joined, _stream, _wide, mixed
from strandline.session import settled

#: Bits of the filter that spares the counting of most keys no last line asks for; what it lets through is joined by the whole key.
FILTER, CONTEXTS = 26, 4
#: Marks that close a sentence, the marks a cut leaves behind, and opening and closing quotation marks.
FINAL = re.compile(r"[.!?。！？｡．۔؟।॥][\"'”’」』）)\]】》〉»*_\s]*\|?\s*$|[\u0900-\u097f]\|\s*$")
CUT_MARKS = re.compile(r"(\[\+\d+ chars\]|…|\.\.\.|�|&#?\w{0,6})\s*$")
BULLETS = re.compile(r"^[\s*•»—\-|>]+")
PAIRS = (("“", "”"), ("「", "」"), ("『", "』"), ("«", "»"), ("（", "）"))


def _contexts(stream: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Keys of what precedes each gap 0..n: three lengths of text and the whole unit so far."""
    n = len(stream)
    pad = np.concatenate((np.full(24, 10, np.uint64), stream))

    def join(a: np.ndarray, by: int) -> np.ndarray:
        h = (a[:-by] * np.uint64(0x9E3779B97F4A7C15)) ^ a[by:]
        return h ^ (h >> np.uint64(31))

    h1 = (pad + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h3 = (join(h1, 1)[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h1[2:]
    h6 = join(h3, 3)
    h12 = join(h6, 6)
    h24 = join(h12, 12)
    wide = np.concatenate(([False], _wide(stream)))
    pick = lambda a, k, b, m: np.where(wide, a[24 - k : 24 - k + n + 1], b[24 - m : 24 - m + n + 1])
    # Polynomial hash of stream[start:gap]; the base is odd, so powers of its inverse shift it to a common origin.
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
        up, down = powers(base), powers(inverse)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h1[24:] * up[:n])))
        whole = (sums - sums[starts]) * down[starts]
        whole ^= whole >> np.uint64(29)
    hashes = (pick(h3, 3, h6, 6), pick(h6, 6, h12, 12), pick(h12, 12, h24, 24), whole)
    return [mixed(h) & ~np.uint64(CONTEXTS - 1) | np.uint64(k) for k, h in enumerate(hashes)]


def _fold(text: str) -> str:
    """Lower case of the same length, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _unit_starts(text: str, place: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gap of the stream where its unit began, and the gaps at which a unit ends."""
    ends = np.unique(place[_clear_ends(text)])
    breaks = np.flatnonzero(stream == 10)
    begin = np.zeros(len(stream) + 1, np.int64)
    begin[ends] = ends
    begin[breaks + 1] = breaks + 1
    # A gap that ends a unit still looks back to that unit's own start.
    run = np.maximum.accumulate(begin)
    run[1:] = np.where(begin[1:] > 0, run[:-1], run[1:])
    return run, np.union1d(ends, breaks)  # a gap that is both ends one unit


def _count(batches: Iterator[pd.DataFrame], asked: np.ndarray) -> Iterator[pd.DataFrame]:
    """(key, n, ends) of the gaps whose keys the filter ``asked`` lets through: how often each occurs, and at an end."""
    for batch in batches:
        # Last lines count as endings too, cut or not: a reader of the counts takes its own away.
        for text in _joined(t.rstrip() + "\n" for t in batch["text"]):
            stream, place = _stream(points(_fold(text)))
            starts, ends = _unit_starts(text, place, stream)
            at_end = np.bincount(ends, minlength=len(stream) + 1)
            for ids in _contexts(stream, starts):
                found = np.flatnonzero(asked[(ids >> np.uint64(64 - FILTER)).astype(np.int64)])
                keys, inverse, n = np.unique(ids[found], return_inverse=True, return_counts=True)
                at = np.bincount(inverse, weights=at_end[found], minlength=len(keys))
                yield pd.DataFrame({"key": keys.view(np.int64), "n": n, "ends": at.astype(np.int64)})


def _filter(asked: DataFrame) -> np.ndarray:
    """Which prefixes of keys are asked for, as one byte each: whatever the corpus, at most 2^20 words of 64 come to the driver."""
    prefix = F.shiftrightunsigned("key", 64 - FILTER)
    words = asked.select(prefix.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER - 6), np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table


def ending_counts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, n, ends) of the keys of ``asked`` (key) over all of ``docs`` (text): exact, and nothing for other keys."""
    keys = asked.select("key").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_filter(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _count(batches, np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool))

    counted = docs.select("text").mapInPandas(run, "key long, n long, ends long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(keys, "key", "left_semi")


def _line_keys(texts: list[str]) -> np.ndarray:
    """The keys of these last lines as wholes, of shape (context, lines)."""
    text = "".join(x.strip().replace("\n", " ") + "\n" for x in texts)
    stream, place = _stream(points(_fold(text)))
    starts, _ = _unit_starts(text, place, stream)
    at = np.flatnonzero(stream == 10)
    return np.stack([ids[at] for ids in _contexts(stream, starts)]).view(np.int64)


def _ending_odds(counts: list[tuple[F.Column, F.Column]]) -> F.Column:
    """Log-odds that a last line is a whole unit, from the longest context seen elsewhere; counts of its contexts, its own taken away."""
    # Both shares are carried on: 1 - p would be 0 once a line has ended some ten thousand times in every context.
    p, q = F.lit(0.5), F.lit(0.5)
    for n, ends in counts:
        p, q = (ends + 2 * p) / (n + 2), (n - ends + 2 * q) / (n + 2)
    # ``n`` and ``ends`` are now those of the whole unit: one that stands complete elsewhere is complete, though longer ones begin like it.
    odds = p / q
    return F.log(F.when((ends >= 3) & (10 * ends >= n), F.greatest(odds, F.lit(9.0))).otherwise(odds))


def last_unit(text: str) -> tuple[str, str, bool, bool, bool, bool]:
    """(bare, token, mark, final, quote, abbreviation) of a text's last line.

    ``bare`` is the line without list and page marks, empty if it holds no letters or digits;
    ``token`` its last word if the line ends in one; then whether a cut mark ends it, a final
    mark does, a quotation stays open, and the final mark is an abbreviation's.
    """
    line = text.rstrip().rpartition("\n")[2]
    bare = BULLETS.sub("", line).rstrip(" \t\u3000|")
    if not any(c.isalnum() for c in bare):
        return "", "", False, False, False, False
    start, kinds = len(bare), classes()
    while start and kinds[ord(bare[start - 1])] in (LETTER, MARK):
        start -= 1
    opened = any(line.count(a) > line.count(b) for a, b in PAIRS)
    final = bool(FINAL.search(line))
    return bare, bare[start:].lower(), bool(CUT_MARKS.search(line)), final, opened, final and line.rsplit(None, 1)[-1].lower() in NEVER_LAST


def _word_trie(docs: DataFrame, finals: DataFrame) -> DataFrame:
    """(token, known, leads_on): for each final token whether it is a word and whether longer words begin with it.

    The trie's nodes are the prefixes of the corpus words (seen twice at least other than as a last
    token), as long as the tokens are, joined to the tokens by key.
    """
    words = docs.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{M}]+', 0)")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    last = finals.groupBy("token").agg(F.count("*").alias("last"))
    words = words.join(last, "token", "left").where("n - coalesce(last, 0) >= 2").select(F.col("token").alias("word"))
    lengths = last.agg(F.collect_set(F.length("token")).alias("lengths"))  # one row
    nodes = words.crossJoin(F.broadcast(lengths)).select(F.explode(F.expr("transform(filter(lengths, i -> i <= length(word)), i -> struct(substring(word, 1, i) AS token, i = length(word) AS whole))")).alias("n")).select("n.*")
    nodes = nodes.join(last.select("token"), "token", "left_semi")
    return nodes.groupBy("token").agg(F.bool_or("whole").alias("known"), F.bool_or(~F.col("whole")).alias("leads_on"))


def _leads_on(counts: list[tuple[F.Column, F.Column]]) -> F.Column:
    """Whether the longest phrase seen elsewhere is an inner node of the trie only: units go on after it, none ends."""
    only = F.lit(False)
    for n, ends in counts:
        only = F.when(n > 0, ends == 0).otherwise(only)
    return only


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, cut, evidence, score): every document with the verdict on its text.

    ``evidence`` is one of mark, quote, abbreviation, prefix (a fragment of a word), phrase (a phrase
    that only leads on), ending (one that seldom ends a unit), none. Null, empty and blank texts are
    not cut; a repeated document counts once; other columns are ignored.
    """
    once = settled(docs.select("doc_id", "text").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, len(t), *last_unit(t)) for d, t in zip(batch["doc_id"], batch["text"])]
            out = pd.DataFrame(rows, columns=["doc_id", "n", "bare", "token", "mark", "final", "quote", "abbreviation"])
            out = out[out["bare"] != ""].reset_index(drop=True)
            ask = np.flatnonzero(~(out["mark"] | out["final"]).to_numpy(bool))
            keys: list = [None] * len(out)
            for i, row in zip(ask, _line_keys(list(out["bare"].iloc[ask])).T.tolist()):
                keys[i] = row
            yield out.drop(columns="bare").assign(keys=keys)

    lines = settled(once.mapInPandas(run, "doc_id string, n int, token string, mark boolean, final boolean, quote boolean, abbreviation boolean, keys array<long>"))
    asked = lines.select("doc_id", F.posexplode("keys").alias("k", "key"))
    seen = asked.join(ending_counts(once, asked), "key").groupBy("doc_id")
    seen = seen.agg(*(F.max(F.when(F.col("k") == k, F.greatest(F.col(c) - 1, F.lit(0)))).alias(f"{c}{k}") for k in range(CONTEXTS) for c in ("n", "ends")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = [(zero(f"n{k}"), zero(f"ends{k}")) for k in range(CONTEXTS)]
    open_ended = F.col("keys").isNotNull()
    lines = lines.join(seen, "doc_id", "left").withColumn("odds", F.when(open_ended, _ending_odds(nodes)).otherwise(0.0)).withColumn("phrase", open_ended & _leads_on(nodes))
    judged = settled(lines.select("doc_id", "n", "token", "mark", "final", "quote", "abbreviation", "odds", "phrase"))
    trie = _word_trie(once, judged.where("not final and not mark and token <> ''"))
    out = judged.join(trie, "token", "left").join(_length_evidence(judged), "n", "left")
    fragment = (F.length("token") > 0) & ~F.coalesce("known", F.lit(False)) & F.coalesce("leads_on", F.lit(False))
    unfinished = -F.col("odds") + F.when(fragment, 3.0).otherwise(0.0) + F.coalesce("likelihood", F.lit(0.0))
    score = F.when(F.col("mark"), 9.0).when(F.col("final"), F.when(F.col("quote"), 2.0).when(F.col("abbreviation"), 2.0).otherwise(-9.0)).otherwise(unfinished)
    why = F.when(F.col("score") <= 0, "none").when(F.col("mark"), "mark").when(F.col("final") & F.col("quote"), "quote").when(F.col("final"), "abbreviation").when(fragment, "prefix").when(F.col("phrase"), "phrase").otherwise("ending")
    return out.withColumn("score", score).select("doc_id", (F.col("score") > 0).alias("cut"), why.alias("evidence"), "score")


def _length_evidence(judged: DataFrame) -> DataFrame:
    """(n, likelihood): the lengths at which many more texts stop unfinished than at their neighbours, with the log of how many more."""
    stops = judged.where("not final and not mark and odds < 0").groupBy("n").agg(F.count("*").alias("here"))
    near = stops.select(F.explode(F.expr("sequence(n - 10, n + 10)")).alias("n"), "here").groupBy("n").agg((F.sum("here") / 21).alias("usual"))
    return stops.join(near, "n").where("here >= 4 and here > 4 * usual").select("n", F.log(F.col("here") / F.col("usual")).alias("likelihood"))


def truncation_rates(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, docs, cut_docs, rate) per source name, ignoring case and surplus spaces."""
    named = sources.select("doc_id", source_key(F.col("source_name")).alias("source")).where("doc_id is not null and source is not null").distinct()
    per = verdicts.join(named, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.count_if("cut").alias("cut_docs"))
    return per.withColumn("rate", F.round(F.col("cut_docs") / F.col("docs"), 6))
