"""Languages of documents and of foreign passages in them.

A multinomial naive Bayes model over hashed character 1- to 3-grams is fitted on the two
small reference tables and on a bounded sample of labelled documents that the first fit
confirms. Its log-probability matrix (2**bits x languages, a few megabytes whatever the
corpus) is broadcast; batches of lines are scored by gathering matrix rows in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.chars import LETTER, MARK, classes, points

#: The languages told apart, and the tags of each in two- and three-letter notation.
LANGUAGES = ("en", "ko", "zh", "zh-Hant", "ja", "hi", "ur")
TAGS = {"en": "en", "eng": "en", "ko": "ko", "kor": "ko", "ja": "ja", "jpn": "ja", "hi": "hi", "hin": "hi", "ur": "ur", "urd": "ur"}
CHINESE = ("zh", "zho", "chi", "cmn")
TRADITIONAL = ("hant", "tw", "hk", "mo")

#: Web addresses and long strings that are no words; they decide nothing.
ADDRESS = re.compile(r"(?:https?://|www\.)[!-~]*|[\w.+-]+@[\w-]+\.[A-Za-z.]+|\b[\w-]+(?:\.[\w-]+)+/[!-~]*")
ASCII_RUN = re.compile(r"[A-Za-z0-9+/=_-]{12,}")
MIN_SEGMENT = 40
CHUNK = 1_000_000


def _no_word(run: str) -> bool:
    """A run of ASCII letters and digits that no text of words holds, like a digest or an encoded block."""
    digits, vowels = sum(c.isdigit() for c in run), sum(c in "aeiouAEIOU" for c in run)
    letters = sum(c.isalpha() for c in run)
    turns = sum(a.islower() and b.isupper() for a, b in zip(run, run[1:]))
    return digits * 8 > len(run) and letters > 2 or letters >= 12 and vowels * 5 < letters or letters >= 20 and turns * 4 > letters


def words_only(text: str) -> str:
    """``text`` with addresses and non-words blanked, lengths kept."""
    if "." in text or "://" in text:
        text = ADDRESS.sub(lambda m: " " * len(m.group()), text)
    return ASCII_RUN.sub(lambda m: " " * len(m.group()) if _no_word(m.group()) else m.group(), text)


def tag_language(label: Column) -> Column:
    """The language a tag stands for, null if it is none of ours: case, region and three letters allowed."""
    parts = F.split(F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-")), "-")
    first = parts[0]
    plain = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    old = F.exists(F.slice(parts, 2, 8), lambda x: x.isin(*TRADITIONAL)) & ~F.array_contains(parts, "hans")
    return F.when(first.isin(*CHINESE), F.when(old, F.lit("zh-Hant")).otherwise(F.lit("zh"))).otherwise(F.try_element_at(plain, first))


@dataclass
class Model:
    """``logp[h, c]``: log-probability of the n-gram bucket h under language c."""

    bits: int
    logp: np.ndarray

    def grams(self, at: np.ndarray) -> list[np.ndarray]:
        return [_buckets(at, n, self.bits) for n in (1, 2, 3)]

    def score(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (lines x languages) and the number of letters of each line."""
        scores, letters = np.zeros((len(lines), len(LANGUAGES))), np.zeros(len(lines), np.int64)
        start = 0
        while start < len(lines):
            end, size = start, 0
            while end < len(lines) and (size < CHUNK or end == start):
                size += len(lines[end])
                end += 1
            self._chunk(lines[start:end], scores[start:end], letters[start:end])
            start = end
        return scores, letters

    def _chunk(self, lines: list[str], scores: np.ndarray, letters: np.ndarray) -> None:
        at = points("\n".join(lines).lower())
        if not len(at):
            return
        kind = classes()[at]
        word = (kind == LETTER) | (kind == MARK)
        row = np.cumsum(at == 10)  # the row a position belongs to; a line break counts to the next
        letters += np.bincount(row[word], minlength=len(lines))
        folded = np.where(word, at, 32).astype(np.uint64)
        for n, ids in enumerate(self.grams(folded), 1):
            whole = word.copy() if n == 1 else _any_word(word, n)
            whole = whole[: len(ids)]
            np.logical_and(whole, row[: len(ids)] == row[n - 1 :], out=whole)
            use, of = ids[whole], row[: len(ids)][whole]
            if len(use):
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                scores[of[first]] += np.add.reduceat(self.logp[use], first, axis=0, dtype=np.float64)


def _any_word(word: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n-gram has a letter first or, after a blank, second: word starts count, runs of blanks do not."""
    out = word.copy()
    out[:-1] |= word[1:]
    return out


def _buckets(at: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = at[: len(at) - n + 1].astype(np.uint64) + np.uint64(n << 40)
    for k in range(1, n):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (at[k : len(at) - n + 1 + k].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def fit(texts: list[tuple[str, str]], bits: int = 17, alpha: float = 0.05) -> Model:
    """Multinomial naive Bayes with uniform priors over (language, text) rows."""
    counts = np.zeros((1 << bits, len(LANGUAGES)))
    for c, lang in enumerate(LANGUAGES):
        at = points("\n".join(words_only(t).lower() for k, t in texts if k == lang and t))
        kind = classes()[at]
        word = (kind == LETTER) | (kind == MARK)
        folded = np.where(word, at, 32).astype(np.uint64)
        for n in (1, 2, 3) if len(at) >= 3 else ():
            ids = _buckets(folded, n, bits)
            counts[:, c] += np.bincount(ids[(word if n == 1 else _any_word(word, n))[: len(ids)]], minlength=1 << bits)
    logp = np.log((counts + alpha) / (counts.sum(0) + alpha * len(counts)))
    return Model(bits, logp.astype(np.float32))


def train(labelled: DataFrame, documents: DataFrame | None = None, sample: int = 3000) -> Model:
    """Fit on ``labelled`` (lang, text), a small reference table, then again with about ``sample``
    rows, picked by a hash of the id, of ``documents`` (doc_id, lang, text) whose label the first fit confirms."""
    rows = [(r.lang, r.text) for r in labelled.select("lang", "text").where("lang is not null and text is not null").collect()]
    model = fit(rows)
    if documents is None or not sample:
        return model
    more = documents.select("doc_id", tag_language(F.col("lang")).alias("lang"), "text").where("lang is not null and length(text) >= 40")
    share = min(1.0, sample / max(more.count(), 1))
    picked = more.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)).select("lang", "text").collect()
    scores, _ = model.score([words_only(r.text).replace("\n", " ") for r in picked])
    best = scores.argmax(1) if len(picked) else []
    return fit(rows + [(r.lang, r.text) for r, b in zip(picked, best) if LANGUAGES[b] == r.lang])


#: How much a letter of each language weighs when it is asked which language most of the text is in.
WEIGHT = np.ones(len(LANGUAGES))


def _confidence(score: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Posterior of the best language, tempered as if one letter in eight were independent evidence."""
    z = (score - score.max(1, keepdims=True)) / 8
    return 1 / np.exp(np.clip(z, -50, 0)).sum(1)


def languages(docs: DataFrame, model: Model, min_segment: int = MIN_SEGMENT) -> DataFrame:
    """(doc_id, seg_no, lang, confidence): segment 0 for every document, then its foreign lines by number.

    A text without letters gets a null language with confidence 0; null texts and ids give no
    rows; a repeated document counts once; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            split = [t.split("\n") for t in batch["text"]]
            bounds = np.cumsum([0, *map(len, split)])
            flat = [words_only(x).replace("\n", " ") for lines in split for x in lines]
            scores, letters = model.score(flat)
            best, sure = scores.argmax(1), _confidence(scores, letters)
            for doc_id, lines, a, b in zip(batch["doc_id"], split, bounds, bounds[1:]):
                mass = np.bincount(best[a:b], weights=letters[a:b] * WEIGHT[best[a:b]], minlength=len(LANGUAGES))
                if not mass.sum():
                    out.append((doc_id, 0, None, 0.0))
                    continue
                main = int(mass.argmax())
                own = best[a:b] == main
                out.append((doc_id, 0, LANGUAGES[main], float(mass[main] / mass.sum() * np.average(sure[a:b][own], weights=letters[a:b][own]))))
                for i in np.flatnonzero(~own & (letters[a:b] >= min_segment // 3)):
                    if len(lines[i].strip()) >= min_segment and 2 * letters[a + i] >= len(flat[a + i].replace(" ", "")) - 12:
                        out.append((doc_id, int(i) + 1, LANGUAGES[best[a + i]], float(sure[a + i])))
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "lang", "confidence"])

    once = docs.select("doc_id", "text").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    return once.mapInPandas(run, "doc_id string, seg_no int, lang string, confidence double")


def mislabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): documents whose label in ``labels`` is absent or wrong, and foreign lines.

    A document with several labels is held against the one collected last; one without a row
    in ``labels`` has no label to be wrong.
    """
    label = F.struct("collected_at", tag_language(F.col("language")).alias("said")) if "collected_at" in labels.columns else F.struct(tag_language(F.col("language")).alias("said"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("label"))
    wrong = F.col("label").isNotNull() & F.col("lang").isNotNull() & ~F.col("label.said").eqNullSafe(F.col("lang"))
    return found.join(said, "doc_id", "left").where((F.col("seg_no") > 0) | wrong).select("doc_id", "seg_no", "lang")
