"""Reading level of documents by gradient-boosted regression trees.

Features are distributions over a document's sentences: lengths, word lengths, clause marks
and numbers (syntax), vocabulary evidence for each level from hashed character n-grams, and
what neighbouring sentences share of their n-grams and evidence (cohesion). The trees are fitted on the small labelled
table; their cross-validated predictions give the calibrated thresholds between levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.chars import DIGIT, LETTER, MARK, PUNCT, classes, points
from strandline.llm.p3_language import _any_word, _buckets
from strandline.llm.p4_sentences import distinct

LEVELS = (1, 2, 3)
BITS = 16
CHUNK = 1_000_000
FOLDS = 5
#: Marks that end a sentence in any script, and marks between clauses.
STOPS = ".!?。！？｡．۔؟।॥"
CLAUSES = ",;:，、；：،؛—"
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass
class Vocabulary:
    """Log-probabilities of n-gram buckets under each level, from labelled texts."""

    logp: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, alpha: float = 0.3) -> Vocabulary:
        """From the counts of buckets by level."""
        return Vocabulary(np.log((counts + alpha) / (counts.sum(0) + alpha * len(counts))).astype(np.float32))


def _bucket_counts(texts: list[str], levels: np.ndarray) -> np.ndarray:
    counts = np.zeros((1 << BITS, len(LEVELS)))
    for text, level in zip(texts, levels):
        for ids, _ in _text_grams(*_folded(points(text.lower()))):
            counts[:, LEVELS.index(level)] += np.bincount(ids, minlength=1 << BITS)
    return counts


def _folded(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = classes()[at]
    word = (kind == LETTER) | (kind == MARK)
    return np.where(word, at, 32).astype(np.uint64), word


def _text_grams(folded: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position) of the 2- and 4-grams of a text's words."""
    for n in (2, 4):
        ids = _buckets(folded, n, BITS)
        at = np.flatnonzero(_any_word(word, n)[: len(ids)])
        yield ids[at], at


def features(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """One row of features per text; a text without letters gets zeros."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < CHUNK):
            size += len(texts[j])
            j += 1
        out.append(_features(texts[i:j], vocabulary))
        i = j
    return np.concatenate(out) if out else np.zeros((0, 1))


def _features(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    joined = "\n\x00".join(texts) + "\n\x00"
    low = joined.lower()
    at = points(low if len(low) == len(joined) else joined)
    kind = classes()[at]
    letter, mark, digit = kind == LETTER, kind == MARK, kind == DIGIT
    word = letter | mark
    doc = np.concatenate(([0], np.cumsum(at == 0)[:-1]))
    stop = np.isin(at, points(STOPS))
    # An ASCII stop ends a sentence only before a blank; other stops always; so does a line break.
    wide_stop = stop & (at > 127)
    after = np.append(at[1:], 10)
    end = wide_stop | stop & (after <= 32) | (at == 10)
    sentence = np.concatenate(([0], np.cumsum(end)[:-1]))
    n = sentence[-1] + 1
    count = lambda mask: np.bincount(sentence[mask], minlength=n).astype(float)
    size = count(word | digit)
    of = np.zeros(n, np.int64)
    of[sentence] = doc
    # In scripts without spaces a character says about as much as two and a half letters.
    wide = np.isin(at >> 8, np.arange(0x30, 0xA0)) & letter
    hangul = (at >= 0xAC00) & (at < 0xD7A4)
    scaled = size + 1.6 * count(wide) + 0.9 * count(hangul)
    begin = word & ~np.concatenate(([False], word[:-1]))
    words = count(begin)
    clause, number = count(np.isin(at, points(CLAUSES))), count(digit & ~np.concatenate(([False], digit[:-1])))
    punct = count(kind == PUNCT)
    evidence = np.zeros((n, len(LEVELS)))
    folded = np.where(word, at, 32).astype(np.uint64)
    total = np.zeros(n)
    longest = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for ids, place in _text_grams(folded, word):
        if len(ids):
            s = sentence[place]
            longest = s, ids
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            evidence[s[first]] += np.add.reduceat(vocabulary.logp[ids], first, axis=0, dtype=np.float64)
            total += np.bincount(s, minlength=n)
    real = size >= 2
    ev = evidence - evidence.max(1, keepdims=True)
    share = np.exp(np.clip(ev / 4, -30, 0))
    share /= share.sum(1, keepdims=True)
    margin = (evidence - evidence.mean(1, keepdims=True)) / np.maximum(total, 1)[:, None]
    rows = []
    D = len(texts)
    keep = np.flatnonzero(real)
    d = of[keep]
    docs = np.bincount(d, minlength=D).astype(float)
    mean = lambda x, w=None: np.bincount(d, weights=x[keep] if w is None else (x * w)[keep], minlength=D) / np.maximum(docs if w is None else np.bincount(d, weights=w[keep], minlength=D), 1e-9)
    per_word = scaled / np.maximum(words, 1)
    for values in (scaled, per_word, clause):
        order = np.lexsort((values[keep], d))
        ranked, start = values[keep][order], np.searchsorted(d, np.arange(D))
        for q in QUANTILES:
            place = np.minimum(start + np.floor(q * np.maximum(docs - 1, 0)).astype(np.int64), max(len(ranked) - 1, 0))
            rows.append(np.where(docs > 0, ranked[place] if len(ranked) else 0.0, 0.0))
    rows += [mean(scaled), mean(per_word), mean(clause), mean(number), mean(punct)]
    for k in range(len(LEVELS)):
        rows += [mean(share[:, k]), mean(share[:, k], size), mean(margin[:, k], total)]
    # Cohesion: how alike neighbouring sentences are in length and in level evidence.
    near = np.zeros(n)
    if len(keep) > 1:
        same = d[1:] == d[:-1]
        near[keep[1:]] = np.where(same, np.abs(share[keep[1:]] - share[keep[:-1]]).sum(1), 0)
    rows.append(mean(near))
    # Cohesion: the share of a sentence's n-grams that the sentence before has too.
    follows = np.zeros(n, bool)
    if len(keep) > 1:
        follows[keep[1:]] = d[1:] == d[:-1]
    linked = np.where(follows, _shared(*longest, n), 0)
    rows += [mean(linked), np.sqrt(np.maximum(mean(linked**2) - mean(linked) ** 2, 0))]
    return np.stack(rows, 1)


def _shared(sentence: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """For each sentence the share of its distinct n-gram buckets that stand in the sentence before."""
    keys = distinct(sentence.astype(np.int64) << BITS | ids)
    # A key stands twice if the sentence before has its bucket too.
    both = np.sort(np.concatenate((keys, keys + (1 << BITS))))
    again = both[1:][both[1:] == both[:-1]] >> BITS
    return np.bincount(again, minlength=n)[:n] / np.maximum(np.bincount(keys >> BITS, minlength=n), 1)


@dataclass
class Boosted:
    """Least-squares gradient boosting of small regression trees stored as flat arrays."""

    base: float = 0.0
    rate: float = 0.08
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 200, depth: int = 3, least: int = 5, columns_seed: int = 7) -> Boosted:
        self.base = float(y.mean())
        now = np.full(len(y), self.base)
        order = np.argsort(x, axis=0, kind="stable")
        draw = np.random.default_rng(columns_seed)
        for _ in range(rounds):
            # A third of the features per tree, so that no single one of several alike decides alone.
            tree = _tree(x, y - now, order, depth, least, draw.random(x.shape[1]) < 1 / 3)
            self.trees.append(tree)
            now += self.rate * _walk(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((_walk(t, x) for t in self.trees), np.zeros(len(x)))


def _tree(x: np.ndarray, y: np.ndarray, order: np.ndarray, depth: int, least: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as (feature, threshold, value) of a complete binary layout; feature -1 marks a leaf."""
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    member = {0: np.ones(len(y), bool)}
    for node in range(size):
        inside = member.pop(node, None)
        if inside is None:
            continue
        value[node] = y[inside].mean()
        n = int(inside.sum())
        if node >= 2**depth - 1 or n < 2 * least:
            continue
        sorted_in = np.stack([c[inside[c]] for c in order.T], 1)
        ys = y[sorted_in]
        xs = np.take_along_axis(x, sorted_in, 0)
        left = np.cumsum(ys, 0)[:-1]
        k = np.arange(1, n)[:, None]
        gain = left**2 / k + (left[-1] + ys[-1] - left) ** 2 / (n - k)
        gain[:, ~columns] = -np.inf
        gain[(xs[1:] <= xs[:-1]) | (k < least) | (n - k < least)] = -np.inf
        at, f = np.unravel_index(gain.argmax(), gain.shape)
        if not np.isfinite(gain[at, f]):
            continue
        middle = (xs[at, f] + xs[at + 1, f]) / 2
        feature[node], threshold[node] = f, middle if middle < xs[at + 1, f] else xs[at, f]
        goes = x[:, f] <= threshold[node]
        member[2 * node + 1], member[2 * node + 2] = inside & goes, inside & ~goes
    return feature, threshold, value


def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    feature, threshold, value = tree
    at = np.zeros(len(x), np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return value[at]
        go = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
        at = np.where(inner, 2 * at + 1 + go, at)


@dataclass
class Grader:
    vocabulary: Vocabulary
    trees: Boosted
    cuts: tuple[float, float]
    accuracy: float

    def grade(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        score = self.trees.predict(features(texts, self.vocabulary)) if texts else np.zeros(0)
        return np.searchsorted(self.cuts, score, side="right") + 1, score


def train(items: DataFrame) -> Grader:
    """Fit on ``items`` (lang, reading_level, text), a small labelled table held by the driver.

    Folds take every fifth item of each language and level, so each language stands in every
    fold. Vocabulary evidence of an item always comes from other folds, and for the predictions
    that calibrate the thresholds also without the fold held out, whose labels thus play no part.
    """
    rows = items.select("item_id", "lang", "reading_level", "text").where("text is not null and reading_level in (1, 2, 3)").orderBy("lang", "reading_level", "item_id").collect()
    texts, y = [r.text for r in rows], np.array([r.reading_level for r in rows], float)
    fold = np.arange(len(rows)) % FOLDS
    of_fold = [[t for t, k in zip(texts, fold) if k == f] for f in range(FOLDS)]
    counts = [_bucket_counts(of_fold[f], y[fold == f].astype(int)) for f in range(FOLDS)]
    without = lambda *folds: Vocabulary.of(sum(c for f, c in enumerate(counts) if f not in folds))

    def evidence(held: int | None) -> np.ndarray:
        """Features of all items, each fold's from the vocabulary of the others, never that of ``held``."""
        parts = [features(of_fold[f], without(f, held)) for f in range(FOLDS)]
        x = np.zeros((len(rows), max(p.shape[1] for p in parts)))
        for f, part in enumerate(parts):
            x[fold == f] = part if len(part) else 0
        return x

    held = np.zeros(len(rows))
    for f in range(FOLDS):
        nested = evidence(f)
        held[fold == f] = Boosted().fit(nested[fold != f], y[fold != f]).predict(nested[fold == f])
    x = evidence(None)
    grid = np.linspace(1, 3, 201)
    low = grid[np.array([((held >= c) == (y >= 2)).mean() for c in grid]).round(9) == max(((held >= c) == (y >= 2)).mean() for c in grid).round(9)]
    high = grid[np.array([((held >= c) == (y >= 3)).mean() for c in grid]).round(9) == max(((held >= c) == (y >= 3)).mean() for c in grid).round(9)]
    cuts = (float(np.median(low)), float(np.median(high)))
    accuracy = float((np.searchsorted(cuts, held, side="right") + 1 == y).mean())
    return Grader(without(), Boosted().fit(x, y), cuts, accuracy)


def reading_levels(docs: DataFrame, grader: Grader, min_chars: int = 300) -> DataFrame:
    """(doc_id, reading_level, score) of every document with at least ``min_chars`` characters by its n_chars.

    A null n_chars is taken from the text; null texts give no row, a text without letters
    the level of an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            level, score = shared.value.grade(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "reading_level": level, "score": score})

    long = docs.where(F.coalesce("n_chars", F.length("text")) >= min_chars).select("doc_id", "text").where("doc_id is not null and text is not null")
    kind = dict(long.dtypes)["doc_id"]
    return long.mapInPandas(run, f"doc_id {kind}, reading_level int, score double")
