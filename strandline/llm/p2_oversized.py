"""Cutting oversized items at their strongest inner boundaries, with a fixed overlap.

The boundary strength of every position of an item goes into a sparse table of range
maxima; each piece ends at the strongest cut of its permissible window, the rightmost of
equals, and the next piece starts ``overlap`` characters before that cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.chars import PUNCT, SPACE, classes, points

#: Marks that end a sentence, marks that end a clause, marks that close a quotation or bracket.
SENTENCE_END = ".!?。！？۔؟।॥…｡．"
CLAUSE_END = ",;:，、；：،؛—–"
CLOSERS = "\"'”’」』）)]】》〉»"


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text): 0 where no boundary is.

    5 after a line break, 4 after a sentence mark with its closers, 3 after a clause mark,
    2 after white space, 1 after any other punctuation.
    """
    at = points(text)
    kind = classes()[at]
    member = lambda marks: np.isin(at, points(marks))
    out = np.zeros(len(at) + 1, np.uint8)
    after = out[1:]
    after[kind == PUNCT] = 1
    space = kind == SPACE
    after[space] = 2
    clause, end = member(CLAUSE_END), member(SENTENCE_END)
    ascii_mark = np.isin(at, points(".,:;!?"))
    free = np.append(space[1:], True) | ~ascii_mark  # an ASCII mark inside a number or an address is no boundary of rank
    after[clause & free] = 3
    closing = member(CLOSERS)
    run = end & free | end & np.append(closing[1:], False)
    after[run] = 4
    for _ in range(3):  # closers, then the blank after the mark, belong to what they close
        run = np.append(False, run[:-1]) & (closing | space)
        after[run] = 4
    after[at == 10] = 5
    return out


def longest_unbroken(strength: np.ndarray, at_most: int) -> bool:
    """Whether a stretch of more than ``at_most`` characters holds neither white space nor punctuation."""
    breaks = np.flatnonzero(strength[1:] > 0)
    edges = np.concatenate(([-1], breaks, [len(strength) - 1]))
    return bool((np.diff(edges) - 1).max(initial=0) > at_most)


def sparse_table(values: np.ndarray, widest: int | None = None) -> list[np.ndarray]:
    """Level k holds the position of the maximum of each window of 2**k, the rightmost of equals; no
    more levels than windows of ``widest`` values need."""
    table, span = [np.arange(len(values), dtype=np.int32)], 1
    while 2 * span <= min(len(values), widest or len(values)):
        left, right = table[-1][:-span], table[-1][span:]
        table.append(np.where(values[right] >= values[left], right, left))
        span *= 2
    return table


def strongest(table: list[np.ndarray], values: np.ndarray, low: int, high: int) -> int:
    """Position of the maximum of values[low..high], the rightmost of equals."""
    k = (high - low + 1).bit_length() - 1
    left, right = table[k][low], table[k][high - (1 << k) + 1]
    return int(right if values[right] >= values[left] else left)


def pieces(text: str, limit: int = 900, overlap: int = 120) -> tuple[str, list[tuple[int, int, int]]]:
    """The item's class and its pieces (start, end, strength of the cut that ends it)."""
    strength = strengths(text)
    cut = "forced" if longest_unbroken(strength, limit) else "natural"
    table, out, start = sparse_table(strength, limit + 1), [], 0
    while len(text) - start > limit:
        end = strongest(table, strength, start + max(limit // 2, overlap + 1), start + limit)
        if not strength[end]:
            end = strongest(table, strength, start + overlap + 1, start + limit)
        out.append((start, end, int(strength[end])))
        start = end - overlap
    out.append((start, len(text), 6))
    return cut, out


def oversized_items(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, field, item_no, item): lines and paragraphs over the limit, found before any Python runs."""
    big = lambda: F.length("item") > limit
    text = docs.where(F.length("text") > limit).select("doc_id", F.lit("text").alias("field"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "item")).where(big())
    para = docs.select("doc_id", F.lit("paragraphs").alias("field"), F.posexplode("paragraphs").alias("pos", "p")).select("doc_id", "field", "pos", F.col("p.text").alias("item")).where(big())
    return text.unionByName(para).where("doc_id is not null").withColumn("item_no", F.col("pos") + 1).dropDuplicates(["doc_id", "field", "item_no"])


def split_oversized(docs: DataFrame, limit: int = 900, overlap: int = 120) -> DataFrame:
    """(doc_id, field, item_no, cut, piece_no, start, end, strength, piece) of every item over ``limit``.

    Items up to the limit, nulls and empty arrays give no rows; repeated rows of a document
    count once; offsets are code points from 0; other columns are ignored.
    """
    if not 0 <= overlap < limit - 1:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, field, item_no, item in batch.itertuples(index=False):
                cut, parts = pieces(item, limit, overlap)
                out += [(doc_id, field, item_no, cut, k, a, b, s, item[a:b]) for k, (a, b, s) in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "field", "item_no", "cut", "piece_no", "start", "end", "strength", "piece"])

    items = oversized_items(docs, limit).select("doc_id", "field", "item_no", "item")
    return items.mapInPandas(run, "doc_id string, field string, item_no int, cut string, piece_no int, start int, end int, strength int, piece string")
