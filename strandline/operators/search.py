"""Searches of a stated query set against all rows, in blocks of queries: nearest vectors and best texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries held in a worker at once; a larger set is run block after block.
BLOCK = 2_000
#: Cells of the table of scores (chunks by queries) a worker fills at once, and the share of its cells from which a term is added as a matrix product.
CELLS, COMMON = 2_000_000, 0.004


def blocks(queries: DataFrame, key: str, most: int = BLOCK, of: DataFrame | None = None) -> list[DataFrame]:
    """The queries (or their rows ``of``) in blocks of about ``most``, by hash, so that a block is the same on any cluster."""
    n = 1 + (queries.count() - 1) // most if most else 1
    return [(of or queries).where(F.pmod(F.xxhash64(key), F.lit(max(n, 1))) == i) for i in range(max(n, 1))]


def best_of(df: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; limits apply before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, id, sim, rank): for each query the ``k`` other rows of greatest clipped cosine, rounded to six
    digits, ties by the smaller id.

    ``vectors`` and ``queries`` hold (id, vec). Exact: every query meets every row, as one product of
    matrices a batch; a task sends ``k`` rows a query. Null vectors and vectors of zeros match nothing.
    """
    kind = dict(vectors.dtypes)["id"]
    found = [_nearest_block(vectors, q, k, kind) for q in blocks(queries, "id", block)]
    return best_of(reduce(DataFrame.unionByName, found), "query_id", k, [F.desc("sim"), F.asc("id")])


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest_block(vectors: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    some = lambda df: df.select("id", "vec").where("id is not null and vec is not null and exists(vec, x -> x <> 0)")
    asked = some(queries).toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), _unit(asked["vec"]) if len(asked) else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, units = shared.value
        held: pd.DataFrame | None = None
        for batch in batches if len(ids) else ():
            sims = np.round(np.clip(units @ _unit(batch["vec"]).T, 0, 1), 6)
            own = batch["id"].to_numpy()
            sims[ids[:, None] == own[None, :]] = -1
            least = np.partition(sims, -min(k, len(own)), axis=1)[:, -min(k, len(own))]
            q, v = np.nonzero((sims >= least[:, None]) & (sims >= 0))
            new = pd.DataFrame({"query_id": ids[q], "id": own[v], "sim": sims[q, v]})
            both = new if held is None else pd.concat([held, new])
            held = both.sort_values(["query_id", "sim", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        if held is not None:
            yield held

    return some(vectors).mapInPandas(run, f"query_id {kind}, id {kind}, sim double")


def best_texts(chunks: DataFrame, asked: pd.DataFrame, total: int, weight: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(query_id, doc_id, score): for each query the ``k`` other documents of the best chunk, task by task.

    ``chunks`` hold (doc_id, length, terms), ``asked`` (query_id, term, df), each pair once. A chunk scores the sum of
    ``weight`` (n, length, df) over the terms asked for, rounded to six digits; ties go to the smaller id. Exact: every
    chunk meets every query, but what leaves a task is ``k`` rows a query at most, however many documents share a term.
    """
    kind = dict(chunks.dtypes)["doc_id"]
    query, ids = pd.factorize(asked["query_id"])
    term, words = pd.factorize(asked["term"])
    df, asks = np.zeros(len(words)), np.bincount(term, minlength=len(words))
    df[term] = asked["df"]
    common = np.flatnonzero(df * asks > COMMON * total * len(ids))
    shared = chunks.sparkSession.sparkContext.broadcast((np.asarray(ids), list(words), df, asks, query[np.argsort(term, kind="stable")], common, CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, weight, k)
        for batch in batches:
            best.add(batch)
        if found := best.rows():
            yield pa.RecordBatch.from_arrays(found, ["query_id", "doc_id", "score"])

    return chunks.select("doc_id", "length", "terms").where("doc_id is not null").mapInArrow(run, f"query_id {kind}, doc_id {kind}, score double")


class _Best:
    """The best documents of each query so far."""

    def __init__(self, ids: np.ndarray, words: list[str], df: np.ndarray, asks: np.ndarray, queries: np.ndarray, common: np.ndarray, cells: int, weight: Callable, k: int):
        self.ids, self.words, self.df, self.asks, self.queries, self.weight, self.k = pd.Index(ids), words, df, asks, queries, weight, k
        self.step = max(1, cells // max(len(ids), 1))
        self.first = np.cumsum(asks) - asks
        self.column = np.full(len(words), -1)
        self.column[common] = np.arange(len(common))
        self.product = np.zeros((len(common), len(ids)))
        for c, t in enumerate(common):
            self.product[c, queries[self.first[t] : self.first[t] + asks[t]]] = 1
        self.least = np.zeros(len(ids))
        self.held: list[pd.DataFrame] = []

    def add(self, batch: pa.RecordBatch) -> None:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        at = pc.index_in(values, value_set=pa.array(self.words, values.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))[at >= 0]
        keys, n = np.unique(row * len(self.words) + at[at >= 0], return_counts=True)
        row, term = np.divmod(keys, max(len(self.words), 1))
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        weights = self.weight(n, batch.column(1).to_numpy()[row], self.df[term])
        for start in range(0, len(lists), self.step):
            a, b = np.searchsorted(row, (start, start + self.step))
            if a < b:
                self._score(docs[start : start + self.step], row[a:b] - start, term[a:b], weights[a:b])

    def _score(self, docs: np.ndarray, row: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        code, docs = pd.factorize(docs)
        order = np.argsort(code, kind="stable")  # the chunks of a document side by side
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        row, width = place[row], len(self.ids)
        rare = self.column[term] < 0
        asks = self.asks[term[rare]]
        asking = self.queries[np.arange(asks.sum()) + np.repeat(self.first[term[rare]] - (np.cumsum(asks) - asks), asks)]
        held = np.zeros((len(order), len(self.product)))
        held[row[~rare], self.column[term[~rare]]] = weights[~rare]
        scores = held @ self.product
        scores += np.bincount(np.repeat(row[rare] * width, asks) + asking, np.repeat(weights[rare], asks), scores.size).reshape(scores.shape)
        scores = np.maximum.reduceat(scores, np.searchsorted(code[order], np.arange(len(docs))))
        own = self.ids.get_indexer(docs)
        scores[np.flatnonzero(own >= 0), own[own >= 0]] = 0
        bar = np.partition(scores, -self.k, axis=0)[-self.k] if not self.held and len(docs) >= self.k else self.least
        doc, query = np.nonzero((scores > 0) & (scores >= bar - 2e-6))  # what rounds to the same score is kept
        self.held.append(pd.DataFrame({"query": query, "doc": docs[doc], "score": np.floor(scores[doc, query] * 1e6 + 0.5) / 1e6}))
        if len(self.held) == 1 or sum(len(x) for x in self.held[1:]) > 2 * self.k * width:
            self._merge()

    def _merge(self) -> None:
        both = pd.concat(self.held).sort_values(["query", "score", "doc"], ascending=[True, False, True]).drop_duplicates(["query", "doc"])
        self.held = [both.groupby("query", sort=False).head(self.k)]
        full = self.held[0].groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index] = full["min"]

    def rows(self) -> list[pa.Array]:
        if not self.held:
            return []
        self._merge()
        found = self.held[0]
        return [pa.array(self.ids[found["query"]].to_numpy()), pa.array(found["doc"].to_numpy()), pa.array(found["score"].to_numpy())]
