"""Pairwise similarity inside a group, by tiles of vectors.

A tile pair is one matrix product in one task; what leaves a tile are sums per document and
partner country, so the number of rows follows the documents, not the pairs. The pairs of a
group remain quadratic work, as the operator demands; its memory and output do not grow so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1024


def tiles(docs: DataFrame, group: str, tile: int = TILE) -> DataFrame:
    """``docs`` (id, group, ..., vec) with each block of a group sent to every tile pair it takes part in."""
    counts = docs.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / tile)).cast("int").alias("blocks"))
    placed = docs.join(counts, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    return placed.withColumn("pair", pairs).select("*", F.col("pair.i").alias("tile_i"), F.col("pair.j").alias("tile_j")).drop("pair", "blocks")


def cosine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Clipped cosines of unit vectors, six places as the scalar form has them."""
    return np.floor(np.clip(a @ b.T, 0.0, 1.0) * 1e6 + 0.5) / 1e6


def _parts(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = rows["tile_i"].iloc[0], rows["tile_j"].iloc[0]
    rows = rows.sort_values("id", kind="stable")
    return rows[rows["block"] == i], rows[rows["block"] == j], i == j


def pair_sums(docs: DataFrame, group: str, bands: tuple[tuple[float, float], ...], tile: int = TILE) -> DataFrame:
    """(group, id, country, partner_country, n, sims, weight, weighted): per document and partner
    country the pairs, the sum of similarities, of partner weights and of weight times band value."""
    bounds = np.array([b for b, _ in bands])
    values = np.array([p for _, p in bands] + [bands[-1][1]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _parts(rows)
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["g", "id", "country", "partner_country", "n", "sims", "weight", "weighted"])
        sim = cosine_block(np.stack(a["vec"]), np.stack(b["vec"]))
        p = values[np.searchsorted(bounds, sim, side="right")]
        out = []
        sides = [(a, b, sim, p)] if same else [(a, b, sim, p), (b, a, sim.T, p.T)]
        for own, other, s, q in sides:
            codes, names = pd.factorize(other["country"])
            w = other["weight"].to_numpy(float)
            apart = ~np.eye(len(own), dtype=bool) if same else np.ones(s.shape, bool)
            for c, name in enumerate(names):
                cols = np.flatnonzero(codes == c)
                on = apart[:, cols]
                out.append(pd.DataFrame({"g": own[group].to_numpy(), "id": own["id"].to_numpy(), "country": own["country"].to_numpy(), "partner_country": name, "n": on.sum(1), "sims": (s[:, cols] * on).sum(1), "weight": on @ w[cols], "weighted": (q[:, cols] * on) @ w[cols]}))
        return pd.concat(out)

    kinds = dict(docs.dtypes)
    schema = f"g {kinds[group]}, id {kinds['id']}, country string, partner_country string, n bigint, sims double, weight double, weighted double"
    parts = tiles(docs, group, tile).groupBy(group, "tile_i", "tile_j").applyInPandas(run, schema)
    return parts.groupBy(F.col("g").alias(group), "id", "country", "partner_country").agg(*[F.sum(c).alias(c) for c in ("n", "sims", "weight", "weighted")])


def similar_pairs(docs: DataFrame, group: str, least: float, tile: int = TILE) -> DataFrame:
    """(group, a, b, sim) with a < b and a similarity of at least ``least``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _parts(rows)
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["g", "a", "b", "sim"])
        sim = cosine_block(np.stack(a["vec"]), np.stack(b["vec"]))
        hit = sim >= least
        if same:
            hit &= np.triu(np.ones(sim.shape, bool), 1)
        x, y = np.nonzero(hit)
        ia, ib = a["id"].to_numpy()[x], b["id"].to_numpy()[y]
        return pd.DataFrame({"g": a[group].iloc[0], "a": np.minimum(ia, ib), "b": np.maximum(ia, ib), "sim": sim[x, y]})

    kinds = dict(docs.dtypes)
    return tiles(docs, group, tile).groupBy(group, "tile_i", "tile_j").applyInPandas(run, f"g {kinds[group]}, a {kinds['id']}, b {kinds['id']}, sim double").withColumnRenamed("g", group)
