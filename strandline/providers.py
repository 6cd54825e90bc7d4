"""Hooks for what the engine does not compute itself: scoring functions and vectors.

An absent provider leaves its column null; it never invents rows.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]


def load_scorer(name: str) -> Scorer:
    """The function behind ``module:function`` or ``file.py:function``."""
    place, _, function = name.rpartition(":")
    if place.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(place).stem, place)
        if spec is None or spec.loader is None:
            raise ValueError(f"{place} can't be loaded")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(place)
    return getattr(module, function)


def score_with(scorer: Scorer, documents: DataFrame, key: str = "id") -> DataFrame:
    """``documents`` with the scorer's ``reliability``: one row per known key, values from 0 to 1 or null."""
    out = scorer(documents)
    kinds = dict(out.dtypes)
    if kinds.get("reliability") != "double" or key not in kinds:
        raise ValueError(f"a scorer returns {key} and reliability double")
    bad = out.where(F.isnan("reliability") | (F.col("reliability") < 0) | (F.col("reliability") > 1))
    repeated = out.groupBy(key).count().where("count > 1")
    unknown = out.join(documents.select(key), key, "left_anti")
    if not (bad.isEmpty() and repeated.isEmpty() and unknown.isEmpty()):
        raise ValueError("a scorer returned values outside 0 to 1, repeated or unknown keys")
    return documents.join(out.select(key, "reliability"), key, "left")


def embed_missing(work: DataFrame, known: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None, batch: int = 64) -> DataFrame:
    """(digest, embedding) of ``work`` (digest, text): from ``known``, else from ``embed`` in batches, else null."""
    once = work.select("digest", "text").dropDuplicates(["digest"])
    cached = once.join(known.select("digest", "embedding"), "digest", "left")
    have, lack = cached.where("embedding is not null").select("digest", "embedding"), cached.where("embedding is null").select("digest", "text")
    if embed is None:
        return have.unionByName(lack.select("digest", F.lit(None).cast("array<float>").alias("embedding")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                yield pd.DataFrame({"digest": part["digest"], "embedding": embed(list(part["text"]))})

    return have.unionByName(lack.mapInPandas(run, "digest string, embedding array<float>"))
