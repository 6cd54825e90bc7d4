"""Duplicate removal and set operations with explicit order.

Order is always a column, so first-wins rules give the same rows on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import settled


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; a null key is a key of its own.

    An aggregate, not a window: rows combine before the shuffle, so a hot key is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_at", F.struct(*order))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_at").alias("_row")) if rest else df.select(*keys).distinct()
    return best.select(*keys, "_row.*").select(*df.columns) if rest else best


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; ties by the remaining columns' text."""
    rest = [c for c in df.columns if c not in keys]
    tie = F.struct(F.col(order), F.xxhash64(*rest))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), tie).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, component) of an edge table (a, b) by least-id propagation with path halving.

    Each round is one aggregate and one join on the node; rounds grow with the logarithm of
    the longest chain. Lineage is cut in shared storage, so a lost executor costs one round.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = step.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        new = settled(step.join(jump, step["c"] == jump["n2"], "left").select("node", F.least("c", F.coalesce("c2", "c")).alias("c")))
        if new.agg(F.sum(F.hash("node", "c").cast("bigint"))).first() == label.agg(F.sum(F.hash("node", "c").cast("bigint"))).first():
            return new.select("node", F.col("c").alias("component"))
        label = new
    raise RuntimeError("components did not settle")


def greedy_dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows accepted in ``order`` (unique) whose non-empty ``keys`` no accepted row had before.

    A rejected row blocks nothing. Rows alone on all their keys are accepted without further
    ado; the others fold in order inside connected components of shared keys. A component
    linked by a single key needs no fold: its first row wins by an aggregate.
    """
    keyed = df.select(order, *keys)
    long = keyed.select(F.col(order).alias("o"), F.explode(F.array(*[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat_ws("\x01", F.lit(str(i)), F.col(k).cast("string"))) for i, k in enumerate(keys)])).alias("k")).where("k is not null")
    groups = long.groupBy("k").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = settled(long.join(groups, "k").select("o", "k", "first"))
    if len(keys) == 1:
        lost = shared.where("o <> first").select(F.col("o").alias(order)).distinct()
        return df.join(lost, order, "left_anti")
    comp = components(shared.where("o <> first").select(F.col("o").alias("a"), F.col("first").alias("b")))
    linked = shared.groupBy("o").agg(F.collect_set("k").alias("ks")).join(comp, F.col("o") == F.col("node")).select("component", "o", "ks")

    def fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        now = None
        for batch in rows:
            lost = []
            for component, o, ks in batch.itertuples(index=False):
                if component != now:
                    now, seen = component, set()
                if seen.intersection(ks):
                    lost.append(o)
                else:
                    seen.update(ks)
            yield pd.DataFrame({"o": lost})

    kind = dict(df.dtypes)[order]
    # Sorted partitions stream through the fold, so a large component is never held in memory.
    lost = linked.repartition("component").sortWithinPartitions("component", "o").mapInPandas(fold, f"o {kind}")
    return df.join(lost.select(F.col("o").alias(order)), order, "left_anti")


def added_by_key(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` and the rows of ``more`` whose key it lacks, each new key once."""
    return base.unionByName(more.join(base.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
