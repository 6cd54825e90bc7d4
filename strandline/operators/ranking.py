"""Ranking, quotas and fills. Closed forms over window ranks replace ordered loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY, FLOOR = 0.7, 0.35


def adaptive_top_k(df: DataFrame, group: list[str], k: int, order: str, primary: float = PRIMARY, floor: float = FLOOR, strict: bool = False) -> DataFrame:
    """Up to ``k`` rows a group: scores from ``primary`` on, best first, then, unless ``strict``,
    scores from ``floor`` on with ``backfilled`` set. Ties by ``order``; null scores count as 0."""
    score = F.coalesce("score", F.lit(0.0))
    least = primary if strict else floor
    ranked = df.where(score >= least).withColumn("backfilled", score < primary)
    w = Window.partitionBy(*group).orderBy("backfilled", F.desc(score), order)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def split_quota(total: int, members: list[str]) -> dict[str, int]:
    """``total`` shared evenly, the first members taking what is left over."""
    each, over = divmod(max(total, 0), len(members))
    return {m: each + (i < over) for i, m in enumerate(members)}


def country_quotas(request: int, countries: list[str], shared: list[str], shared_cap: int = 20) -> dict[str, int]:
    """A quota for every country; those in ``shared`` divide one allowance."""
    return {c: max(request, 0) for c in countries} | split_quota(min(max(request, 0), shared_cap), shared)


def round_robin_fill(df: DataFrame, outer: str, inner: str, limit: Column, most: int, order: str, reserve: Column | None = None) -> DataFrame:
    """Rows of each ``outer`` group taken in turns from its ``inner`` groups, these ordered by
    their best score; with ``reserve`` (a condition) the best such row comes first. ``limit``
    rows, nowhere more than ``most``, stay a group; ``turn`` is the final place.

    Only the first ``most`` + 1 rows of an inner group and the reserved row can have a turn;
    they are found with limits applied before the shuffle, so a hot group is no hot task.
    """
    df = df.withColumn("_s", F.coalesce("score", F.lit(0.0)))
    first = lambda rows, keys, n: rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_s"), order))).where(F.col("_k") <= n).drop("_k")
    top = first(df, [outer, inner], most + 1)
    df = top if reserve is None else top.unionByName(first(df.where(reserve), [outer], 1)).dropDuplicates([outer, order])
    best = Window.partitionBy(outer, inner)
    df = df.withColumn("_best", F.max("_s").over(best))
    df = df.withColumn("_first", F.min(F.when(F.col("_s") == F.col("_best"), F.col(order))).over(best))
    if reserve is None:
        df = df.withColumn("_kept", F.lit(False))
    else:
        w = Window.partitionBy(outer).orderBy(F.desc(reserve.cast("int")), F.desc("_s"), order)
        df = df.withColumn("_kept", reserve & (F.row_number().over(w) == 1))
    rounds = Window.partitionBy(outer, inner).orderBy(F.col("_kept"), F.desc("_s"), order)
    df = df.withColumn("_round", F.when(F.col("_kept"), F.lit(0)).otherwise(F.row_number().over(rounds)))
    turn = Window.partitionBy(outer).orderBy(F.col("_round"), F.desc("_best"), "_first", order)
    df = df.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)
    return df.drop("_s", "_best", "_first", "_kept", "_round")


def balanced(df: DataFrame, bucket: str, per_bucket: int, budget: int, key: str, order: str) -> DataFrame:
    """Buckets taken in turns, at most ``per_bucket`` rows each, every ``key`` once, ``budget`` in all."""
    w = Window.partitionBy(bucket).orderBy(order)
    df = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_bucket)
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct("place", bucket, order)).alias("r")).select(key, "r.*")
    return first.orderBy("place", bucket, order).limit(budget)


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The upper median of the positive values of each group, from counts per value."""
    counts = df.where(F.col(value) > 0).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(value)
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*group).agg(F.min(value).alias("median"))
