"""Packing texts into containers of fixed token capacity.

The global histogram of lengths, never larger than the capacity, goes to the driver. Dynamic
programming over it chooses the bucket boundaries with the least padding; every item then
counts as its bucket's upper boundary. A container is opened by as many items of the largest
waiting bucket as its budget holds, and what budget is left is topped up from smaller
buckets: batches inside one bucket alone would leave up to half of a container empty for
lengths over half the capacity. Like containers form one pattern with a count, so the plan's
size depends on the capacity, not on the corpus; items find their container by their rank in
their bucket.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.p5_contributor_cap import globally_ranked
from strandline.session import settled

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern of pre-tokens that goes with byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer at ``path``, loaded once per worker; its vocabulary is read, never copied."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens): one piece per text, more only where it exceeds the capacity."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            n = np.array([len(encode.encode_ordinary(t)) for t in batch["text"]], np.int64)
            count = -(-n // capacity)
            at = np.repeat(np.arange(len(batch)), count)
            no = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "piece_no": no + 1, "start_token": no * capacity, "n_tokens": np.minimum(capacity, n[at] - no * capacity)})

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''").dropDuplicates(["doc_id"]).mapInPandas(run, f"doc_id {kind}, piece_no int, start_token bigint, n_tokens int")


def boundaries(histogram: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bucket boundaries with the least total padding; ``histogram[n]`` counts items of n tokens.

    The padding of a bucket is concave in its ends, so the least padding is convex in the number of
    buckets: a price per bucket is sought at which the cheapest ways use ``buckets`` of them, each
    price taking one pass over the sizes; of two cheapest ways with fewer and with more buckets the
    one with exactly as many is put together.
    """
    sizes = np.flatnonzero(histogram)
    if len(sizes) <= buckets:
        return sizes
    count = [0, *np.cumsum(histogram[sizes]).tolist()]
    total = [0, *np.cumsum(histogram[sizes] * sizes).tolist()]
    low, high = 0, int(sizes[-1]) * count[-1] + 1
    while low < high:
        price = (low + high) // 2
        if len(_cheapest(sizes.tolist(), count, total, price, 1)) - 1 <= buckets:
            high = price
        else:
            low = price + 1
    few, many = (_cheapest(sizes.tolist(), count, total, low, sign) for sign in (1, -1))
    more = buckets - (len(few) - 1)
    cuts = few if not more else next(many[: i + more + 1] + few[i + 1 :] for i in range(len(few) - 1) if few[i] <= many[i + more] and many[i + more + 1] <= few[i + 1])
    return sizes[np.array(cuts[1:]) - 1]


def _cheapest(sizes: list[int], count: list[int], total: list[int], price: int, sign: int) -> list[int]:
    """Cuts 0 = c0 < c1 < ... = n of the cheapest way to bucket the sizes at a price per bucket; of equally
    cheap ways the one with fewest buckets for sign 1, with most for -1."""
    n = len(sizes)
    unit = 2 * n  # costs in steps of this, so that the number of buckets decides between equals
    best, back = [0] * (n + 1), [0] * (n + 1)
    lines: list[tuple[int, int, int]] = [(0, 0, 0)]  # (slope, value at 0, cut): the lower hull, slopes falling
    first = 0
    for j in range(1, n + 1):
        x = sizes[j - 1]
        while first + 1 < len(lines) and lines[first + 1][1] + lines[first + 1][0] * x <= lines[first][1] + lines[first][0] * x:
            first += 1
        slope, at_zero, i = lines[first]
        best[j] = at_zero + slope * x + unit * (x * count[j] - total[j] + price) + sign
        back[j] = i
        new = (-unit * count[j], best[j] + unit * total[j], j)
        while len(lines) - first >= 2 and (new[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - new[0]):
            lines.pop()
        lines.append(new)
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(bucket, items of it in each)]): like containers together, larger buckets first."""
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        room, used = capacity, []
        j = top
        while j >= 0:
            take = int(min(left[j], room // sizes[j]))
            if take:
                used.append((j, take))
                room -= take * int(sizes[j])
            fits = np.flatnonzero((left[:j] > 0) & (sizes[:j] <= room))
            j = int(fits[-1]) if len(fits) else -1
        times = min(int(left[k]) // m for k, m in used)
        for k, m in used:
            left[k] -= times * m
        out.append((times, used))
    return out


def containers(docs: DataFrame, capacity: int = 2048, buckets: int = 256, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens): every text's pieces and their containers.

    Only a text over ``capacity`` tokens is split, into full pieces and a rest. Null and empty
    texts hold no tokens and get no row; a repeated id counts once; other columns are ignored.
    """
    items = settled(pieces(docs, capacity, tokenizer))
    counted = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in counted.items():
        histogram[size] = n
    spark = docs.sparkSession
    edges = boundaries(histogram, buckets)
    below = np.concatenate(([0], edges[:-1])) if len(edges) else edges
    counts = np.array([histogram[a + 1 : b + 1].sum() for a, b in zip(below, edges)], np.int64)
    patterns = plan(edges, counts, capacity)
    # For each bucket: the first rank, the items in each, and the first container of every pattern that uses it.
    starts: list[list[tuple[int, int, int]]] = [[] for _ in edges]
    rank, base = [0] * len(edges), 0
    for times, used in patterns:
        for k, m in used:
            starts[k].append((rank[k], m, base))
            rank[k] += times * m
        base += times
    tables = spark.sparkContext.broadcast([np.array(s, np.int64).reshape(-1, 3) for s in starts])
    bucket_of = np.searchsorted(edges, np.arange(capacity + 1))
    bucket = F.element_at(F.array(*[F.lit(int(b)) for b in bucket_of]), F.col("n_tokens") + 1)
    # Exact ranks without one task per bucket, the same on every cluster.
    ranked = globally_ranked(items.withColumn("bucket", bucket), ["bucket"], [F.desc("n_tokens"), F.asc("doc_id"), F.asc("piece_no")]).withColumn("rank", F.col("rank") - 1)
    kind = dict(docs.dtypes)["doc_id"]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container = np.zeros(len(batch), np.int64)
            rank, of = batch["rank"].to_numpy(), batch["bucket"].to_numpy()
            for k in np.unique(of):
                rows = np.flatnonzero(of == k)
                table = tables.value[k]
                p = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                container[rows] = table[p, 2] + (rank[rows] - table[p, 0]) // table[p, 1]
            yield batch.assign(container_id=container)[["container_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

    return ranked.select("doc_id", "piece_no", "start_token", "n_tokens", "bucket", "rank").mapInPandas(assign, f"container_id bigint, doc_id {kind}, piece_no int, start_token bigint, n_tokens int")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the most tokens in one, and the share of the capacity in use."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("used"))
