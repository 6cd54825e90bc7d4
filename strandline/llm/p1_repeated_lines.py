"""Lines that one source prints in document after document.

Pass 1 keeps, per partition and source, a Misra-Gries summary whose capacity makes the
total undercount of any line smaller than the count it must reach; summaries merge by
plain addition, so a worker that holds many sends them and goes on with empty ones. Pass 2 counts the surviving candidates exactly. The confirmed lines,
bounded by (lines per document) / share for every source, are broadcast after a check of
their number, or joined by shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import source_key
from strandline.operators.joins import sized
from strandline.session import settled

BROADCAST_ROWS = 200_000
#: Counters a worker holds at once, over all sources of its partition.
HELD = 2_000_000
SALTS = 32


def line_hashes(text: Column) -> Column:
    """One 64-bit key per line of ``text``: equal for lines that differ only in case,
    spacing, digits, punctuation or symbols; 0 for lines without letters."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{M}]+", ""))
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"\p{L}"), F.xxhash64(bare(x))).otherwise(F.lit(0).cast("bigint")))


def document_lines(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, doc_id, lines): one row per document and source, the text reduced to line keys."""
    lines = docs.select("doc_id", line_hashes(F.col("text")).alias("lines")).where("doc_id is not null and lines is not null").dropDuplicates(["doc_id"])
    named = sources.select("doc_id", source_key(F.col("source_name")).alias("source")).where("doc_id is not null and source is not null").distinct()
    return lines.join(named, "doc_id").select("source", "doc_id", "lines")


def _summaries(held: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, pd.Series] = {}
        short: dict[str, int] = {}
        room: dict[str, int] = {}

        def cut(source: str) -> None:
            counts, capacity = kept[source], room[source]
            while len(counts) > capacity:
                # Lowering all counters by the (capacity+1)-th largest is that many classic decrements at once.
                level = int(np.partition(counts.to_numpy(), len(counts) - capacity - 1)[len(counts) - capacity - 1])
                counts = counts[counts > level] - level
                short[source] = short.get(source, 0) + level
            kept[source] = counts

        def sent() -> Iterator[pd.DataFrame]:
            for source in list(kept):
                cut(source)
                counts = kept.pop(source)
                yield pd.DataFrame({"source": source, "line": [*counts.index, 0], "n": [*counts.to_numpy(), short.pop(source, 0)]})

        for batch in batches:
            room.update(zip(batch["source"], batch["capacity"].astype(int)))
            sizes = batch["lines"].map(len).to_numpy()
            flat = pd.DataFrame({"source": np.repeat(batch["source"].to_numpy(), sizes), "doc": np.repeat(np.arange(len(batch)), sizes), "line": np.concatenate([*batch["lines"], np.zeros(0, np.int64)]).astype(np.int64)})
            flat = flat[flat["line"] != 0].drop_duplicates()
            for source, part in flat.groupby("source", sort=False)["line"]:
                new = part.value_counts()
                kept[source] = new if source not in kept else kept[source].add(new, fill_value=0).astype(np.int64)
                if len(kept[source]) > 2 * room[source]:
                    cut(source)
            if sum(map(len, kept.values())) > held:
                yield from sent()
        yield from sent()

    return run


def _standing(every: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``every`` (source, doc_id, line, ...) whose line is ``listed`` (source, line): by broadcast after a
    check of its size, else by a join on salted keys, as one line may stand in most documents."""
    key = ["source", "line"]
    if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return every.join(F.broadcast(listed.select(*key)), key, "left_semi")
    salted = listed.select(*key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left_semi").drop("salt")


def repeated_lines(docs: DataFrame, sources: DataFrame, min_docs: int = 4, min_percent: int = 5) -> DataFrame:
    """(doc_id, line_no): every line standing in at least ``min_docs`` documents and
    ``min_percent`` per cent of the documents of its source.

    Null texts, null ids and documents without a source give no rows; empty texts and
    lines without letters are never cases; repeated rows of a document count once; other
    columns are ignored; empty tables give an empty result.
    """
    found, _ = _confirmed(docs, sources, min_docs, min_percent)
    return found


def _confirmed(docs: DataFrame, sources: DataFrame, min_docs: int, min_percent: int) -> tuple[DataFrame, DataFrame]:
    lines = settled(document_lines(docs, sources))
    own = F.size(F.array_except(F.array_distinct("lines"), F.array(F.lit(0).cast("bigint"))))
    total = lines.groupBy("source").agg(F.count("*").alias("docs"), F.sum(own).alias("stream")).withColumn("least", F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * min_percent / 100)).cast("bigint"))
    total = settled(total)
    # N/(capacity+1) < least: no line that reaches its count can be lost.
    room = total.select("source", (F.floor(F.col("stream") / F.col("least")) + 1).alias("capacity"))
    heavy = lines.join(sized(room), "source").mapInPandas(_summaries(HELD), "source string, line bigint, n bigint").groupBy("source", "line").agg(F.sum("n").alias("n"))
    error = heavy.where("line = 0").select("source", F.col("n").alias("short"))
    candidates = heavy.where("line <> 0").join(total, "source").join(error, "source", "left").where("n + coalesce(short, 0) >= least").select("source", "line")
    exact = (
        _standing(lines.select("source", "doc_id", F.explode(F.array_distinct("lines")).alias("line")), settled(candidates))
        .groupBy("source", "line")
        .agg(F.count("*").alias("n"))
        .join(total, "source")
        .where("n >= least")
        .select("source", "line", "n", "docs")
    )
    exact = settled(exact)
    every = lines.select("source", "doc_id", F.posexplode("lines").alias("pos", "line")).where("line <> 0")
    found = _standing(every, exact).select("doc_id", (F.col("pos") + 1).alias("line_no")).distinct()
    return found, exact


def without_repeated_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): each document once, without the lines in ``found``."""
    drop = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    once = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("drop"), i + 1))
    return once.join(drop, "doc_id", "left").select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
