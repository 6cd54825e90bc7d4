"""Character windows, neighbour context and greedy packing over ordered items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def char_windows(length: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) offsets from 0: windows of ``size`` that share ``overlap``, the last ending the text."""
    step = size - overlap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start_char"), F.least(i * step + size, length).cast("int").alias("end_char"))))


@F.pandas_udf(ArrayType(IntegerType()))
def running_sum(sizes: pd.Series) -> pd.Series:
    """For each array of sizes where its items start: the sums of the sizes before."""
    return sizes.map(lambda s: None if s is None else np.cumsum(s) - np.asarray(s))


def line_chunks(docs: DataFrame, id_col: str = "doc_id", size: int = 900, overlap: int = 120) -> DataFrame:
    """(id, chunk_no, start_char, end_char, chunk): windows inside each non-blank line, offsets in the whole text."""
    split = docs.select(id_col, F.split("text", r"[\r\n]", -1).alias("lines"))
    # The start of a line is the length of the lines before it and their breaks, summed up in one pass over a document's lines.
    starts = split.select(id_col, "lines", running_sum(F.transform("lines", lambda x: F.length(x) + 1)).alias("starts"))
    parts = starts.select(id_col, F.posexplode(F.arrays_zip("lines", "starts")).alias("line_no", "l")).select(id_col, "line_no", F.col("l.lines").alias("line"), F.col("l.starts").alias("base")).where("trim(line) <> ''")
    cut = parts.select(id_col, "line_no", "line", "base", F.posexplode(char_windows(F.length("line"), size, overlap)).alias("no", "w"))
    return cut.select(id_col, "line_no", F.col("no").alias("chunk_no"), (F.col("base") + F.col("w.start_char")).alias("start_char"), (F.col("base") + F.col("w.end_char")).alias("end_char"), F.substring("line", F.col("w.start_char") + 1, F.col("w.end_char") - F.col("w.start_char")).alias("chunk"))


def with_neighbours(df: DataFrame, group: list[str], order: str, start: str, end: str) -> DataFrame:
    """``context_start`` and ``context_end``: from the item before to the item after, itself at the edges."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("context_start", F.coalesce(F.lag(start).over(w), F.col(start))).withColumn("context_end", F.coalesce(F.lead(end).over(w), F.col(end)))


def greedy_pack(df: DataFrame, group: str, order: str, size: str, capacity: int, most: int | None = None) -> DataFrame:
    """``pack``: items of each group in order, a new pack where the running size would pass ``capacity``
    or the pack holds ``most`` items. An item over the capacity is a pack alone."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", pack int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pack, used, held = object(), 0, 0, 0
        for batch in batches:
            packs = []
            for g, s in zip(batch[group], batch[size]):
                if g != now:
                    now, pack, used, held = g, 1, 0, 0
                if held and (used + s > capacity or most and held >= most):
                    pack, used, held = pack + 1, 0, 0
                used, held = used + s, held + 1
                packs.append(pack)
            yield batch.assign(pack=packs)

    # Sorted partitions stream through: a group of any size needs the memory of one batch.
    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)
