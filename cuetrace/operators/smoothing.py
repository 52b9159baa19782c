"""Trailing moving average over rows in file order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuetrace.operators.numbering import tasks_for
from cuetrace.schema import EXPERIMENT, SEQ, TRIAL
from cuetrace.workspace import materialize

# Columns at whose change the average starts anew. The reference runs over the whole stream.
SCOPES = {"stream": [], "experiment": [EXPERIMENT], "trial": TRIAL}

# Rows are windowed in chunks of CHUNK consecutive `seq` values. What a chunk needs of earlier ones is found
# in the edge table, itself windowed in chunks of CHUNK * FAN, and the edges of these together:
# n - 1 rows per billion `seq` values, 3,000 for 10^12 rows.
CHUNK = 32_768
FAN = 32_768
CHUNK_ID = "_chunk"


def moving_average(
    df: DataFrame, columns: list[str], n: int = 4, *, scope: str = "stream", on_null: str = "error",
    chunk: int = CHUNK, fan: int = FAN, keep_chunk: bool = False,
) -> DataFrame:
    """Replace each of `columns` by the mean of its last `n` rows by `seq`; NULL for the first n - 1.

    Leading NULLs only delay the first mean. A later NULL fails the job (`on_null="error"`)
    or gives NULL for the rows whose mean it enters (`on_null="null"`).

    One window over the stream would put all rows into one task. Instead each chunk gets the last n - 1 rows before it
    as halo rows, from a stored table, and one window per chunk is exact: one exchange and one sort of the rows,
    in tasks that grow in number with the chunks.
    With `keep_chunk` the rows keep the column `_chunk`, by which (and the scope's columns) they are partitioned.
    """
    keys = SCOPES[scope]
    own = F.floor(F.col(SEQ) / F.lit(chunk)).alias(CHUNK_ID)
    if n == 1:
        return df.select("*", own) if keep_chunk else df
    out = df.columns
    read = df.select(*dict.fromkeys([*keys, SEQ, *columns]))
    edges = materialize(_edges(read, keys, n - 1, chunk), "edges")
    tasks = tasks_for(df.sparkSession, edges.select(F.count_distinct(F.floor(F.col(SEQ) / F.lit(chunk)))).first()[0] * chunk)
    halo = _halo_rows(edges, keys, n, chunk, fan)
    none = [F.col(f.name) if f.name in halo.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in df.schema.fields]
    rows = df.select("*", own, F.lit(True).alias("_own")).unionByName(
        halo.select(*none, CHUNK_ID, F.lit(False).alias("_own")))
    order = Window.partitionBy(*keys, CHUNK_ID).orderBy(SEQ)
    # All signals travel in one struct: one lag per earlier row, however many signals.
    earlier = [f"_lag{k}" for k in range(1, n)]
    dealt = rows.withColumn("_now", F.struct(*columns)).drop(*columns).repartition(tasks, *keys, CHUNK_ID)
    marked = dealt.withColumns({lag: F.lag("_now", k).over(order) for k, lag in enumerate(earlier, start=1)})
    return marked.filter("_own").select(
        *[_mean(c, earlier, n, on_null).alias(c) if c in columns else F.col(c) for c in out],
        *([CHUNK_ID] if keep_chunk else []))


def _halo_rows(edges: DataFrame, keys: list[str], n: int, chunk: int, fan: int) -> DataFrame:
    """Stored: the last n - 1 rows before each chunk of each scope, with the chunk's number."""
    columns = edges.columns
    edges = edges.withColumns({
        CHUNK_ID: F.floor(F.col(SEQ) / F.lit(chunk)), "_wide": F.floor(F.col(SEQ) / F.lit(chunk * fan))})
    # A chunk that lies in several tasks has more edge rows than it needs; that changes nothing below.
    before_wide = _before(_last_of(edges, [*keys, "_wide"], n - 1).withColumn("_own", F.lit(True)), keys, "_wide",
                          columns, n)
    before_wide = before_wide.select(*columns, F.floor(F.col(SEQ) / F.lit(chunk)).alias(CHUNK_ID), "_wide",
                                     F.lit(False).alias("_own"))
    both = edges.withColumn("_own", F.lit(True)).unionByName(before_wide)
    return materialize(_before(both, [*keys, "_wide"], CHUNK_ID, columns, n), "halo")


def _edges(df: DataFrame, keys: list[str], keep: int, chunk: int) -> DataFrame:
    """Each task's last `keep` rows of every chunk and scope; a task holds no more than these and a batch."""
    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        seq = batch.column(SEQ).to_numpy()
        parts = [seq // chunk]
        for key in keys:
            codes = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices
            parts.append(codes.to_numpy(zero_copy_only=False))
        order = np.lexsort((seq, *parts))
        new = np.zeros(len(seq), np.int64)
        for part in parts:
            new[1:] |= np.diff(part[order]) != 0
        group = np.cumsum(new)
        place = np.searchsorted(group, group, "right") - np.arange(len(seq))  # 1 for a group's last row
        return batch.take(pa.array(np.sort(order[place <= keep])))

    def run(batches):
        held, size, kept = [], 0, 0
        for batch in batches:
            held.append(last(batch))
            size += held[-1].num_rows
            if size > 2 * kept + 100_000:
                held = [last(pa.Table.from_batches(held).combine_chunks().to_batches()[0])]
                size = kept = held[0].num_rows
        if held and size:
            yield last(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return df.mapInArrow(run, df.schema)


def _last_of(rows: DataFrame, part: list[str], keep: int) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(SEQ)))
    return rows.withColumn("_latest", latest).filter(F.col("_latest") <= keep).drop("_latest")


def _before(rows: DataFrame, part: list[str], group: str, out: list[str], n: int) -> DataFrame:
    """The n - 1 rows before each `group` inside `part`, with the group they come before."""
    order = Window.partitionBy(*part).orderBy(SEQ)
    whole = rows.withColumn("_row", F.struct(*out))
    earlier = F.array_compact(F.array(*[F.lag("_row", k).over(order) for k in range(1, n)]))
    marked = whole.select(group, "_own", F.lag(group).over(order).alias("_last"), earlier.alias("_rows"))
    return marked.filter(F.col("_own") & (F.col("_last").isNull() | (F.col("_last") != F.col(group)))).select(
        group, F.inline("_rows"))


def _mean(column: str, earlier: list[str], n: int, on_null: str) -> Column:
    """Mean of the row and the `earlier` ones, NULL if one of them is missing or NULL."""
    x = F.col(f"_now.{column}")
    mean = reduce(Column.__add__, [F.col(f"{lag}.{column}") for lag in reversed(earlier)] + [x]) / F.lit(float(n))
    if on_null == "null":
        return mean
    gap = x.isNull() & F.col(f"{earlier[0]}.{column}").isNotNull()
    return F.when(gap, F.raise_error(F.lit("moving average: NULL after a value"))).otherwise(mean)
