"""Sums of arrays over all tasks: a task gives one binary row per key and block, merged in rounds of bounded fan-in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

FAN_IN = 64
TASKS_PER_CORE = 4
BLOCK = 16_384  # numbers in a row: 128 KB


def few_tasks(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` in at most `TASKS_PER_CORE` tasks for each core, and that bound. Splits are read one after the other in a
    task, nothing is shuffled; so there are as many partial sums as the cluster can work at, however many splits."""
    most = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most), most


def pieces(total: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Block number, task number and bytes of the blocks of an array."""
    flat, part = np.ascontiguousarray(total, np.float64).ravel(), TaskContext.get().partitionId()
    for at in range(-(-len(flat) // BLOCK)):
        yield at, part, flat[at * BLOCK:(at + 1) * BLOCK].tobytes()


def tree_sum(parts: DataFrame, keys: list[str], tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """From (keys, at, part, total, n) of at most `tasks` parts one row per (keys, at), `total` and `n` summed up.

    Each round leaves a `fan_in`-th of the parts; a task adds up rows as they come and holds one sum.
    """
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        group = [*keys, "at", "part"]
        dealt = parts.withColumn("part", F.pmod("part", F.lit(tasks)).cast("int"))
        parts = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_merge(group), parts.schema)
    return parts.drop("part")


def _merge(group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n, schema = None, None, 0, None

        def done():
            values = [*key, total.tobytes(), n]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            names = batch.column("total")
            for i, own in enumerate(zip(*(batch.column(c).to_pylist() for c in group))):
                part = np.frombuffer(names[i].as_buffer(), np.float64)
                if own != key:
                    if key is not None:
                        yield done()
                    key, total, n = own, part.copy(), batch.column("n")[i].as_py()
                else:
                    total += part
                    n += batch.column("n")[i].as_py()
        if key is not None:
            yield done()

    return run


def spread(summed: DataFrame, keys: list[str], shape: tuple[int, ...], axes: list[str], value: str) -> DataFrame:
    """One row per number: keys, its place on each of `axes` (from 0), the number, and `n`."""
    schema = ", ".join(f"{k} {summed.schema[k].dataType.simpleString()}" for k in keys)
    schema += "".join(f", {axis} int" for axis in axes) + f", {value} double, n long"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                total = np.frombuffer(batch.column("total")[i].as_buffer(), np.float64)
                places = np.unravel_index(batch.column("at")[i].as_py() * BLOCK + np.arange(len(total)), shape)
                columns = {k: pa.array([batch.column(k)[i].as_py()] * len(total), batch.schema.field(k).type) for k in keys}
                columns |= {axis: pa.array(place.astype(np.int32)) for axis, place in zip(axes, places)}
                columns |= {value: pa.array(total), "n": pa.array(np.full(len(total), batch.column("n")[i].as_py()))}
                yield pa.RecordBatch.from_pydict(columns)

    return summed.mapInArrow(run, schema)
