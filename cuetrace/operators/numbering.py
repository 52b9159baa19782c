"""Row numbers in a global order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cuetrace.workspace import materialize

ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to sort `rows` rows in: their number grows with the rows, so that a task's share fits its memory.

    Up to `spark.shuffle.sort.bypassMergeThreshold` tasks the sending side writes straight to files; beyond, it holds its
    rows in memory and spills them. So tasks first grow to four times `ROWS_A_TASK` before there are more of them.
    """
    straight = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    tasks = max(min(-(-rows // ROWS_A_TASK), straight), -(-rows // (4 * ROWS_A_TASK)))
    return max(spark.sparkContext.defaultParallelism, tasks)


def number_blocks(rows: DataFrame, block: list[str], position: str, name: str = "seq") -> DataFrame:
    """Add `name` = 1, 2, ... in the order of (`block`, `position`).

    `rows` must be a stored table in which `position` grows by one from row to row inside a
    block. Only one row per block (an input split or sort partition) is numbered in sequence; their
    starts are stored, so the planner knows their size and broadcasts them only below its threshold.
    """
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.min(position).alias("_first"))
    upto = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(
        *block, "_first", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_start")), "blocks")
    return (rows.join(starts, block)
            .withColumn(name, F.col("_start") + F.col(position) - F.col("_first") + 1)
            .drop("_start", "_first"))


def number_sorted(df: DataFrame, order: list[str | Column], name: str = "seq") -> DataFrame:
    """Add `name` = 1, 2, ... in the order of `order`: a range-partitioned sort, stored, whose
    partitions are then numbered one after the other.

    Rows equal in `order` keep their input order, which also lets the range partitioning
    split a large group of them. `order` may hold expressions: only the columns of `df` are moved and stored.
    """
    by = [*order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    in_order = tied.repartitionByRange(tasks_for(df.sparkSession, df.count()), *by).sortWithinPartitions(*by)
    stored = materialize(in_order.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "sorted")
    numbered = number_blocks(
        stored.withColumn("_part", F.shiftright("_id", 33)), ["_part"], "_id", name)
    return numbered.drop("_part", "_id")
