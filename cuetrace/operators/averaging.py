"""Two-stage means (trials within blocks, blocks within subjects) and the condition contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cuetrace.functions.means import ratio, strict_mean
from cuetrace.operators.baseline import in_analysis
from cuetrace.operators.smoothing import CHUNK_ID
from cuetrace.params import Params
from cuetrace.schema import EXPERIMENT, ITEM_LEFT, ITEM_RIGHT, PHASE, TRIAL

# A subject belongs to one experiment; the column only stays with the means.
BLOCK_CELL = [EXPERIMENT, "SubNr", "block", "item", "cueFrame", PHASE]
SUBJECT_CELL = [EXPERIMENT, "SubNr", "item", "cueFrame", PHASE]


def trial_cells(df: DataFrame, signals: list[str], p: Params) -> DataFrame:
    """Sums and counts per (trial, item, frame) of the analysis window.

    Combined before the shuffle; afterwards a trial has at most frames x items rows, however
    many rows it had, so no later step meets a hot trial, block or subject. Rows that moving_average has left
    partitioned by chunk are combined where they lie, and go by subject and block in one exchange, which then
    serves the cells, the baseline and the block means.
    """
    cell = [*BLOCK_CELL, "trial"]
    rows = df.filter(in_analysis(p))
    names = ["n", *[f"{s}_{kind}" for s in signals for kind in ("sum", "n")]]
    counted = [F.count(F.lit(1)).alias("n")]
    for s in signals:
        counted += [F.sum(s).alias(f"{s}_sum"), F.count(s).alias(f"{s}_n")]
    if CHUNK_ID not in df.columns:
        return rows.groupBy(*cell).agg(*counted)
    parts = rows.groupBy(CHUNK_ID, *cell).agg(*counted)
    return parts.repartition("SubNr", "block").groupBy(*cell).agg(*[F.sum(c).alias(c) for c in names])


def block_means(cells: DataFrame, signals: list[str], p: Params) -> DataFrame:
    """Baseline-corrected mean per (subject, block, item, frame) from `trial_cells`.

    The baseline is a window over the few cells of a trial. The mean of x - base over the
    rows of a cell is (sum - n base) / n. One NULL among the rows, or a trial without
    baseline, makes the block's mean NULL.
    """
    trial = Window.partitionBy(*TRIAL)
    before = (F.col("cueFrame") <= 0) & F.col("block").isNotNull() & F.col("trial").isNotNull() \
        & F.col("SubNr").isNotNull()

    def base(s: str):
        return ratio(F.sum(F.when(before, F.col(f"{s}_sum"))).over(trial),
                     F.sum(F.when(before, F.col(f"{s}_n"))).over(trial))

    corrected = cells.select(*BLOCK_CELL, "n", *[
        F.when(F.col(f"{s}_n") == F.col("n"), F.col(f"{s}_sum") - F.col("n") * base(s)).alias(s)
        for s in signals])
    return corrected.groupBy(*BLOCK_CELL).agg(*[
        F.when(F.count(s) == F.count(F.lit(1)), F.sum(s) / F.sum("n")).alias(s) for s in signals])


def subject_means(blocks: DataFrame, signals: list[str]) -> DataFrame:
    """Unweighted mean of block means per (subject, item, frame); a NULL block gives NULL."""
    return blocks.groupBy(*SUBJECT_CELL).agg(*[strict_mean(F.col(s)).alias(s) for s in signals])


def toward(subjects: DataFrame, signals: list[str]) -> DataFrame:
    """Half the difference right - left per (subject, frame): movement toward the cued item.

    A cell with one item only stays, with NULL values, and has the right item's phase. Both
    items meet in one aggregation; `subjects` has at most one row per item, else the job fails.
    """
    def side(item: str, c: str):
        here = F.col("item") == item
        kind = subjects.schema[c].dataType
        return F.when(F.count(F.when(here, F.lit(1))) > 1, F.raise_error(F.lit(
            f"several rows of {item} in a cell of subject and frame")).cast(kind)).otherwise(
            F.max(F.when(here, F.col(c))))

    return (subjects.filter(F.col("item").isin(ITEM_LEFT, ITEM_RIGHT))
            .groupBy("SubNr", "cueFrame")
            .agg(side(ITEM_RIGHT, PHASE).alias(PHASE),
                 *[((side(ITEM_RIGHT, s) - side(ITEM_LEFT, s)) / 2).alias(s) for s in signals]))


def long_form(df: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per key and column: `columns` maps the name to give to the column to take."""
    pairs = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value))
                      for label, c in columns.items()])
    return df.select(*keys, F.inline(pairs))
