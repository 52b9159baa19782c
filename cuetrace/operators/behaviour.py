"""Response error and time at the cue, their two-stage means and paired differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuetrace.operators.averaging import long_form
from cuetrace.schema import EXPERIMENT, ITEM_LEFT, ITEM_RIGHT, MEASURES, PHASE


def cue_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("cueFrame") == 0)


def behaviour_blocks(rows: DataFrame) -> DataFrame:
    """Means per (subject, block, item) of the rows at the cue that have both measures."""
    keys = [EXPERIMENT, "SubNr", "block", "item", PHASE]
    return (cue_rows(rows).dropna(subset=[*MEASURES, *keys]).groupBy(*keys)
            .agg(*[F.avg(m).alias(m) for m in MEASURES]))


def behaviour_subjects(blocks: DataFrame) -> DataFrame:
    """Unweighted mean of block means per (subject, item)."""
    keys = [EXPERIMENT, "SubNr", "item", PHASE]
    return blocks.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in MEASURES])


def by_measure(subjects: DataFrame) -> DataFrame:
    """Long form: one row per (experiment, subject, item, measure), so that all experiments
    and both measures go through one job."""
    return long_form(subjects, [EXPERIMENT, "SubNr", "item", PHASE], {m: m for m in MEASURES},
                     "measure", "value")


def paired_differences(long: DataFrame) -> DataFrame:
    """Right - left per (experiment, measure, subject), paired by subject id."""
    def side(item: str):
        return F.max(F.when(F.col("item") == item, F.col("value")))

    return (long.groupBy(EXPERIMENT, "measure", "SubNr")
            .agg((side(ITEM_RIGHT) - side(ITEM_LEFT)).alias("diff"))
            .filter(F.col("diff").isNotNull()))
