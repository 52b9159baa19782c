"""Signals relative to their mean before the cue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.params import Params
from cuetrace.schema import PHASE, SIGNAL_FACTOR, TRIAL


def rescale(df: DataFrame, signals: list[str]) -> DataFrame:
    """Recorded to reported units: metres to centimetres, roll with its sign flipped."""
    return df.withColumns({s: F.col(s) * F.lit(SIGNAL_FACTOR[s]) for s in signals
                           if SIGNAL_FACTOR[s] != 1.0})


def in_analysis(p: Params) -> Column:
    return (F.col("cueFrame") > -p.baseline) & (F.col("cueFrame") < p.posttrigger)


def in_baseline(p: Params) -> Column:
    return (F.col("cueFrame") > -p.baseline) & (F.col("cueFrame") <= 0)


def baseline_means(df: DataFrame, signals: list[str], p: Params, by: list[str] = TRIAL) -> DataFrame:
    """Mean of each signal before the cue, per trial (over both items), NULLs left out."""
    return (df.filter(in_baseline(p)).dropna(subset=TRIAL).groupBy(*by)
            .agg(*[F.avg(s).alias(f"{s}_base") for s in signals]))


def baseline_correct(df: DataFrame, signals: list[str], p: Params) -> DataFrame:
    """Row-level correction; a trial without baseline rows gets NULL.

    The means are aggregated before their shuffle, one row per trial. The join is left to
    adaptive execution: a broadcast if they turn out small, else a sort-merge join in which
    a trial holding very many rows is split over tasks. It splits only a join of two plain
    shuffles; therefore the means are grouped by the phase too, which is the same in all rows,
    as they would otherwise be partitioned by trial already and join without a shuffle.
    For averaged results use `averaging.block_means`, which needs no join.
    """
    means = baseline_means(df, signals, p, [*TRIAL, PHASE]).drop(PHASE)
    corrected = df.join(means, TRIAL, "left")
    return (corrected.withColumns({s: F.col(s) - F.col(f"{s}_base") for s in signals})
            .drop(*[f"{s}_base" for s in signals]))
