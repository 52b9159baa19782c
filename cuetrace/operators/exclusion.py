"""Trials with artefacts: find them, drop them, report how much was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.functions.means import ratio
from cuetrace.params import Params
from cuetrace.schema import TRIAL_ITEM


def is_artefact(p: Params) -> Column:
    """Gaze or head out of range in the artefact window. Limits are in recorded units."""
    beyond = ((F.abs("eyeX") > p.position_limit) | (F.abs("headBiasX") > p.position_limit)
              | (F.abs("headRoll") > p.angle_limit) | (F.abs("headYaw") > p.angle_limit))
    return beyond & (F.col("cueFrame") > -p.baseline_excl) & (F.col("cueFrame") < p.posttrigger)


def artefact_rows(rows: DataFrame, p: Params) -> DataFrame:
    return rows.filter(is_artefact(p))


def bad_trials(rows: DataFrame, p: Params) -> DataFrame:
    """Distinct trial keys with at least one artefact row that has a time stamp."""
    return artefact_rows(rows, p).dropna(subset=["Time", *TRIAL_ITEM]).select(*TRIAL_ITEM).distinct()


def clean_rows(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of all other trials.

    Pass a stored `bad` table (`Study.bad`): from its size the planner chooses between
    broadcasting it and a sort-merge anti join, in which skewed trials are split.
    """
    return rows.join(bad, TRIAL_ITEM, "left_anti")


def bad_trials_by_item(bad: DataFrame) -> DataFrame:
    return bad.groupBy("SubNr", "item", "phase").agg(F.count(F.lit(1)).alias("excl"))


def excluded_per_subject(bad: DataFrame, p: Params) -> DataFrame:
    """Bad trials of each subject that has any, as a number and as a share of its trials."""
    return (bad_trials_by_item(bad).groupBy("SubNr").agg(F.sum("excl").alias("excl"))
            .withColumn("prop", ratio(F.col("excl").cast("double"), F.lit(float(p.trials_per_subject)))))


def exclusion_report(rows: DataFrame, p: Params, *, include_clean_subjects: bool = False) -> DataFrame:
    """One row: rows read and kept, and both exclusion rates in per cent.

    `row_excl_pct` counts rows, not trials. `subj_excl_pct` averages over the subjects with
    a bad trial only, unless `include_clean_subjects` is set. Rows are first reduced to one
    per trial, before the shuffle; no join is needed.
    """
    has_keys = F.lit(True)
    for key in TRIAL_ITEM:
        has_keys = has_keys & F.col(key).isNotNull()
    trials = (rows.groupBy(*TRIAL_ITEM)
              .agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.max(is_artefact(p) & F.col("Time").isNotNull()), F.lit(False)).alias("hit"))
              .withColumn("bad", F.col("hit") & has_keys))
    subjects = trials.groupBy("SubNr").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("kept"),
        F.count_if("bad").alias("excl"))
    share = F.col("excl") / F.lit(float(p.trials_per_subject))
    counted = share if include_clean_subjects else F.when(F.col("excl") > 0, share)
    return subjects.agg(
        F.sum("n").alias("n_rows"),
        F.sum("kept").alias("n_kept"),
        (100 - ratio(F.sum("kept").cast("double"), F.sum("n").cast("double")) * 100).alias("row_excl_pct"),
        (F.avg(counted) * 100).alias("subj_excl_pct"),
        F.count_if(F.col("excl") > 0).alias("n_subjects_with_bad"))
