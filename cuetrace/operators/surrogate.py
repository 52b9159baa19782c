"""A random cohort to test towardness against."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuetrace.functions.draws import normal
from cuetrace.functions.means import check_all
from cuetrace.functions.student import t_quantile
from cuetrace.params import Params
from cuetrace.schema import RANDOM_PHASE


def cohort_scalars(summary: DataFrame, p: Params, *, strict: bool = True) -> DataFrame:
    """Per signal: number of subjects, number of frames, mean sd over frames, and the F threshold.

    `summary` has n and sd per (signal, cueFrame). With `strict`, a subject number that varies
    over frames fails the job; else the largest counts.
    """
    n = F.max("n")
    balanced = (F.min("n") == n) if strict else F.lit(True)
    return (summary.groupBy("signal")
            .agg(check_all(balanced, n, "subject number varies over frames").alias("n_subjects"),
                 F.count(F.lit(1)).alias("n_frames"),
                 F.avg("sd").alias("mean_sd"))
            .withColumn("_t", t_quantile(p.confidence)((F.col("n_subjects") - 1).cast("double")))
            .withColumn("f_threshold", F.col("_t") * F.col("_t")).drop("_t"))


def with_surrogate(long: DataFrame, scalars: DataFrame, p: Params, *, strict: bool = True) -> DataFrame:
    """Add `random`, a draw from Normal(0, mean sd), to each (signal, subject, frame) row.

    The draws hang on the keys of the observed rows, so they are made where these lie, without
    a join of the two cohorts; with `strict` the observed subjects must be 1..N. `scalars` has
    one row per signal, at most five.
    """
    draw = normal(F.lit(p.seed), F.col("signal"), F.col("SubNr"), F.col("cueFrame"))
    known = F.col("SubNr").between(1, F.col("n_subjects")) if strict else F.lit(True)
    return (long.join(F.broadcast(scalars.select("signal", "n_subjects", "mean_sd")), "signal")
            .withColumn("random", check_all(known, draw * F.col("mean_sd"), "subjects must be numbered 1..N"))
            .drop("n_subjects", "mean_sd"))


def surrogate_rows(paired: DataFrame) -> DataFrame:
    """The random cohort as rows of its own, with `phase` = random."""
    return paired.select("signal", "SubNr", "cueFrame", F.lit(RANDOM_PHASE).alias("phase"),
                         F.col("random").alias("value"))


def cohort_differences(paired: DataFrame) -> DataFrame:
    """Observed - random value `d` of each row that has an observed value."""
    return (paired.filter(F.col("value").isNotNull())
            .select("signal", "SubNr", "cueFrame", (F.col("value") - F.col("random")).alias("d")))


def preview(wide: DataFrame, rows: int = 6) -> DataFrame:
    """First rows and first five columns by subject."""
    return wide.orderBy("SubNr").limit(rows).select(wide.columns[:5])
