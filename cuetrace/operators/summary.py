"""Mean, sd, standard error and confidence interval per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cuetrace.functions.means import complete, ratio
from cuetrace.functions.student import t_quantile
from cuetrace.params import Params


def _with_interval(df: DataFrame, p: Params) -> DataFrame:
    """Add se = sd / sqrt(n) and ci = se * t quantile with n - 1 degrees of freedom."""
    return (df.withColumn("se", ratio(F.col("sd"), F.sqrt(F.col("n").cast("double"))))
            .withColumn("ci", F.col("se") * t_quantile(p.confidence)((F.col("n") - 1).cast("double"))))


def summary_se(df: DataFrame, measure: str, by: list[str], p: Params, *, na_rm: bool = False) -> DataFrame:
    """Columns `by`, n, mean, sd, se, ci. Without `na_rm` a NULL makes its group's numbers NULL;
    with it, NULLs are left out and `n` counts the rest."""
    x = F.col(measure)
    if na_rm:
        n, mean, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    else:
        n = F.count(F.lit(1))
        mean, sd = F.when(complete(x), F.avg(x)), F.when(complete(x), F.stddev_samp(x))
    stats = [n.alias("n"), mean.alias("mean"), sd.alias("sd")]
    return _with_interval(df.groupBy(*by).agg(*stats) if by else df.agg(*stats), p)


def summary_within(df: DataFrame, value: str, within: str, by: list[str], p: Params) -> DataFrame:
    """Within-subject summary per (`by`, `within`): each subject's mean is replaced by the grand
    mean, and the spread corrected by sqrt(k / (k - 1)) for the k levels of `within`.

    The grand mean does not change the spread, so it is added after the aggregation, from
    the few rows of the levels.
    """
    own = F.avg(value).over(Window.partitionBy(*by, "SubNr"))
    levels = (df.withColumn("_dev", F.col(value) - own)
              .groupBy(*by, within)
              .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_sum"),
                   F.avg("_dev").alias("_dev"), F.stddev_samp("_dev").alias("_sd")))
    group = Window.partitionBy(*by)
    k = F.count(F.lit(1)).over(group).cast("double")
    stats = levels.select(
        *by, within, "n", "mean",
        (F.col("_dev") + F.sum("_sum").over(group) / F.sum("n").over(group)).alias("mean_norm"),
        (F.col("_sd") * F.sqrt(ratio(k, k - 1))).alias("sd"))
    return _with_interval(stats, p)
