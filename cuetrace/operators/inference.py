"""Repeated-measures ANOVA and Bayes factor, for any number of groups in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuetrace.functions.means import ratio
from cuetrace.functions.student import f_tail
from cuetrace.params import Params


def rm_anova(df: DataFrame, value: str, within: str, levels: list[str], by: list[str], p: Params) -> DataFrame:
    """One within-subject factor per group of `by`: effect, dfn, dfd, f, p, significant, ges.

    `df` has one row per subject and level; subjects lacking one of `levels` are left out.
    `ges` is generalised eta squared. The only window is over the levels of one subject;
    then each level is reduced to the spread of its subjects (of their means, and of the
    deviations from them), and the levels to the sums of squares.
    """
    subject = Window.partitionBy(*by, "SubNr")
    y, own, k = F.col(value), F.col("_own"), float(len(levels))
    full = (df.filter(F.col(within).isin(levels) & y.isNotNull())
            .withColumns({"_own": F.avg(y).over(subject), "_levels": F.count(y).over(subject)})
            .filter(F.col("_levels") == len(levels)))
    per_level = full.groupBy(*by, within).agg(
        F.count(y).cast("double").alias("n"),
        F.avg(y).alias("m"),
        F.var_pop(own).alias("v_subj"),
        F.var_pop(y - own).alias("v_err"))
    n = F.first("n")
    sums = per_level.groupBy(*by).agg(
        F.lit(k - 1).alias("dfn"),
        ((n - 1) * (k - 1)).alias("dfd"),
        (n * k * F.var_pop("m")).alias("ss_item"),
        (n * k * F.first("v_subj")).alias("ss_subj"),
        (n * F.sum("v_err")).alias("ss_err"))
    ss_item, ss_subj, ss_err = F.col("ss_item"), F.col("ss_subj"), F.col("ss_err")
    return (sums
            .withColumn("f", ratio(ratio(ss_item, F.col("dfn")), ratio(ss_err, F.col("dfd"))))
            .withColumn("p", f_tail("f", "dfn", "dfd"))
            .select(*by, F.lit(within).alias("effect"), "dfn", "dfd", "f", "p",
                    (F.col("p") < p.alpha).alias("significant"),
                    ratio(ss_item, ss_item + ss_subj + ss_err).alias("ges")))


def jzs_bayes_factor(t: Column, n: Column, scale: float) -> Column:
    """Bayes factor of a one-sample t statistic under a Cauchy prior of width `scale`.

    The integral over the prior variance g runs over u = ln g in [-20, 20] in steps of 0.05
    (trapezoid rule), as an expression inside the JVM. The likelihood under the null is taken off inside the
    exponent, as both underflow for strong effects; a factor beyond the doubles is infinite.
    """
    nu = n - 1
    shape = -(nu + 1) / 2
    steps = F.sequence(F.lit(-400), F.lit(400))

    def weight(step: Column) -> Column:
        u = step * F.lit(0.05)
        spread = F.lit(1.0) + n * F.lit(scale * scale) * F.exp(u)
        log_value = (F.lit(-0.5) * F.log(spread)
                     + shape * F.log(F.lit(1.0) + t * t / (spread * nu))
                     - F.lit(0.5) * u - F.lit(0.5) * F.exp(-u) - F.lit(0.5 * math.log(2 * math.pi))
                     - shape * F.log1p(t * t / nu))
        return F.exp(log_value) * F.when(F.abs(step) == 400, F.lit(0.5)).otherwise(F.lit(1.0))

    return F.aggregate(steps, F.lit(0.0), lambda acc, step: acc + weight(step)) * F.lit(0.05)


def bayes_ttest(df: DataFrame, value: str, by: list[str], p: Params) -> DataFrame:
    """Per group of `by`: n, t and the Bayes factor `bf10` of mean != 0; NULL if n < 2 or sd = 0."""
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        ratio(F.avg(value), F.stddev_samp(value)).alias("_d"))
    n = F.col("n").cast("double")
    return (stats.withColumn("t", F.col("_d") * F.sqrt(n))
            .withColumn("bf10", F.when(F.col("n") > 1, jzs_bayes_factor(F.col("t"), n, p.prior_scale)))
            .select(*by, "n", "t", "bf10"))
