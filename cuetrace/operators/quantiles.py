"""Exact quantiles of few groups with many rows, in two scans: a rank sketch, then counting near the ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from cuetrace.workspace import delete_stored, materialize

ACCURACY = 10_000    # a sketched value's rank is off by at most a share of 1 / ACCURACY
MAX_GROUPS = 10_000  # their bounds are kept on the driver


def collect_groups(groups: DataFrame) -> list[Row]:
    """Rows of `groups`; more than `MAX_GROUPS` are refused."""
    rows = groups.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"quantiles of more than {MAX_GROUPS} groups")
    return rows


def sketch(value: str, probs: list[float], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates `n`, `lo`, `hi` and `sketch`: for each of `probs` a value surely below its rank and one surely above.

    The sketch is mergeable and of bounded size; the shares asked for lie three errors off the wanted ones.
    """
    shares = [share for p in probs for share in (max(p - 3 / accuracy, 0.0), min(p + 3 / accuracy, 1.0))]
    x = F.col(value).cast("double")
    return [F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
            F.percentile_approx(x, shares, accuracy).alias("sketch")]


def group_quantiles(df: DataFrame, value: str, by: str, probs: list[float], *, accuracy: int = ACCURACY,
                    sketched: list[Row] | None = None) -> DataFrame:
    """Columns `by`, prob, quantile: linear interpolation between order statistics (type 7). NULLs do not count.

    Spark's exact `percentile` holds all distinct values of a group in one buffer. Here a first scan brackets the
    ranks by a sketch; a second counts the rows below each bracket and, value by value, those inside, some
    6 / `accuracy` of all rows, combined before the shuffle. The counted values are sorted over the cluster and the ranks
    looked up in their running sums. Heavy ties make brackets of one value, heavy tails change nothing. Groups
    are conditions, so the driver sees a few numbers for each. `sketched` may give what the first scan
    finds: rows with `by` and the columns of `sketch(value, probs)`.
    """
    spark, kind = df.sparkSession, df.schema[by].dataType.simpleString()
    rows = df.select(by, F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    if sketched is None:
        sketched = collect_groups(rows.groupBy(by).agg(*sketch("x", probs, accuracy)))
    wanted = [(r[by], prob, (r.n - 1) * prob) for r in sketched if r.n for prob in probs]
    brackets = {}
    for r in sketched:
        for k, prob in enumerate(probs if r.n else []):
            # Up to this many rows a share of 1 / accuracy is less than one row: no need for a bracket.
            near = (r.lo, r.hi) if r.n <= accuracy else (r.sketch[2 * k], r.sketch[2 * k + 1])
            brackets[r[by], prob] = near
    whole = {r[by]: (r.lo, r.hi) for r in sketched}
    found = {key: (lo, lo) for key, (lo, hi) in brackets.items() if whole[key[0]] == (lo, hi) and lo == hi}
    while missing := [w for w in wanted if w[:2] not in found]:
        found |= _ranked(rows, by, kind, [(g, prob, at, *brackets[g, prob]) for g, prob, at in missing])
        # Never seen: a bracket without its rank would be widened to all of the group's values and counted again.
        brackets |= {(g, prob): whole[g] for g, prob, _ in missing if (g, prob) not in found}
    result = [(g, prob, found[g, prob][0] + (found[g, prob][1] - found[g, prob][0]) * (at - math.floor(at)))
              for g, prob, at in wanted]
    return spark.createDataFrame(result, f"{by} {kind}, prob double, quantile double")


def _ranked(rows: DataFrame, by: str, kind: str, brackets: list[tuple]) -> dict[tuple, tuple[float, float]]:
    """Per (group, prob) of `brackets` (group, prob, place, low, high) the values of the ranks below and above `place`."""
    spark = rows.sparkSession
    bounds = F.broadcast(spark.createDataFrame(brackets, f"{by} {kind}, prob double, at double, low double, high double"))
    inside = F.when(F.col("x") >= F.col("low"), F.col("x"))  # NULL: below the bracket
    counts = materialize(rows.join(bounds, by).filter(F.col("x") <= F.col("high"))
                         .groupBy(by, "prob", "at", inside.alias("x")).agg(F.count(F.lit(1)).alias("n")), "rank-counts")
    order = [by, "prob", F.col("x").asc_nulls_first()]
    ordered = materialize(counts.orderBy(*order).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)),
                          "rank-order")
    # A row per partition and bracket is summed up in sequence; inside a partition the values are.
    before = Window.partitionBy(by, "prob").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy(by, "prob", "part").agg(F.sum("n").alias("n")).select(
        by, "prob", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy(by, "prob", "part").orderBy(F.col("x").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    placed = (ordered.withColumn("upto", F.sum("n").over(upto)).join(starts, [by, "prob", "part"])
              .withColumn("upto", F.col("upto") + F.col("start")).filter(F.col("x").isNotNull()))
    first = F.col("upto") - F.col("n")

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank < F.col("upto"))

    below, above = F.floor("at"), F.ceil("at")
    hits = (placed.filter(holds(below) | holds(above)).groupBy(by, "prob").agg(
        F.max(F.when(holds(below), F.col("x"))).alias("below"), F.max(F.when(holds(above), F.col("x"))).alias("above")))
    found = {(r[by], r.prob): (r.below, r.above) for r in hits.collect()  # at most a row per bracket
             if r.below is not None and r.above is not None}
    delete_stored(counts)
    delete_stored(ordered)
    return found
