"""Plot-ready tables: what each figure draws, without drawing it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuetrace.schema import EXPERIMENT

# Axis limits that censor the towardness figures (pooled; per experiment).
TIME_LIMITS = (-200.0, 2000.0)
TOWARD_LIMITS = {
    "head_direction": (-0.2, 0.75),
    "translation": (-0.1, 0.5),
    "roll": (-0.1, 0.2),
    "yaw": (-0.1, 0.2),
}
TOWARD_LIMITS_BY_EXPERIMENT = {
    "head_direction": (-0.5, 1.2),
    "gaze": (-1.0, 2.5),
}
# Height at which significant times are marked.
MARK_HEIGHT = {
    "head_direction": -0.1,
    "translation": -0.05,
    "roll": -0.09,
    "yaw": -0.08,
}
OVERLAY_MARK_HEIGHT = {"eye": -0.4, "head": -0.2}
# Arm of the cross at the centre of the density figure, and the error of a guess.
CROSS_ARM = 6.0
CHANCE = {"error": 45.0}


def ribbon(summary: DataFrame) -> DataFrame:
    """Line with mean +- se."""
    return summary.withColumns({"ymin": F.col("mean") - F.col("se"), "ymax": F.col("mean") + F.col("se")})


def within_limits(x: Column, limits: tuple[float, float]) -> Column:
    return F.when(x.between(*limits), x)


def censored_ribbon(summary: DataFrame, limits: tuple[float, float],
                    time_limits: tuple[float, float] = TIME_LIMITS) -> DataFrame:
    """Line with ribbon in which values outside the axis limits are NULL."""
    drawn = ribbon(summary)
    return drawn.withColumns({
        "time_ms": within_limits(F.col("time_ms"), time_limits),
        **{c: within_limits(F.col(c), limits) for c in ("mean", "ymin", "ymax")}})


def overlay(summaries: dict[str, DataFrame]) -> DataFrame:
    """Summaries with common columns under each other, tagged by `type`, renamed by position.
    `type_level` is the rank of the tag in alphabetical order."""
    names = ["cue_frame", "n", "bias", "sd", "se", "ci", "time_ms"]
    levels = {tag: i for i, tag in enumerate(sorted(summaries), start=1)}
    tagged = [df.toDF(*names).withColumns({"type": F.lit(tag), "type_level": F.lit(levels[tag])})
              for tag, df in summaries.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def behaviour_bars(summary: DataFrame, subjects: DataFrame) -> DataFrame:
    """Bars with mean +- ci (`layer` = bar), one point per subject (`layer` = point), and the level of guessing of
    the measures that have one (`layer` = chance)."""
    keys = [EXPERIMENT, "measure", "item"]
    none = F.lit(None).cast("double")
    bars = summary.select(
        *keys, F.lit("bar").alias("layer"), F.lit("all").alias("subject"),
        F.col("mean").alias("y"), (F.col("mean") - F.col("ci")).alias("ymin"),
        (F.col("mean") + F.col("ci")).alias("ymax"))
    points = subjects.select(
        *keys, F.lit("point").alias("layer"), F.col("SubNr").cast("string").alias("subject"), F.col("value").alias("y"),
        none.alias("ymin"), none.alias("ymax"))
    levels = F.create_map(*[F.lit(v) for pair in CHANCE.items() for v in pair])
    chance = summary.select(EXPERIMENT, "measure").distinct().select(
        EXPERIMENT, "measure", F.lit(None).cast("string").alias("item"), F.lit("chance").alias("layer"),
        F.lit("all").alias("subject"), levels[F.col("measure")].alias("y"), none.alias("ymin"), none.alias("ymax"))
    return bars.unionByName(points).unionByName(chance.filter(F.col("y").isNotNull()))


def marks(significant: DataFrame, height: Column) -> DataFrame:
    """Points at a fixed height at the significant times."""
    return significant.select("signal", "time_ms", height.alias("y"))


def circles(spark: SparkSession, centres: tuple[float, ...] = (-100.0, 100.0), radius: float = 25.0,
            points: int = 100) -> DataFrame:
    """Outlines of the item positions: `points` points each, the last one closing the path."""
    angle = F.col("id") * F.lit(2 * math.pi / (points - 1))
    centre = F.explode(F.array(*[F.lit(c) for c in centres]))
    return (spark.range(points).select("id", centre.alias("centre"))
            .select("centre", F.col("id").cast("int").alias("i"),
                    (F.col("centre") + F.lit(radius) * F.cos(angle)).alias("x"),
                    (F.lit(radius) * F.sin(angle)).alias("y")))


def density_figure(raster: DataFrame) -> DataFrame:
    """The density raster and, as further layers, the two item outlines, their centres, and the ends of the two
    lines that cross in the middle."""
    none = F.lit(None).cast("double")
    rings = circles(raster.sparkSession)
    tiles = raster.select(F.lit("raster").alias("layer"), F.col("x").cast("double").alias("x"),
                          F.col("y").cast("double").alias("y"), "density")
    path = rings.select(F.lit("path").alias("layer"), "x", "y", none.alias("density"))
    centre = rings.filter(F.col("i") == 0).select(
        F.lit("point").alias("layer"), F.col("centre").alias("x"), F.lit(0.0).alias("y"),
        none.alias("density"))
    arms = {"horizontal": [(-CROSS_ARM, 0.0), (CROSS_ARM, 0.0)], "vertical": [(0.0, -CROSS_ARM), (0.0, CROSS_ARM)]}
    ends = F.inline(F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(x).alias("x"), F.lit(y).alias("y"))
                              for layer, points in arms.items() for x, y in points]))
    cross = raster.sparkSession.range(1).select(ends).withColumn("density", none)
    return tiles.unionByName(path).unionByName(centre).unionByName(cross)
