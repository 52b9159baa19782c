"""One trial, subject or file may hold a third of all rows: plans and results must bear it."""

import pytest
from pyspark.sql import functions as F

from cuetrace import Params, Study
from cuetrace.operators import averaging, baseline, exclusion, smoothing
from cuetrace.schema import PHASE, SAME_PHASE
from cuetrace.sources.recordings import store_recordings
from cuetrace.workspace import materialize

P = Params(baseline=10, baseline_excl=10, posttrigger=30)
LOW = {"spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
       "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}


@pytest.fixture
def low_thresholds(spark):
    for key, value in LOW.items():
        spark.conf.set(key, value)
    yield
    for key in LOW:
        spark.conf.unset(key)


def hot_rows(spark, n=60_000):
    """A third of all rows belongs to subject 1, block 1, trial 1."""
    hot = F.col("id") % 3 == 0
    key = F.col("id") % 997
    return spark.range(0, n, 1, 8).select(
        F.when(hot, 1).otherwise(key % 7 + 2).cast("int").alias("SubNr"),
        F.when(hot, 1).otherwise(key % 5).cast("int").alias("block"),
        F.when(hot, 1).otherwise(key % 11).cast("int").alias("trial"),
        F.concat(F.lit("item "), F.when(F.col("id") % 2 == 0, "L").otherwise("R")).alias("item"),
        (F.col("id") % 40 - 10).cast("int").alias("cueFrame"),
        F.lit(1.0).alias("Time"), *[(F.hash("id", F.lit(c)) % 100 / 250.0).alias(c) for c in ("eyeX", "headBiasX")],
        F.lit(0.0).alias("headRoll"), F.lit(0.0).alias("headYaw"), F.lit(0.0).alias("headX"),
        F.lit(1).alias("ExpNr"), (F.col("id") + 1).alias("seq"), F.lit(SAME_PHASE).alias(PHASE))


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_trial_is_split_in_the_row_level_joins(spark, low_thresholds):
    rows = materialize(hot_rows(spark), "hot")
    assert "skew=true" in executed(baseline.baseline_correct(rows, ["eyeX"], P))
    bad = materialize(exclusion.bad_trials(rows.withColumn("eyeX", F.col("eyeX") * 2), P), "bad")
    cleaned = exclusion.clean_rows(rows, bad)
    assert "skew=true" in executed(cleaned)


def test_hot_trial_is_combined_before_the_shuffle(spark):
    cells = averaging.trial_cells(hot_rows(spark), ["eyeX"], P)
    hot = cells.filter("SubNr = 1").agg(F.sum("n"), F.count(F.lit(1))).first()
    assert hot[0] == 60_000 // 3 * 39 // 40 and hot[1] <= 39 * 2


def test_chunks_are_even_whatever_the_keys(spark):
    rows = hot_rows(spark)
    per_chunk = rows.groupBy(F.floor(F.col("seq") / 1000)).count().agg(F.max("count")).first()[0]
    assert per_chunk == 1000
    smoothed = smoothing.moving_average(rows, ["eyeX"], 4, scope="trial", chunk=1000)
    assert smoothed.count() == rows.count()


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    study = Study(store_recordings(hot_rows(spark)), P, strict=False)
    results = []
    for partitions in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = study.position_summary("gaze").collect()
        results.append({(r["item"], r.cue_frame): r["mean"] for r in found})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == pytest.approx(results[1], abs=1e-9) and len(results[0]) == 39
