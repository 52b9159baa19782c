import random

import pytest
from pyspark.sql import Window, functions as F

from cuetrace.operators import averaging, baseline, smoothing
from cuetrace import Params

P = Params(baseline=3, posttrigger=4, baseline_excl=3)


def stream(spark, values, trial=None, gaps=False):
    """Rows in `seq` order; with `gaps`, numbers are missing as after an exclusion."""
    draw, seq, rows = random.Random(1), 0, []
    for i, v in enumerate(values):
        seq += draw.choice([1, 1, 1, 30]) if gaps else 1
        rows.append((seq, 1, 1, trial[i] if trial else 1, 1, v, v))
    return spark.createDataFrame(rows, "seq long, SubNr int, block int, trial int, ExpNr int, x double, y double")


def smoothed(df, **options):
    rows = smoothing.moving_average(df, ["x"], options.pop("n", 4), **options).orderBy("seq").collect()
    return [r.x for r in rows]


def test_first_rows_are_null_and_stream_leaks_over_trials(spark):
    df = stream(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], trial=[1, 1, 1, 1, 2, 2, 2, 2])
    assert smoothed(df) == [None, None, None, 2.5, 3.5, 4.5, 5.5, 6.5]
    assert smoothed(df, scope="trial") == [None, None, None, 2.5, None, None, None, 6.5]


def test_other_columns_stay(spark):
    out = smoothing.moving_average(stream(spark, [1.0] * 6), ["x"], 4)
    assert out.columns == ["seq", "SubNr", "block", "trial", "ExpNr", "x", "y"] and out.count() == 6


@pytest.mark.parametrize("chunk, fan", [(3, 2), (7, 3), (10, 5), (100, 7), (32_768, 32_768)])
def test_chunks_equal_one_global_window(spark, chunk, fan):
    draw = random.Random(2)
    df = stream(spark, [draw.random() for _ in range(1003)], gaps=True)
    order = Window.orderBy("seq").rowsBetween(-3, 0)
    plain = df.select("seq", F.when(F.count("x").over(order) == 4, F.avg("x").over(order)).alias("x"))
    want = [r.x for r in plain.orderBy("seq").collect()]
    got = smoothed(df, chunk=chunk, fan=fan)
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g] == pytest.approx([w for w in want if w], abs=1e-12)


@pytest.mark.parametrize("chunk, fan", [(1, 1), (2, 2), (5, 3)])
@pytest.mark.parametrize("scope, keys", [("trial", ["trial"]), ("experiment", ["ExpNr"])])
def test_halo_rows_of_tiny_chunks_with_gaps(spark, scope, keys, chunk, fan):
    draw = random.Random(5)
    trials = [draw.choice([1, 1, 2, None]) for _ in range(300)]
    df = stream(spark, [draw.random() for _ in range(300)], gaps=True).drop("trial").join(
        spark.createDataFrame(list(enumerate(trials, start=1)), "k long, trial int"),
        F.expr("k = 1 + pmod(seq, 300)")).drop("k")
    df = df.withColumn("ExpNr", F.when(F.col("seq") < 900, 1).otherwise(2)).repartition(5)
    order = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-3, 0)
    want = df.select("seq", F.when(F.count("x").over(order) == 4, F.avg("x").over(order)).alias("x")).orderBy("seq").collect()
    got = smoothed(df, scope=scope, chunk=chunk, fan=fan)
    assert [g is None for g in got] == [w.x is None for w in want]
    assert [g for g in got if g] == pytest.approx([w.x for w in want if w.x], abs=1e-12)


def test_plans_have_one_sort_and_two_shuffles_of_the_rows(spark):
    def executed(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.split("== Initial Plan ==")[0]

    df = stream(spark, [float(i % 7) for i in range(500)]).withColumns({
        "item": F.lit("item L"), "phase": F.lit("same"), "cueFrame": F.col("seq") % 7 - 2}).withColumn("cueFrame", F.expr("int(cueFrame)"))
    plan = executed(smoothing.moving_average(df, ["x", "y"], 4, chunk=50))
    assert plan.count(" Exchange ") == 1 and plan.count(" Sort ") == 1 and plan.count(" Window ") == 1
    kept = smoothing.moving_average(df, ["x", "y"], 4, chunk=50, keep_chunk=True)
    plan = executed(averaging.block_means(averaging.trial_cells(kept, ["x", "y"], P), ["x", "y"], P))
    assert plan.count(" Exchange ") == 2 and plan.count(" Window ") == 2


def test_interior_null(spark):
    df = stream(spark, [None, 1.0, 2.0, 3.0, 4.0, None, 5.0, 6.0, 7.0, 8.0])
    with pytest.raises(Exception, match="NULL after a value"):
        smoothed(df)
    with pytest.raises(Exception, match="NULL after a value"):
        smoothed(df, chunk=5, fan=2)
    assert smoothed(df, on_null="null") == [None] * 4 + [2.5] + [None] * 4 + [6.5]


def test_leading_null_only_delays(spark):
    assert smoothed(stream(spark, [None, None, 1.0, 2.0, 3.0, 4.0])) == [None] * 5 + [2.5]


def test_block_means_equal_row_level_baseline(spark, recording):
    draw = random.Random(3)
    rows = recording(*[
        {"SubNr": s, "block": b, "trial": t, "item": f"item {'LR'[t % 2]}", "cueFrame": f, "eyeX": draw.random()}
        for s in (1, 2) for b in (1, 2) for t in range(3) for f in [-2, -1, 0, 0, 1, 2, 3, 3]])
    by_cells = averaging.block_means(averaging.trial_cells(rows, ["eyeX"], P), ["eyeX"], P)
    by_rows = (baseline.baseline_correct(rows, ["eyeX"], P).filter(baseline.in_analysis(P))
               .groupBy(*averaging.BLOCK_CELL).agg(F.avg("eyeX").alias("eyeX")))
    keyed = [{tuple(r[:6]): r.eyeX for r in df.collect()} for df in (by_cells, by_rows)]
    assert keyed[0] == pytest.approx(keyed[1], abs=1e-12) and len(keyed[0]) == 2 * 2 * 2 * 6


def test_one_null_or_no_baseline_makes_the_mean_null(recording):
    rows = recording(
        {"trial": 1, "cueFrame": 0, "eyeX": 1.0}, {"trial": 1, "cueFrame": 1, "eyeX": 3.0},
        {"trial": 2, "cueFrame": 0, "eyeX": 1.0}, {"trial": 2, "cueFrame": 1, "eyeX": None},
        {"trial": 3, "cueFrame": 2, "eyeX": 5.0},
        {"trial": 4, "cueFrame": 0, "eyeX": 1.0}, {"trial": 4, "cueFrame": 3, "eyeX": 4.0})
    blocks = averaging.block_means(averaging.trial_cells(rows, ["eyeX"], P), ["eyeX"], P)
    assert {r.cueFrame: r.eyeX for r in blocks.collect()} == {0: 0.0, 1: None, 2: None, 3: 3.0}


def test_mean_of_block_means_is_not_the_pooled_mean(spark, recording):
    blocks = recording({"block": 1, "eyeX": 1.0}, {"block": 2, "eyeX": 4.0}).select(
        *averaging.BLOCK_CELL, "eyeX")
    assert averaging.subject_means(blocks, ["eyeX"]).first().eyeX == 2.5
    rows = recording(*[{"block": 1, "eyeX": 1.0, "trial": t} for t in range(3)], {"block": 2, "eyeX": 4.0})
    assert rows.agg(F.avg("eyeX")).first()[0] == 1.75
