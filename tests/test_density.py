import math
import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from cuetrace import Params
from cuetrace.operators import density, figures, quantiles
from cuetrace.workspace import materialize

P = Params(grid_size=50, line_points=64)


def points(spark, rows):
    return spark.createDataFrame(rows, "item string, x double, y double")


def test_one_point_is_the_kernel(spark):
    got = density.density_2d(points(spark, [("item R", 10.0, -20.0)]), P).collect()
    grid = np.linspace(-200, 200, 50)
    want = {(i + 1, j + 1): math.exp(-((gx - 10) ** 2 + (gy + 20) ** 2) / 200) / (200 * math.pi)
            for i, gx in enumerate(grid) for j, gy in enumerate(grid)}
    assert {(r.ix, r.iy): r.density for r in got} == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_density_integrates_to_one_and_map_is_the_difference(spark):
    draw = random.Random(5)
    rows = [(f"item {side}", draw.gauss(0, 30), draw.gauss(0, 30)) for side in "LR" for _ in range(700)]
    by_item = density.density_2d(points(spark, rows).repartition(5), P)
    cell = (400 / 49) ** 2
    totals = {r.item: r.t * cell for r in by_item.groupBy("item").agg(F.sum("density").alias("t")).collect()}
    assert totals == pytest.approx({"item L": 1, "item R": 1}, abs=1e-3)
    raster = density.density_map(by_item, P)
    one = raster.filter("ix = 1 AND iy = 50").first()
    assert (one.x, one.y, one.x_cm) == (-24, 25, -200.0) and one.y_cm == pytest.approx(200)
    assert raster.count() == 2500
    layers = {r.layer: r["count"] for r in figures.density_figure(raster).groupBy("layer").count().collect()}
    assert layers == {"raster": 2500, "path": 200, "point": 2, "horizontal": 2, "vertical": 2}


def test_line_density_against_numpy(spark):
    draw = random.Random(6)
    xs = {s: [draw.gauss(0, 20 * k) for _ in range(400)] for k, s in enumerate(("item L", "item R"), start=1)}
    rows = [(s, x, 0.0) for s, v in xs.items() for x in v]
    lines = density.density_1d(points(spark, rows).repartition(4), P)
    got = {(r.item, r.i): r for r in lines.collect()}
    grid = np.linspace(-200, 200, 64)
    for item, values in xs.items():
        v = np.array(values)
        q1, q3 = np.percentile(v, [25, 75])
        bw = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
        want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert got[item, 1].bw == pytest.approx(bw)
        assert [got[item, i].density for i in range(1, 65)] == pytest.approx(list(want), rel=1e-9, abs=1e-15)
    diff = {r.i: r.density for r in density.density_1d_difference(lines).collect()}
    assert diff[32] == pytest.approx(got["item R", 32].density - got["item L", 32].density)


def test_binned_density_is_near_the_exact_one(spark):
    draw = random.Random(9)
    rows = [(s, draw.gauss(0, 25 * k), 0.0) for k, s in enumerate(("item L", "item R"), start=1) for _ in range(900)]
    rows += [("item L", 900.0, 0.0), ("item L", -900.0, 0.0)]  # far outside: they count in the total
    df = points(spark, rows)
    exact = {(r.item, r.i): r for r in density.density_1d(df, P).collect()}
    binned = density.density_1d_binned(df, P).collect()
    assert len(binned) == 128
    top = max(r.density for r in exact.values())
    for r in binned:
        assert r.bw == pytest.approx(exact[r.item, r.i].bw) and r.x == pytest.approx(exact[r.item, r.i].x)
        assert abs(r.density - exact[r.item, r.i].density) < 2e-3 * top


def test_missing_value_in_a_point_is_refused(spark):
    with pytest.raises(Exception, match="missing value"):
        density.density_2d(points(spark, [("item R", None, 0.0)]), P).collect()


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_equal_numpy(spark, accuracy):
    draw = random.Random(7)
    groups = {"a": [draw.gauss(0, 1) for _ in range(501)], "b": [float(draw.randint(0, 3)) for _ in range(90)],
              "c": [5.0], "d": [1e300, -1e300, 2.0, 3.0], "e": [0.0] * 50 + [draw.expovariate(1e-6) for _ in range(30)],
              "f": [2.5] * 4000 + [draw.gauss(0, 1) for _ in range(2000)],
              "g": [math.copysign(10.0 ** draw.uniform(-300, 300), draw.random() - 0.5) for _ in range(3000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("h", None)], "g string, x double")
    df = df.repartition(13)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r.g, r.prob): r.quantile for r in quantiles.group_quantiles(df, "x", "g", probs, accuracy=accuracy).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, vs in groups.items():
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-12), (g, p)


@pytest.mark.parametrize("shape", ["ties", "tails", "normal"])
def test_quantiles_take_two_scans(spark, monkeypatch, shape):
    """The rows are counted by an accumulator each time they are read; few of them are kept for the ranks."""
    draw = random.Random(3)
    make = {"ties": lambda: float(draw.randint(0, 2)), "tails": lambda: 10.0 ** draw.uniform(-300, 300),
            "normal": lambda: draw.gauss(0, 1)}[shape]
    values = [make() for _ in range(20_000)]
    stored = materialize(spark.createDataFrame([("a", v) for v in values], "g string, x double").repartition(4), "values")
    read, kept = spark.sparkContext.accumulator(0), []

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    write = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: (lambda t: (kept.append(t.count()), t)[1])(write(df, name)))
    got = quantiles.group_quantiles(stored.mapInPandas(count, stored.schema), "x", "g", [0.25, 0.75], accuracy=1000).collect()
    assert {r.prob: r.quantile for r in got} == pytest.approx({p: float(np.quantile(values, p)) for p in (0.25, 0.75)}, rel=1e-12)
    assert read.value == 2 * len(values) and max(kept) < len(values) / 50


def test_a_bracket_without_its_rank_is_widened(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(100)], "g string, x double")
    wrong = [Row(g="a", n=100, lo=0.0, hi=99.0, sketch=[60.0, 70.0])]
    got = quantiles.group_quantiles(df, "x", "g", [0.25], accuracy=10, sketched=wrong).collect()
    assert [r.quantile for r in got] == [24.75]


def test_circles_close(spark):
    rows = figures.circles(spark).orderBy("centre", "i").collect()
    assert len(rows) == 200 and rows[0].x == -75.0 and rows[99].x == pytest.approx(-75.0)
    assert all((r.x - r.centre) ** 2 + r.y ** 2 == pytest.approx(625) for r in rows)


def test_limits_censor(spark):
    df = spark.createDataFrame([(0.0, 0.1, 0.05), (100.0, 0.5, 0.4), (3000.0, 0.9, 0.1)], "time_ms double, mean double, se double")
    got = [tuple(r) for r in figures.censored_ribbon(df, (-0.2, 0.75)).select("time_ms", "mean", "ymin", "ymax").collect()]
    assert got[0] == pytest.approx((0.0, 0.1, 0.05, 0.15))
    assert got[1][:2] == (100.0, 0.5) and got[1][3] is None
    assert got[2] == (None, None, None, None)


def test_points_are_not_shuffled(spark):
    df = points(spark, [("item R", 10.0, -20.0), ("item R", 10.0, 3.0), ("item L", 1.0, 0.0)])
    for by_item in (density.density_2d(df, P), density.density_1d(df, P)):
        plan = by_item._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan.split("MapInPandas")[1] and "Exchange" in plan


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_GROUPS", 2)
    df = spark.createDataFrame([(g, 1.0) for g in "abc"], "g string, x double")
    with pytest.raises(ValueError, match="more than 2 groups"):
        quantiles.group_quantiles(df, "x", "g", [0.5])
