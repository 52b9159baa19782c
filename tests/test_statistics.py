import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuetrace import Params
from cuetrace.functions import draws, student
from cuetrace.functions.draws import normal, sign, uniform
from cuetrace.functions.means import strict_mean
from cuetrace.operators import behaviour, inference, permutation, summary, surrogate

P = Params()


def test_known_quantiles_and_tails():
    for df, t in [(1, 12.7062), (10, 2.2281), (71, 1.9939), (1_000_000, 1.96)]:
        assert student.t_ppf(0.975, df) == pytest.approx(t, abs=1e-4)
    assert student.f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert student.f_upper(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-5)
    assert student.f_upper(0, 1, 5) == 1


def test_t_quantile_as_an_expression(spark):
    ns = [*range(1, 41), 71, 100, 101, 499, 1000, 4999, 10_000]
    rows = spark.createDataFrame([(float(n),) for n in [*ns, 0.0, -1.0]] + [(None,)], "df double")
    for confidence in (0.95, 0.5, 0.999):
        found = rows.select("df", student.t_quantile(confidence)(F.col("df")).alias("t"))
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.df: r.t for r in found.collect()}
        assert got[0.0] is None and got[-1.0] is None and got[None] is None
        for n in ns:
            assert got[n] == pytest.approx(student.t_ppf((1 + confidence) / 2, n), rel=1e-9), (n, confidence)


def test_summaries_need_no_python(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0), (2, "b", 5.0)], "SubNr int, item string, v double")
    for found in (summary.summary_se(rows, "v", ["item"], P), summary.summary_within(rows, "v", "item", [], P)):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0)], "g string, x double")
    got = {r.g: (r.strict, r.loose) for r in df.groupBy("g").agg(
        strict_mean(F.col("x")).alias("strict"), F.avg("x").alias("loose")).collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0)}


def test_summary_with_and_without_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("a", None), ("b", 5.0)], "g string, x double")
    loose = {r.g: r for r in summary.summary_se(df, "x", ["g"], P, na_rm=True).collect()}
    assert (loose["a"].n, loose["a"].mean) == (3, 3.0)
    assert loose["a"].se == pytest.approx(math.sqrt(7 / 3))
    assert loose["a"].ci == pytest.approx(math.sqrt(7 / 3) * 4.302653, abs=1e-5)
    assert (loose["b"].n, loose["b"].sd, loose["b"].ci) == (1, None, None)
    strict = {r.g: r for r in summary.summary_se(df, "x", ["g"], P).collect()}
    assert (strict["a"].n, strict["a"].mean, strict["a"].sd) == (4, None, None)


LONG = "ExpNr int, measure string, SubNr int, item string, value double"


def long_rows(pairs):
    return [(1, "error", s, item, v) for s, (left, right) in enumerate(pairs, start=1)
            for item, v in (("item L", left), ("item R", right))]


def test_within_summary(spark):
    pairs = [(1.0, 2.0), (4.0, 7.0), (10.0, 12.0)]
    rows = {r.item: r for r in summary.summary_within(
        spark.createDataFrame(long_rows(pairs), LONG), "value", "item", ["ExpNr", "measure"], P).collect()}
    y = np.array(pairs)
    norm = y - y.mean(axis=1, keepdims=True) + y.mean()
    for k, item in enumerate(["item L", "item R"]):
        assert rows[item].mean == pytest.approx(y[:, k].mean())
        assert rows[item].mean_norm == pytest.approx(norm[:, k].mean())
        assert rows[item].sd == pytest.approx(norm[:, k].std(ddof=1) * math.sqrt(2))


def test_anova_of_two_levels_is_the_squared_paired_t(spark):
    draw = random.Random(4)
    pairs = [(draw.gauss(0, 1), draw.gauss(0.5, 1)) for _ in range(9)]
    rows = long_rows(pairs) + [(1, "error", 99, "item L", 5.0)]  # incomplete subject
    got = inference.rm_anova(spark.createDataFrame(rows, LONG), "value", "item", ["item L", "item R"],
                             ["ExpNr", "measure"], P).first()
    d = np.array([b - a for a, b in pairs])
    t = d.mean() / d.std(ddof=1) * 3
    assert (got.dfn, got.dfd) == (1, 8) and got.f == pytest.approx(t * t)
    assert got.p == pytest.approx(2 * student.t_upper(abs(t), 8)) and got.significant == (got.p < 0.05)


def test_anova_of_three_levels(spark):
    y = np.array([[45, 50, 55], [42, 42, 45], [36, 41, 43], [39, 35, 40], [51, 55, 59], [44, 49, 56]], float)
    rows = [(1, "m", s, f"l{k}", float(v)) for s, row in enumerate(y) for k, v in enumerate(row)]
    got = inference.rm_anova(spark.createDataFrame(rows, LONG), "value", "item", ["l0", "l1", "l2"],
                             ["ExpNr"], P).first()
    assert (got.dfn, got.dfd) == (2, 10)
    assert got.f == pytest.approx(12.534, abs=1e-3) and got.p == pytest.approx(0.00189, abs=1e-5)
    assert got.ges == pytest.approx(143.4444 / (143.4444 + 658.2778 + 57.2222), abs=1e-5)


@pytest.mark.parametrize("t, bf", [(0.0, 0.21463), (2.0, 1.16639), (3.0, 7.06673)])
def test_bayes_factor_known_values(spark, t, bf):
    got = spark.range(1).select(inference.jzs_bayes_factor(F.lit(t), F.lit(24.0), P.prior_scale)).first()[0]
    assert got == pytest.approx(bf, abs=1e-5)


def test_joint_complete_cases_and_pairing(recording):
    rows = recording({"block": 1, "error": 4.0, "ResponseTime": 1.0}, {"block": 1, "error": None, "ResponseTime": 9.0},
                     {"block": 2, "error": 8.0, "ResponseTime": 2.0}, {"block": 1, "item": "item R", "error": 7.0},
                     {"block": 1, "item": "item R", "cueFrame": 1, "error": 99.0}, {"SubNr": 2, "error": 1.0})
    subjects = behaviour.by_measure(behaviour.behaviour_subjects(behaviour.behaviour_blocks(rows)))
    got = {(r.SubNr, r.item, r.measure): r.value for r in subjects.collect()}
    assert got[1, "item L", "error"] == 6.0 and got[1, "item L", "ResponseTime"] == 1.5
    diffs = {(r.SubNr, r.measure): r["diff"] for r in behaviour.paired_differences(subjects).collect()}
    assert diffs == {(1, "error"): 1.0, (1, "ResponseTime"): -0.5}


def test_draws_do_not_depend_on_partitions(spark):
    def values(n):
        return spark.range(0, 2000, 1, n).select("id", uniform(F.lit(22), F.col("id")).alias("u"), normal(
            F.lit(22), F.col("id")).alias("z"), sign(F.lit(22), F.col("id")).alias("s")).orderBy("id").collect()

    one = values(1)
    assert one == values(7)
    z = np.array([r.z for r in one])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs(sum(r.s for r in one)) < 150
    assert 0 <= min(r.u for r in one) < 0.01 and 0.99 < max(r.u for r in one) < 1


SMALL = Params(baseline=4, posttrigger=9, permutations=99)  # frames -3 .. 8


def cohort(spark, effect, subjects=12, seed=0):
    draw = np.random.default_rng(seed)
    rows = [("yaw", s + 1, f, float(draw.normal() + (effect if 2 <= f <= 5 else 0)))
            for s in range(subjects) for f in SMALL.frames]
    return spark.createDataFrame(rows, "signal string, SubNr int, cueFrame int, d double")


def brute_force_f(rows):
    """F of every permutation, straight from the definition."""
    table = {(r.SubNr, r.cueFrame): r.d for r in rows}
    subjects, frames = sorted({k[0] for k in table}), SMALL.frames
    d = np.array([[table[s, f] for f in frames] for s in subjects])
    import hashlib
    out = []
    for perm in range(SMALL.permutations):
        digests = [int(hashlib.md5(f"22|yaw|{perm // 128}|{s}".encode()).hexdigest(), 16) for s in subjects]
        flips = np.array([1.0 if perm == 0 or not d >> (127 - perm % 128) & 1 else -1.0 for d in digests])
        x = d * flips[:, None]
        out.append(len(subjects) * x.mean(axis=0) ** 2 / x.var(axis=0, ddof=1))
    return np.array(out)


def brute_force_cluster_depth(f, threshold):
    """p per frame by loops over clusters, depths and permutations."""
    count, width = f.shape

    def runs(row):
        found, start = [], None
        for i in range(width + 1):
            above = i < width and row[i] > threshold
            if above and start is None:
                start = i
            if not above and start is not None:
                found.append((start, i - 1))
                start = None
        return found

    def depths(row, run, tail):
        part = row[run[0]:run[1] + 1]
        return part[::-1] if tail else part

    p = np.full((2, width), np.nan)
    for tail in (False, True):
        usable = [[r for r in runs(row) if (r[1] < width - 1 if tail else r[0] > 0)] for row in f]
        null = np.zeros((count, width))
        for k, row in enumerate(f):
            for run in usable[k]:
                part = depths(row, run, tail)
                null[k, :len(part)] = np.maximum(null[k, :len(part)], part)
        for run in usable[0]:
            own = depths(f[0], run, tail)
            stat = null[:, :len(own)].copy()
            stat[0] = own
            each = np.array([[(stat[:, j] >= v).mean() for j, v in enumerate(row)] for row in stat])
            order = np.argsort(each[0], kind="stable")
            adjusted, top = np.empty(len(own)), 0.0
            for i in range(len(order)):
                smallest = each[:, order[i:]].min(axis=1)
                top = max(top, (smallest <= each[0, order[i]]).mean())
                adjusted[order[i]] = top
            at = range(run[1], run[0] - 1, -1) if tail else range(run[0], run[1] + 1)
            p[int(tail), list(at)] = adjusted
    return np.array([np.nan if np.isnan(c).all() else np.nanmax(c) for c in p.T])


@pytest.mark.parametrize("effect, seed", [(0.0, 1), (1.2, 2), (3.0, 3)])
def test_permutation_test_against_brute_force(spark, effect, seed):
    d = cohort(spark, effect, seed=seed)
    f = permutation.permutation_f(d, SMALL.permutations, SMALL)
    want = brute_force_f(d.collect())
    got = {(r.perm, r.cueFrame): r.f for r in f.collect()}
    assert got == pytest.approx({(k, fr): want[k, i] for k in range(len(want)) for i, fr in enumerate(SMALL.frames)},
                                rel=1e-9)
    assert {r.cueFrame: r.f for r in permutation.frame_f(d).collect()} == pytest.approx(
        {fr: want[0, i] for i, fr in enumerate(SMALL.frames)}, rel=1e-9)
    threshold = student.t_ppf(0.975, 11) ** 2
    scalars = spark.createDataFrame([("yaw", threshold)], "signal string, f_threshold double")
    tested = {r.cueFrame: r for r in permutation.cluster_depth(f, scalars, SMALL.permutations, SMALL).collect()}
    assert sorted(tested) == SMALL.frames
    for frame, p in zip(SMALL.frames, brute_force_cluster_depth(want, threshold)):
        assert (tested[frame].p is None) == bool(np.isnan(p))
        assert np.isnan(p) or tested[frame].p == pytest.approx(p)
        assert np.isnan(p) or 1 / SMALL.permutations <= tested[frame].p <= 1
        assert (tested[frame].cluster_id > 0) == (tested[frame].f > threshold)
    if effect == 3.0:
        found = {r.cueFrame: r.time_ms for r in permutation.significant_frames(
            spark.createDataFrame([tested[f] for f in SMALL.frames],
                                  "signal string, cueFrame int, f double, cluster_id int, p double"), SMALL).collect()}
        assert {3, 4} <= set(found) <= set(range(1, 7)) and found[3] == pytest.approx(100 / 3)


def test_islands_and_border_runs(spark):
    f = {-3: 9, -2: 9, -1: 0, 0: 9, 1: 9, 2: 9, 3: 0, 4: 9, 5: 0, 6: 0, 7: 9, 8: 9}
    rows = spark.createDataFrame([("yaw", 0, k, float(v)) for k, v in f.items()],
                                 "signal string, perm int, cueFrame int, f double")
    scalars = spark.createDataFrame([("yaw", 5.0)], "signal string, f_threshold double")
    runs = permutation.islands(rows, scalars)
    assert {(r.start, r.end) for r in runs.collect()} == {(-3, -2), (0, 2), (4, 4), (7, 8)}
    depths = {(r.test, r.cueFrame): r.depth for r in permutation._depths(runs, SMALL).collect()}
    assert depths == {("tail", -3): 2, ("tail", -2): 1, ("head", 0): 1, ("head", 1): 2, ("head", 2): 3,
                      ("tail", 0): 3, ("tail", 1): 2, ("tail", 2): 1, ("head", 4): 1, ("tail", 4): 1,
                      ("head", 7): 1, ("head", 8): 2}


def test_unbalanced_cohort_is_refused(spark):
    stats = spark.createDataFrame([("yaw", 0, 3, 1.0), ("yaw", 1, 2, 2.0)], "signal string, cueFrame int, n long, sd double")
    with pytest.raises(Exception, match="varies over frames"):
        surrogate.cohort_scalars(stats, P).collect()
    loose = surrogate.cohort_scalars(stats, P, strict=False).first()
    assert (loose.n_subjects, loose.n_frames, loose.mean_sd) == (3, 2, 1.5)
    long = spark.createDataFrame([("yaw", 7, 0, "same", 1.0)], "signal string, SubNr int, cueFrame int, phase string, value double")
    with pytest.raises(Exception, match="numbered 1..N"):
        surrogate.with_surrogate(long, surrogate.cohort_scalars(stats, P, strict=False), P).collect()


@pytest.mark.parametrize("method", ["signs", "residuals"])
def test_family_wise_error_and_power(spark, method):
    """Forty cohorts of smooth noise and ten with an effect, each as a signal of its own."""
    draw, rows = np.random.default_rng(11), []
    for k in range(50):
        noise = draw.normal(size=(14, 16))
        smooth = np.array([np.convolve(row, np.ones(5) / 5, "valid") for row in noise])  # 12 frames
        if k >= 40:
            smooth[:, 4:9] += 0.9
        rows += [(f"s{k}", s + 1, f, float(smooth[s, i])) for s in range(14) for i, f in enumerate(SMALL.frames)]
    d = spark.createDataFrame(rows, "signal string, SubNr int, cueFrame int, d double")
    draw_f = permutation.residual_f if method == "residuals" else permutation.permutation_f
    f = draw_f(d, 99, SMALL)
    scalars = d.select("signal").distinct().withColumn("f_threshold", F.lit(student.t_ppf(0.975, 13) ** 2))
    hit = permutation.cluster_depth(f, scalars, 99, SMALL).filter("p < 0.05")
    found = {r.signal: set(r.frames) for r in hit.groupBy("signal").agg(F.collect_set("cueFrame").alias("frames")).collect()}
    assert sum(f"s{k}" in found for k in range(40)) <= 6
    for k in range(40, 50):
        assert {2, 3, 4} <= found[f"s{k}"]


def test_permuted_residuals_against_brute_force(spark):
    """Cells dealt one by one and F from the two conditions' values; one subject lacks two frames, one value repeats."""
    d = cohort(spark, 0.7, seed=5).filter("not (SubNr = 4 and cueFrame in (0, 8))")
    d = d.withColumn("d", F.when(F.col("cueFrame") == 3, 1.5).otherwise(F.col("d")))
    table = {(r.SubNr, r.cueFrame): r.d for r in d.collect()}
    got = {(r.perm, r.cueFrame): r.f for r in permutation.residual_f(d.repartition(5), 40, SMALL).collect()}
    assert len(got) == 40 * len(SMALL.frames) and got[0, 3] is None  # no variance
    import hashlib
    for perm in range(40):
        keys = []
        for s in range(1, 13):
            digest = hashlib.md5(f"22|yaw|{perm}|{s}".encode()).hexdigest()
            keys += [(digest[:16], s, 1), (digest[16:], s, -1)]
        for frame in SMALL.frames:
            cells = [side * table[s, frame] / 2 for _, s, side in sorted(keys) if (s, frame) in table]
            first, second = np.array(cells[0::2]), np.array(cells[1::2])
            new = first - second if perm else np.array([table[s, frame] for s in range(1, 13) if (s, frame) in table])
            if frame != 3:
                assert got[perm, frame] == pytest.approx(len(new) * new.mean() ** 2 / new.var(ddof=1), rel=1e-9)
    with pytest.raises(Exception, match="more than one value per cell"):
        permutation.residual_f(d.union(d), 3, SMALL).collect()
    assert permutation.residual_f(d.limit(0), 3, SMALL).count() == 0


def test_too_many_subjects_for_residuals_are_refused(spark, monkeypatch):
    monkeypatch.setattr(permutation, "MAX_SUBJECTS", 11)
    with pytest.raises(Exception, match="more than 11 subjects"):
        permutation.residual_f(cohort(spark, 0.0), 3, SMALL).collect()


def test_signs_in_a_task_are_those_of_the_column(spark):
    drawn = spark.range(200).select(draws.permutation_sign(F.lit(22), F.lit("gaze"), F.col("id").cast("int"), F.lit(7)))
    assert [r[0] for r in drawn.collect()] == draws.signs(22, "gaze", 200, 7).tolist()
    ones = np.array([draws.signs(22, "gaze", 5000, s) for s in range(40)])
    assert abs(ones.mean()) < 0.01 and abs((ones[:, 1:] * ones[:, :-1]).mean()) < 0.01 and set(ones.ravel()) == {1.0, -1.0}


def shuffled_rows(df):
    """Rows written to shuffles that follow a Python stage."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        children = [node.children().apply(i) for i in range(node.children().size())]
        if name == "Exchange" and "MapIn" in node.toString():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += children
    return found


def test_partial_sums_do_not_follow_the_number_of_tasks(spark):
    from cuetrace.operators import density, partials
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 'item L', 'item R') AS item", "id % 37 AS x", "id % 41 AS y").selectExpr(
        "item", "double(x) AS x", "double(y) AS y")
    most = 2 * partials.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    results = []
    for parts in (4, 400):
        found = density.density_2d(rows.repartition(parts), P)
        results.append({(r.item, r.ix, r.iy): r.density for r in found.collect()})
        blocks = -(-P.grid_size ** 2 // partials.BLOCK)
        assert 0 < max(shuffled_rows(found)) <= most * blocks
    assert results[0] == pytest.approx(results[1], rel=1e-9)


def test_rounds_of_the_tree_sum(spark):
    from cuetrace.operators import partials
    array = np.arange(5.0)
    parts = spark.createDataFrame([("a" if k % 3 else "b", 0, k, (array * k).tobytes(), k) for k in range(100)],
                                  "g string, at int, part int, total binary, n long").repartition(7)
    for fan_in in (2, 7, 64):
        got = {r.g: (np.frombuffer(bytes(r.total)), r.n) for r in partials.tree_sum(parts, ["g"], 100, fan_in).collect()}
        for g in "ab":
            n = sum(k for k in range(100) if ("a" if k % 3 else "b") == g)
            assert got[g][1] == n and got[g][0].tolist() == (array * n).tolist()
