"""Permutation test over time: frame-wise F, its distribution without effect, cluster-depth p-values.

Specification (Frossard & Renaud 2022, Troendle 1995). The distribution comes from sign flips of the subject
differences (`permutation_f`) or from permuted residuals of the reduced model (`residual_f`), as R packages that
offer the test do. Clusters touching a border of the window are treated as written at `cluster_depth`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cuetrace.functions.draws import shuffled_cells, signs
from cuetrace.functions.means import ratio
from cuetrace.operators.partials import few_tasks, pieces, spread, tree_sum
from cuetrace.params import Params

SUBJECTS_PER_BLOCK = 256       # bounds the matrix of signs
FRAMES_PER_TASK = 16           # frames whose residuals a task permutes together
MAX_SUBJECTS = 1_000_000       # a residual task holds a number per subject for each of its frames


def frame_f(d: DataFrame) -> DataFrame:
    """Per (signal, frame): n and the repeated-measures F of observed against random."""
    n = F.count("d")
    return d.groupBy("signal", "cueFrame").agg(
        n.alias("n"), ratio(n * F.avg("d") * F.avg("d"), F.var_samp("d")).alias("f"))


def permutation_f(d: DataFrame, permutations: int, p: Params) -> DataFrame:
    """F per (signal, perm, frame) under random signs per (perm, subject); perm 0 is the data.

    Subjects are spread over tasks, one row of frames each. A task draws the signs of each subject
    and adds the signed rows up in numpy, one matrix product per block of subjects; its sums travel as binary
    rows and are merged in rounds. Sums of squares do not depend on the signs and are taken once.
    """
    first, size = p.first_frame, len(p.frames)
    inside = d.filter(F.col("d").isNotNull() & F.col("cueFrame").between(p.first_frame, p.last_frame))
    cells = F.collect_list(F.struct("cueFrame", "d"))  # at most one per frame
    subjects, tasks = few_tasks(inside.groupBy("signal", "SubNr").agg(cells.alias("c")).select(
        "signal", "SubNr", F.col("c.cueFrame").alias("at"), F.col("c.d").alias("d")))

    def partial(batches):
        sums = {}
        for batch in batches:
            for signal, rows in batch.groupby("signal"):
                total = sums.setdefault(signal, np.zeros((permutations, size)))
                for start in range(0, len(rows), SUBJECTS_PER_BLOCK):
                    block = rows.iloc[start:start + SUBJECTS_PER_BLOCK]
                    values = np.zeros((len(block), size))
                    for row, at, x in zip(values, block["at"], block["d"]):
                        if len(set(at)) < len(at):
                            raise ValueError("more than one value per cell")
                        row[np.asarray(at) - first] = x
                    flips = np.array([signs(p.seed, signal, permutations, s) for s in block["SubNr"]])
                    flips[:, 0] = 1.0
                    total += flips.T @ values
        for signal, total in sums.items():
            for at, part, block in pieces(total):
                yield pd.DataFrame({"signal": [signal], "at": [at], "part": [part], "total": [block], "n": [0]})

    parts = subjects.mapInPandas(partial, "signal string, at int, part int, total binary, n long")
    rows = spread(tree_sum(parts, ["signal"], tasks), ["signal"], (permutations, size), ["perm", "frame"], "s").select(
        "signal", "perm", (F.col("frame") + first).alias("cueFrame"), "s")
    # One row per signal and frame of the window, however many subjects there are.
    frames = d.groupBy("signal", "cueFrame").agg(
        F.count("d").cast("double").alias("n"), F.sum(F.col("d") * F.col("d")).alias("q"))
    mean = ratio(F.col("s"), F.col("n"))
    square = F.col("n") * mean * mean
    return (rows.join(F.broadcast(frames), ["signal", "cueFrame"])
            .select("signal", "perm", "cueFrame",
                    ratio(square, ratio(F.col("q") - square, F.col("n") - 1)).alias("f")))


def residual_f(d: DataFrame, permutations: int, p: Params) -> DataFrame:
    """F per (signal, perm, frame) with permuted residuals of the reduced model; perm 0 is the data.

    The reduced model has the subjects but no effect of the condition. With two conditions its residuals are +d/2 and
    -d/2 of each subject's difference d. A permutation deals them anew over all cells of subject and condition, all
    frames alike; each subject's new difference gives F as in the data.

    Against sign flips: these keep each difference's size with its subject and hold exactly when differences are
    symmetric; here the residuals of different subjects meet in a cell, which treats all subjects as equally variable. A subject with much
    larger differences than the others thus spreads over the cohort. A frame that lacks subjects permutes
    the residuals it has, in the same order.

    New differences pair any two cells, so sums per block of subjects do not add up as with signs. The work is
    spread over frames: a task holds `FRAMES_PER_TASK` frames of one signal with a number per subject, and draws one
    permutation at a time. More than `MAX_SUBJECTS` subjects are refused; sign flips have no such bound.
    """
    inside = d.filter(F.col("d").isNotNull() & F.col("cueFrame").between(p.first_frame, p.last_frame))
    part = F.floor((F.col("cueFrame") - p.first_frame) / FRAMES_PER_TASK).cast("int")
    # At most MAX_SUBJECTS x FRAMES_PER_TASK rows go to a group, or the task fails before it is built.
    counted = inside.groupBy("signal", "cueFrame").agg(F.count("d").alias("n"))
    most = counted.groupBy("signal").agg(F.max("n").alias("most"))
    refused = F.raise_error(F.lit(f"residual permutation of more than {MAX_SUBJECTS} subjects")).cast("int")
    sized = inside.join(most, "signal").select("signal", "SubNr", "cueFrame", "d", F.when(
        F.col("most") > MAX_SUBJECTS, refused).otherwise(part).alias("part"))

    def permute(rows: pd.DataFrame) -> pd.DataFrame:
        signal = rows.signal.iloc[0]
        if rows.duplicated(["SubNr", "cueFrame"]).any():
            raise ValueError("more than one value per cell")
        table = rows.pivot(index="SubNr", columns="cueFrame", values="d").sort_index()
        subjects, frames, half = table.index.to_numpy(), table.columns.to_numpy(), table.to_numpy() / 2
        cells = np.repeat(half, 2, axis=0)  # the two cells of a subject beside each other
        cells[1::2] *= -1
        there = ~np.isnan(cells)
        whole = there.all(axis=0)
        n = there.sum(axis=0) / 2
        square = np.nansum(half * half, axis=0) * 4
        sums = np.empty((permutations, len(frames)))
        squares = np.empty_like(sums)
        sums[0], squares[0] = np.nansum(half, axis=0) * 2, square
        for perm in range(1, permutations):
            order = shuffled_cells(p.seed, signal, perm, subjects)
            new = cells[order]
            new = new[0::2] - new[1::2]
            sums[perm], squares[perm] = new.sum(axis=0), (new * new).sum(axis=0)
            for at in np.flatnonzero(~whole):
                own = cells[order[there[order, at]], at]
                own = own[0::2] - own[1::2]
                sums[perm, at], squares[perm, at] = own.sum(), (own * own).sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            between = sums * sums / n
            f = between * (n - 1) / (squares - between)
        f[~np.isfinite(f)] = np.nan
        return pd.DataFrame({"signal": signal, "perm": np.repeat(np.arange(permutations), len(frames)),
                             "cueFrame": np.tile(frames, permutations), "f": f.ravel()})

    found = sized.groupBy("signal", "part").applyInPandas(permute, "signal string, perm int, cueFrame int, f double")
    return found.withColumn("f", F.when(~F.isnan("f"), F.col("f")))


def islands(f: DataFrame, scalars: DataFrame) -> DataFrame:
    """Rows above the signal's F threshold, with `start` and `end` of their run of frames."""
    flagged = (f.join(F.broadcast(scalars.select("signal", "f_threshold")), "signal")
               .filter(F.col("f") > F.col("f_threshold")).drop("f_threshold"))
    by_perm = Window.partitionBy("signal", "perm").orderBy("cueFrame")
    run = Window.partitionBy("signal", "perm", "_run")
    return (flagged.withColumn("_run", F.col("cueFrame") - F.row_number().over(by_perm))
            .withColumns({"start": F.min("cueFrame").over(run), "end": F.max("cueFrame").over(run)})
            .drop("_run"))


def _depths(runs: DataFrame, p: Params) -> DataFrame:
    """Rows (signal, perm, start, cueFrame, f, test, depth): depth from the run's head for runs
    whose first frame is seen to be one, from its tail likewise."""
    tests = F.array_compact(F.array(
        F.when(F.col("start") > p.first_frame, F.struct(
            F.lit("head").alias("test"), (F.col("cueFrame") - F.col("start") + 1).alias("depth"))),
        F.when(F.col("end") < p.last_frame, F.struct(
            F.lit("tail").alias("test"), (F.col("end") - F.col("cueFrame") + 1).alias("depth")))))
    return runs.select("signal", "perm", "start", "cueFrame", "f", F.inline(tests))


def cluster_depth(f: DataFrame, scalars: DataFrame, permutations: int, p: Params) -> DataFrame:
    """Per (signal, frame): f, cluster_id (0 outside clusters) and cluster-depth p (NULL there).

    1. Runs of F above the 0.95 quantile of F(1, N - 1) are clusters, in every permutation.
    2. Null distribution of depth j: per permutation the largest F at depth j, 0 if none.
    3. For each observed cluster, perm 0 takes the cluster's own F; the p of each
       (perm, depth) is the share of permutations with a statistic at least as large.
    4. Step-down over the depths in the order of perm 0's p: adjusted p = share of
       permutations whose smallest p among this and later depths is not above perm 0's,
       then a running maximum.
    5. Depth is counted from the head and from the tail; the larger p counts. A cluster that
       touches the window's first (last) frame has no head (tail) test and takes the other
       p; touching both, its p is NULL.

    All windows are over the frames of one permutation or the permutations of one depth.
    """
    runs = islands(f, scalars)
    depths = _depths(runs, p)
    null = depths.groupBy("signal", "test", "perm", "depth").agg(F.max("f").alias("null_f"))
    observed = depths.filter(F.col("perm") == 0).select("signal", "test", "start", "depth", "cueFrame", "f")
    drawn = (observed.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
             .join(null, ["signal", "test", "perm", "depth"], "left")
             .withColumn("stat", F.when(F.col("perm") == 0, F.col("f"))
                         .otherwise(F.coalesce("null_f", F.lit(0.0)))))
    cell = ["signal", "test", "start", "depth"]
    by_size = Window.partitionBy(*cell).orderBy(F.col("stat").desc())  # range frame: ties counted
    ranked = drawn.withColumn("p", F.count(F.lit(1)).over(by_size) / F.lit(float(permutations)))
    ranked = ranked.withColumn("p0", F.max(F.when(F.col("perm") == 0, F.col("p"))).over(
        Window.partitionBy(*cell)))
    later = (Window.partitionBy("signal", "test", "start", "perm")
             .orderBy(F.col("p0").desc(), F.col("depth").desc())
             .rowsBetween(Window.unboundedPreceding, 0))
    adjusted = (ranked.withColumn("q", F.min("p").over(later))
                .groupBy(*cell, "cueFrame")
                .agg(F.first("p0").alias("p0"),
                     F.avg((F.col("q") <= F.col("p0")).cast("double")).alias("adj")))
    upto = (Window.partitionBy("signal", "test", "start").orderBy("p0", "depth")
            .rowsBetween(Window.unboundedPreceding, 0))
    per_frame = (adjusted.withColumn("p", F.max("adj").over(upto))
                 .groupBy("signal", "cueFrame").agg(F.max("p").alias("p")))
    clusters = (runs.filter(F.col("perm") == 0)
                .select("signal", "cueFrame", F.dense_rank().over(
                    Window.partitionBy("signal").orderBy("start")).alias("cluster_id")))
    return (f.filter(F.col("perm") == 0).select("signal", "cueFrame", "f")
            .join(clusters, ["signal", "cueFrame"], "left")
            .join(per_frame, ["signal", "cueFrame"], "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0))))


def significant_frames(tested: DataFrame, p: Params) -> DataFrame:
    """Frames with p below alpha, with their time after the cue in ms."""
    return (tested.filter(F.col("p") < p.alpha)
            .select("signal", "cueFrame", (F.col("cueFrame") * F.lit(p.ms_per_frame)).alias("time_ms"), "p"))
