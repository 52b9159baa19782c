"""Gaussian kernel densities on fixed grids: exact kernel sums, in parallel over the points.

A point adds to every cell of its grid, which no join should write out. Kernel sums add up, so
points are not moved: each task of the scan counts its equal points in a table of bounded size, adds up the kernels in
numpy (for the 2-D grid one matrix product per block) and returns its partial grid as binary rows; only these
are shuffled, and merged in rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cuetrace.operators.partials import few_tasks, pieces, spread, tree_sum
from cuetrace.operators.quantiles import collect_groups, group_quantiles, sketch
from cuetrace.params import Params
from cuetrace.schema import ITEM_LEFT, ITEM_RIGHT
from cuetrace.workspace import materialize

COUNTED = 100_000       # different points in a task's table
POINTS_PER_BLOCK = 512  # a kernel matrix of grid x block stays in a core's cache


def density_points(rows: DataFrame, p: Params) -> DataFrame:
    """Head direction in cm, its height relative to the display, from raw rows of both items."""
    return (rows.filter((F.col("cueFrame") > p.density_from) & (F.col("cueFrame") < p.posttrigger)
                        & F.col("item").isin(ITEM_LEFT, ITEM_RIGHT))
            .select("item", (F.col("headBiasX") * 100).alias("x"),
                    (F.col("headBiasY") * 100 - F.col("DisplayHeight") * 100).alias("y")))


def _kernel(grid: np.ndarray, at: np.ndarray, sd: float) -> np.ndarray:
    z = grid[:, None] - at[None, :]
    np.multiply(z, z, out=z)
    z *= -0.5 / (sd * sd)
    np.exp(z, out=z)
    z /= sd * np.sqrt(2 * np.pi)
    return z


class _Counts:
    """The different points of a task with their counts: at most `COUNTED` of them, and what has come since they were
    last put together. When there are more, all are handed on to be added up."""

    def __init__(self):
        self.kept, self.new, self.rows = None, [], 0

    def add(self, batch: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
        if batch.isnull().values.any():
            raise ValueError("density: missing value in a point")
        counted = batch.groupby(list(batch.columns), sort=False).size().reset_index(name="w")
        self.new.append(counted)
        self.rows += len(counted)
        if self.rows >= COUNTED:
            self._put_together()
            if len(self.kept) > COUNTED:
                yield from self.rest()

    def _put_together(self) -> None:
        found = pd.concat([*([] if self.kept is None else [self.kept]), *self.new])
        self.kept = found.groupby(list(found.columns[:-1]), sort=False)["w"].sum().reset_index()
        self.new, self.rows = [], 0

    def rest(self) -> Iterator[tuple[str, pd.DataFrame]]:
        """One item at a time, in blocks that bound the kernel matrix."""
        if self.new:
            self._put_together()
        if self.kept is not None:
            for item, points in self.kept.groupby("item"):
                for at in range(0, len(points), POINTS_PER_BLOCK):
                    yield item, points.iloc[at:at + POINTS_PER_BLOCK]
        self.kept = None


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    counts = _Counts()
    for batch in batches:
        yield from counts.add(batch)
    yield from counts.rest()


def density_2d(points: DataFrame, p: Params) -> DataFrame:
    """Density per item on the square grid: item, ix, iy (1-based), density."""
    size, sd = p.grid_size, p.kde_width / 4
    grid = np.linspace(-p.grid_limit, p.grid_limit, size)

    def partial(batches):
        sums, counts = defaultdict(lambda: np.zeros((size, size))), defaultdict(int)
        for item, block in _blocks(batches):
            w = block.w.to_numpy()
            sums[item] += _kernel(grid, block.x.to_numpy(), sd) @ (_kernel(grid, block.y.to_numpy(), sd) * w).T
            counts[item] += int(w.sum())
        for item, total in sums.items():
            for at, part, numbers in pieces(total):
                yield pd.DataFrame({"item": [item], "at": [at], "part": [part], "total": [numbers], "n": [counts[item]]})

    few, tasks = few_tasks(points.select("item", "x", "y"))
    parts = few.mapInPandas(partial, "item string, at int, part int, total binary, n long")
    rows = spread(tree_sum(parts, ["item"], tasks), ["item"], (size, size), ["ix", "iy"], "total")
    return rows.select("item", (F.col("ix") + 1).alias("ix"), (F.col("iy") + 1).alias("iy"),
                       (F.col("total") / F.col("n")).alias("density"))


def grid_cm(index: str, p: Params):
    """Coordinate in cm of a 1-based grid index."""
    return F.lit(-p.grid_limit) + (F.col(index) - 1) * F.lit(2 * p.grid_limit / (p.grid_size - 1))


def density_map(by_item: DataFrame, p: Params) -> DataFrame:
    """Right - left density as a raster. `x`, `y` are grid indices around 0; `x_cm`, `y_cm` real."""
    half = p.grid_size // 2

    def side(item: str):
        return F.max(F.when(F.col("item") == item, F.col("density")))

    return (by_item.groupBy("ix", "iy").agg((side(ITEM_RIGHT) - side(ITEM_LEFT)).alias("density"))
            .select("ix", "iy", (F.col("ix") - half).alias("x"), (F.col("iy") - half).alias("y"),
                    grid_cm("ix", p).alias("x_cm"), grid_cm("iy", p).alias("y_cm"), "density"))


def bandwidths(points: DataFrame) -> DataFrame:
    """Per item the rule-of-thumb bandwidth 0.9 min(sd, IQR / 1.34) n^(-1/5) of x.

    One scan gives n, mean, sd and brackets of the quartiles, a second the quartiles.
    """
    probs = [0.25, 0.75]
    found = collect_groups(points.groupBy("item").agg(
        *sketch("x", probs), F.stddev_samp("x").alias("sd"), F.avg("x").alias("mean")))
    quartiles = {(r.item, r.prob): r.quantile for r in group_quantiles(
        points, "x", "item", probs, sketched=found).collect()}
    spread = points.sparkSession.createDataFrame(
        [(r.item, r.n, r.sd, r.mean, quartiles[r.item, 0.75] - quartiles[r.item, 0.25] if r.n else None)
         for r in found], "item string, n long, sd double, mean double, iqr double")

    def positive(x):
        return F.when(x > 0, x)

    low = F.least(F.col("sd"), F.col("iqr") / 1.34)
    width = F.coalesce(positive(low), positive(F.col("sd")), positive(F.abs("mean")), F.lit(1.0))
    return spread.select("item", "n", (F.lit(0.9) * width * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
                         .alias("bw"))


def density_1d(points: DataFrame, p: Params) -> DataFrame:
    """Density of x per item, each with its own bandwidth: item, i, x, bw, density."""
    grid = np.linspace(-p.grid_limit, p.grid_limit, p.line_points)

    def partial(batches):
        sums, counts, bw = defaultdict(lambda: np.zeros(len(grid))), defaultdict(int), {}
        for item, block in _blocks(batches):
            bw[item] = block.bw.iloc[0]
            w = block.w.to_numpy()
            sums[item] += _kernel(grid, block.x.to_numpy(), bw[item]) @ w
            counts[item] += int(w.sum())
        for item, total in sums.items():
            for at, part, numbers in pieces(total):
                yield pd.DataFrame({"item": [item], "bw": [bw[item]], "at": [at], "part": [part], "total": [numbers],
                                    "n": [counts[item]]})

    # Read twice for the quartiles and once for the sums: two narrow columns, stored.
    points = materialize(points.select("item", "x"), "density-x")
    with_bw, tasks = few_tasks(points.join(F.broadcast(bandwidths(points).drop("n")), "item"))
    parts = with_bw.mapInPandas(partial, "item string, bw double, at int, part int, total binary, n long")
    rows = spread(tree_sum(parts, ["item", "bw"], tasks), ["item", "bw"], (len(grid),), ["i"], "total")
    x = F.lit(-p.grid_limit) + F.col("i") * F.lit(2 * p.grid_limit / (p.line_points - 1))
    return rows.select("item", (F.col("i") + 1).alias("i"), x.alias("x"), "bw", (F.col("total") / F.col("n")).alias("density"))


def density_1d_binned(points: DataFrame, p: Params, bins: int = 512) -> DataFrame:
    """Density of x per item as `density_1d`, by linear binning and FFT: item, i, x, bw, density.

    Each point gives its two nearest of `bins` places, from 4 bandwidths before the grid to as far behind it, shares by
    nearness; points farther out count in the total only. The shares are added up on Spark, at most `bins` rows
    an item. Their convolution with the kernel is a product of Fourier transforms, padded so that the ends do not
    meet; the grid's values are interpolated between the places. This is what statistics packages do by
    default, and differs from the exact sum by the binning: little where the bandwidth is several places wide.
    """
    grid = np.linspace(-p.grid_limit, p.grid_limit, p.line_points)
    points = materialize(points.select("item", "x"), "density-x")
    low = -p.grid_limit - 4 * F.col("bw")
    step = (2 * p.grid_limit + 8 * F.col("bw")) / (bins - 1)
    placed = points.join(F.broadcast(bandwidths(points)), "item").withColumn("at", (F.col("x") - low) / step)
    left = F.floor("at")
    share = F.col("at") - left
    shares = F.array(F.struct(left.alias("bin"), (1 - share).alias("w")), F.struct((left + 1).alias("bin"), share.alias("w")))
    binned = (placed.select("item", "bw", "n", F.inline(shares)).filter(F.col("bin").between(0, bins - 1))
              .groupBy("item", "bw", "n", "bin").agg(F.sum("w").alias("w")))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        bw, n = rows.bw.iloc[0], rows.n.iloc[0]
        places = np.linspace(-p.grid_limit - 4 * bw, p.grid_limit + 4 * bw, bins)
        mass = np.zeros(2 * bins)
        mass[rows.bin.to_numpy()] = rows.w.to_numpy() / n
        lag = np.minimum(np.arange(2 * bins), 2 * bins - np.arange(2 * bins)) * (places[1] - places[0])
        kernel = np.exp(-0.5 * (lag / bw) ** 2) / (bw * np.sqrt(2 * np.pi))
        smoothed = np.fft.irfft(np.fft.rfft(mass) * np.fft.rfft(kernel), 2 * bins)[:bins]
        return pd.DataFrame({"item": rows.item.iloc[0], "i": np.arange(1, len(grid) + 1), "x": grid, "bw": bw,
                             "density": np.interp(grid, places, np.maximum(smoothed, 0.0))})

    return binned.groupBy("item").applyInPandas(smooth, "item string, i int, x double, bw double, density double")


def density_1d_difference(by_item: DataFrame) -> DataFrame:
    """Right - left on the common grid."""
    def side(item: str):
        return F.max(F.when(F.col("item") == item, F.col("density")))

    return by_item.groupBy("i", "x").agg((side(ITEM_RIGHT) - side(ITEM_LEFT)).alias("density"))
