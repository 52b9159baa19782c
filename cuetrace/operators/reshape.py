"""Long to wide: one row per subject, one column per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuetrace.functions.means import check_all


def frame_column(frame: int) -> str:
    return f"f_m{-frame}" if frame < 0 else f"f_{frame}"


def spread_frames(df: DataFrame, keys: list[str], value: str, frames: list[int]) -> DataFrame:
    """Columns `keys` and one per frame, ascending; a missing cell is NULL, a double one an error."""
    cell = check_all(F.count(F.lit(1)) <= 1, F.first(value), "more than one value per cell")
    wide = df.groupBy(*keys).pivot("cueFrame", frames).agg(cell)
    return wide.toDF(*keys, *[frame_column(f) for f in frames])
