"""The `trace` view: recordings derived from the `lineitem` test table, and as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuetrace.operators.numbering import number_sorted
from cuetrace.schema import EXPERIMENT, PHASE, RECORDING, SAME_PHASE, SEQ
from cuetrace.sources.recordings import ROUTES, store_recordings
from cuetrace.workspace import new_path

# The same text serves both engines; `seq` is added apart, each engine in its own way. Quotients
# are taken of doubles: a decimal literal would make Spark divide big decimals row by row.
TRACE_COLUMNS = """
  CAST(l_orderkey % 24 + 1 AS INT)                                   AS SubNr,
  CAST(floor(CAST(l_orderkey % 24 AS DOUBLE) / 8) AS INT) + 1                    AS ExpNr,
  l_linenumber                                                       AS block,
  CAST(floor(CAST(l_orderkey AS DOUBLE) / 24) % 10 AS INT)                         AS trial,
  CASE WHEN floor(CAST(l_orderkey AS DOUBLE) / 24) % 2 = 0 THEN 'item L' ELSE 'item R' END AS item,
  CAST(l_partkey % 40 AS INT) - 10                                   AS cueFrame,
  CAST(l_orderkey AS DOUBLE) * 10 + l_linenumber                     AS Time,
  (l_extendedprice - 52950.0) / 104000.0                             AS eyeX,
  (l_quantity - 25.5) / 60.0                                         AS headBiasX,
  1.6 + (CAST(l_suppkey % 50 AS DOUBLE) - 25.0) / 100.0              AS headBiasY,
  CAST(1.6 AS DOUBLE)                                                AS DisplayHeight,
  CAST(l_partkey % 101 AS DOUBLE) / 1000.0 - 0.05                    AS headX,
  (l_discount - 0.05) * 200.0                                        AS headRoll,
  (l_tax - 0.04) * 200.0                                             AS headYaw,
  0.5 + CAST(l_orderkey % 97 AS DOUBLE) / 100.0                      AS ResponseTime,
  CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE CAST(l_suppkey % 46 AS DOUBLE) END AS error
"""

TRACE_ORDER = [
    "floor(CAST(l_orderkey % 24 AS DOUBLE) / 8)", "l_orderkey % 24", "l_linenumber",
    "floor(CAST(l_orderkey AS DOUBLE) / 24) % 10", "l_partkey % 40", "l_orderkey", "l_partkey", "l_suppkey",
    "l_extendedprice",
]


# The columns of `lineitem` that the view and its order read; numbering moves these, the view is derived after it.
TRACE_INPUT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
               "l_tax"]


def _columns(text: str) -> list[str]:
    """The select items of `text`, one per line."""
    return [line.strip().rstrip(",") for line in text.strip().splitlines()]


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view without row order, straight over the scan."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.selectExpr(*_columns(TRACE_COLUMNS)).withColumn(PHASE, F.lit(SAME_PHASE))


_STORED: dict[tuple[str, str], DataFrame] = {}


def trace_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with `seq`, numbered and stored once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*TRACE_INPUT)
        rows = number_sorted(lineitem, [F.expr(e) for e in TRACE_ORDER], SEQ)
        _STORED[key] = store_recordings(
            rows.selectExpr(*_columns(TRACE_COLUMNS), f"CAST({SEQ} AS LONG) AS {SEQ}")
            .withColumn(PHASE, F.lit(SAME_PHASE)))
    return _STORED[key]


def write_recording_files(rows: DataFrame, name: str = "files") -> str:
    """Write `rows` as recording CSV files under a new shared folder; return the folder.

    Each task writes part of one experiment; the parts then get recording file names, in
    the order of `seq`. Subject ids lose their experiment's offset, as in real files.
    """
    spark = rows.sparkSession
    folder = new_path(spark, name)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path_of(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    for stem, (exp, offset) in ROUTES.items():
        parts = path_of(f"{folder}_parts_{exp}")
        (rows.filter(F.col(EXPERIMENT) == exp)
         .withColumn("SubNr", F.col("SubNr") - F.lit(offset))
         .orderBy(SEQ).select(*RECORDING.names)
         .write.option("header", True).option("nullValue", "NA").csv(parts.toString()))
        for status in files.listStatus(parts):
            part = status.getPath().getName()
            if part.startswith("part-"):
                number = int(part.split("-")[1])
                if not files.rename(status.getPath(), path_of(target, f"{stem}_{number:09d}.csv")):
                    raise OSError(f"{part} could not be moved to {folder}")
    return folder
