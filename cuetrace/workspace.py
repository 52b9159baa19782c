"""The shared folder for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a local session may go without it; it then gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cuetrace-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, as `--py-files` would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='cuetrace-')}/cuetrace", "zip",
                                      package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/cuetrace/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts lineage in a way that survives the loss of executors, and gives the planner
    the true size of the table, so that it broadcasts it only below
    `spark.sql.autoBroadcastJoinThreshold` and sort-merges it beyond.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(df: DataFrame) -> None:
    """Delete a table written by `materialize`; nothing that reads it can run afterwards."""
    spark = df.sparkSession
    own = f"/cuetrace/{spark.sparkContext.applicationId}/"
    for name in {file.split(own)[1].split("/")[0] for file in df.inputFiles() if own in file}:
        _delete(spark, f"{shared_folder(spark)}{own}{name}")


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored in the shared folder."""
    _delete(spark, f"{shared_folder(spark)}/cuetrace/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
