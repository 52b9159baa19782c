"""Small helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cuetrace.workspace import delete_stored, new_path, ship_package


def table(spark, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """`mapInArrow` with a function that yields dicts of columns."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for columns in function(batches):
            yield pa.record_batch([_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder, compressed more than by default, and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    It does so once the driver's objects for them are collected, which can take as long as the
    driver has memory left; the files of many steps would meanwhile fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables of this application whose last reader has ended; other folders are left alone."""
    for df in tables:
        delete_stored(df)
