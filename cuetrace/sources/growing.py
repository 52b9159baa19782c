"""A recording table that grows by files: each file is read and written once, a manifest numbers the rows.

The table's folder holds `rows`, one part for each growth (`batch`) and experiment, and `manifest`, which has for every
input split of every file its number of rows and its first row id. A growth writes the rows of the new files, then
appends their entries to the manifest: rows of a batch that the manifest does not name do not count, so a growth that
failed leaves nothing behind and can be repeated. One growth at a time.

Row numbers are not stored. They follow from the manifest when the table is read: experiments follow each other,
inside them files by name, inside them rows as written, as `ingest` of all files would number them. A new file that sorts
before old ones moves their rows' numbers up; no old row is read or written for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuetrace.schema import EXPERIMENT, RECORDING, SEQ
from cuetrace.sources.recordings import FILE_GLOB, read_recordings, recording_table

SPLIT = ["batch", EXPERIMENT, "file_name", "file_start"]
MANIFEST = (f"batch string, {EXPERIMENT} int, file_name string, file_start long, n_rows long, first_row long, "
            "length long, modified timestamp")


class GrowingRecordings:
    """The recording table in `folder`, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row for each split and experiment; a file without rows has one with `file_start` NULL."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def _listed(self, source: str, glob: str) -> DataFrame:
        """Names, lengths and times of the recording files directly in `source`; no file is opened."""
        return (self.spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB)
                .option("recursiveFileLookup", False).load(f"{source.rstrip('/')}/{glob}")
                .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
                        F.col("modificationTime").alias("modified")))

    def grow(self, source: str, glob: str = "*") -> int:
        """Add the recording files in `source` whose names match `glob` and which the table does not have.

        Returns their number. A file of the table whose length or time differs from then fails the growth before
        anything is written; one that is gone from `source` stays in the table.
        """
        manifest = self.manifest()
        known = manifest.groupBy("file_name").agg(F.max("length").alias("old_length"), F.max("modified").alias("old_time"))
        found = self._listed(source, glob).join(known, "file_name", "left")
        news = found.filter(F.col("old_length").isNull() | (F.col("old_length") != F.col("length"))
                            | (F.col("old_time") != F.col("modified"))).orderBy("file_name").collect()  # file names only
        if changed := [r.file_name for r in news if r.old_length is not None]:
            raise ValueError(f"files of the table have changed: {changed[:5]}")
        if not news:
            return 0
        batch = uuid.uuid4().hex
        rows = read_recordings(self.spark, [r.path for r in news])
        rows.write.partitionBy(EXPERIMENT).parquet(f"{self.folder}/rows/batch={batch}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/batch={batch}")
        splits = stored.groupBy(EXPERIMENT, "file_name", "file_start").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("file_row").alias("first_row"))
        files = self.spark.createDataFrame([(r.file_name, r.length, r.modified) for r in news],
                                           "file_name string, length long, modified timestamp")
        entries = files.join(splits, "file_name", "left").select(
            F.lit(batch).alias("batch"), EXPERIMENT, "file_name", "file_start",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_row", "length", "modified")
        entries.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return len(news)

    def rows(self, *, labels: dict[int, int] | None = None) -> DataFrame:
        """The recording table as `ingest` gives it. A filter on `ExpNr` prunes directories, columns are pruned too.

        Only the manifest, a row per split, is summed up in sequence. It meets the rows in a join that the planner
        broadcasts or not by its size.
        """
        splits = self.manifest().filter(F.col("file_start").isNotNull())
        upto = Window.orderBy(EXPERIMENT, "file_name", "file_start").rowsBetween(Window.unboundedPreceding, -1)
        starts = splits.select(*SPLIT, (F.coalesce(F.sum("n_rows").over(upto), F.lit(0)) - F.col("first_row") + 1)
                               .alias("_shift"))
        stored = self.spark.read.schema(
            f"{RECORDING.simpleString()[7:-1].replace(':', ' ')}, {EXPERIMENT} int, file_name string, file_start long, "
            "file_row long, batch string").parquet(f"{self.folder}/rows")
        numbered = stored.join(starts, SPLIT).withColumn(SEQ, F.col("_shift") + F.col("file_row"))
        return recording_table(numbered, labels)
