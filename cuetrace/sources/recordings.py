"""Recording files (CSV) to one typed table in file order, and its stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cuetrace.operators.numbering import number_blocks
from cuetrace.schema import EXPERIMENT, PHASE, RECORDING, SAME_PHASE, SEQ
from cuetrace.workspace import materialize

# File-name part -> (experiment, offset that makes its subject ids unique).
ROUTES = {
    "Loco_MEMexperimenttracking": (1, 0),
    "Real_1_MEMexperimenttracking": (2, 24),
    "Real_MEMexperimenttracking": (3, 48),
}

# The listing pattern ".csv" is an unanchored regular expression: any character, then "csv". Files that
# belong to no experiment are not opened, whatever their columns.
FILE_GLOB = f"*{{{','.join(ROUTES)}}}*?csv*"


OPEN_FILES = 8  # of one task, while it writes the table

# How the scripts that pool all experiments number them; option `labels` of `ingest`.
POOLED_LABELS = {1: 2, 2: 3, 3: 4}


def routes(file_name: Column) -> Column:
    """Array of the (experiment, offset) pairs whose name part occurs in `file_name`.

    Each part is tested by itself: a name with none of them gives an empty array, a name
    with two of them two entries.
    """
    return F.array_compact(F.array(*[
        F.when(file_name.rlike(part), F.struct(
            F.lit(exp).alias("experiment"), F.lit(offset).alias("offset")))
        for part, (exp, offset) in ROUTES.items()]))


def route_experiments(df: DataFrame, file_name: str) -> DataFrame:
    """One output row per matching route, with `ExpNr` and `offset`; others are dropped."""
    return (df.withColumn("_route", F.explode(routes(F.col(file_name))))
            .withColumn(EXPERIMENT, F.col("_route.experiment"))
            .withColumn("offset", F.col("_route.offset"))
            .drop("_route"))


def nan_to_null(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def _file_schema(spark: SparkSession, source: str | list[str]) -> T.StructType:
    """Types of the known columns, in the column order of the files (from one header line)."""
    known = {field.name: field for field in RECORDING.fields}
    header = (spark.read.option("pathGlobFilter", FILE_GLOB).option("header", True)
              .csv(source if isinstance(source, str) else source[0]).columns)
    missing = known.keys() - set(header)
    if missing:
        raise ValueError(f"recording files lack the columns {sorted(missing)}")
    # Whole numbers may be written as `3.0`: they are read as doubles, and checked when they become integers.
    return T.StructType([T.StructField(name, _read_type(known[name].dataType) if name in known else T.StringType())
                         for name in header])


def _read_type(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(kind, T.IntegralType) else kind


def _whole(field: T.StructField) -> Column:
    value = F.col(field.name)
    bad = F.raise_error(F.concat(F.lit(f"{field.name} is no whole number: "), value.cast("string")))
    return F.when(value.isNull() | (value == F.floor(value)), value.cast(field.dataType)).otherwise(
        bad.cast(field.dataType)).alias(field.name)


def unique_subject(experiment: Column, subject: Column, offset: Column) -> Column:
    """Subject id plus offset; the job fails if the id reaches the next experiment's range."""
    offsets = sorted(offset for _, offset in ROUTES.values())
    last = {own: after - own for own, after in zip(offsets, offsets[1:])}
    limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])[offset]
    outside = subject > F.coalesce(limit, subject)
    message = F.concat(F.lit("subject "), subject.cast("string"), F.lit(" of experiment "),
                       experiment.cast("string"), F.lit(" would share the id of a subject of another experiment"))
    return F.when(outside, F.raise_error(message).cast("int")).otherwise(subject + offset)


def read_recordings(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """All recording files directly in the folder `source`, or those of the list, as typed rows, NA and NaN as NULL.

    Adds `ExpNr`, the unique `SubNr`, and the file order as (`file_name`, `file_start`, `file_row`).
    A file whose header differs from the others fails the read, as does a cell that does not parse.
    """
    raw = (spark.read.schema(_file_schema(spark, source))
           .option("pathGlobFilter", FILE_GLOB)
           .option("recursiveFileLookup", False)
           .option("header", True).option("enforceSchema", False)
           .option("nullValue", "NA").option("mode", "FAILFAST")
           .csv(source)
           .select(*[_whole(f) if isinstance(f.dataType, T.IntegralType) else f.name for f in RECORDING.fields],
                   F.col("_metadata.file_name").alias("file_name"),
                   F.col("_metadata.file_block_start").alias("file_start"),
                   F.monotonically_increasing_id().alias("file_row")))
    routed = route_experiments(raw, "file_name")
    doubles = [f.name for f in RECORDING.fields if f.dataType == T.DoubleType()]
    return (routed
            .withColumns({c: nan_to_null(c) for c in doubles})
            .withColumn("SubNr", unique_subject(F.col(EXPERIMENT), F.col("SubNr"), F.col("offset")))
            .drop("offset"))


def ingest(spark: SparkSession, folder: str, *, labels: dict[int, int] | None = None) -> DataFrame:
    """Read the files of `folder` once, number their rows in file order, add the phase.

    Experiments follow each other, inside them files by name, inside them rows as written. `labels` gives
    experiments other numbers in the result; subject ids and the order stay.
    """
    staged = materialize(read_recordings(spark, folder), "staged")
    return recording_table(number_blocks(staged, [EXPERIMENT, "file_name", "file_start"], "file_row", SEQ), labels)


def recording_table(numbered: DataFrame, labels: dict[int, int] | None = None) -> DataFrame:
    """The columns of the recording table from numbered rows, with other experiment numbers if asked for."""
    if labels:
        names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        numbered = numbered.withColumn(EXPERIMENT, F.coalesce(names[F.col(EXPERIMENT)], F.col(EXPERIMENT)))
    return numbered.withColumn(PHASE, F.lit(SAME_PHASE)).select(
        *RECORDING.names, EXPERIMENT, SEQ, PHASE)


def append_experiments(parts: dict[int, tuple[DataFrame, int]]) -> DataFrame:
    """Append per-experiment tables by name: `{experiment: (rows, subject offset)}`."""
    tagged = [rows.withColumn(EXPERIMENT, F.lit(exp)).withColumn("SubNr", F.col("SubNr") + F.lit(offset))
              for exp, (rows, offset) in parts.items()]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def store_recordings(rows: DataFrame) -> DataFrame:
    """Store the table by experiment, so that a filter on `ExpNr` prunes directories.

    A task keeps a file open for each of its experiments; else Spark would sort, and spill, all its rows by experiment
    first (as it still does for a task's experiments beyond `OPEN_FILES`).
    """
    conf, option = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(option)
    conf.set(option, OPEN_FILES)
    try:
        return materialize(rows, "recordings", partition_by=[EXPERIMENT])
    finally:
        conf.set(option, before)
