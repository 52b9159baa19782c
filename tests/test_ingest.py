from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuetrace.operators import numbering, reshape
from cuetrace.schema import RECORDING
from cuetrace.sources import growing, recordings, trace
from cuetrace.workspace import delete_stored, materialize, shared_folder

SF = "/root/testdata/sf0.001"


def write(folder, name, rows, columns=None):
    columns = columns or [*RECORDING.names, "extra"]
    lines = [",".join(columns)] + [",".join(str(row.get(c, 1)) for c in columns) for row in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_files_to_one_table(spark, tmp_path):
    columns = ["extra", *reversed(RECORDING.names)]  # by name, not by position
    write(tmp_path, "Real_MEMexperimenttracking_2.csv", [{"SubNr": 2, "trial": i, "item": "item R"} for i in (3, 1)], columns)
    write(tmp_path, "Loco_MEMexperimenttracking_9.csv", [{"SubNr": 9, "eyeX": "NA", "error": "NaN", "headYaw": -2.5}], columns)
    write(tmp_path, "Real_1_MEMexperimenttracking_1.csv", [{"SubNr": 1}], columns)
    write(tmp_path, "Loco_MEMexperimenttracking_10.csv", [{"SubNr": 10}], columns)
    write(tmp_path, "Practice_1.csv", [{"SubNr": 5}], columns)
    write(tmp_path, "notes.txt", [{"SubNr": 6}], columns)
    (tmp_path / "deeper").mkdir()
    write(tmp_path / "deeper", "Loco_MEMexperimenttracking_11.csv", [{"SubNr": 11}], columns)
    rows = recordings.ingest(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.ExpNr, r.SubNr, r.trial) for r in rows] == [
        (1, 1, 10, 1), (2, 1, 9, 1), (3, 2, 25, 1), (4, 3, 50, 3), (5, 3, 50, 1)]
    nine = rows[1]
    assert nine.eyeX is None and nine.error is None and nine.headYaw == -2.5 and nine.phase == "same"
    assert rows[3].item == "item R"


def test_differing_header_and_missing_column_are_refused(spark, tmp_path):
    write(tmp_path, "Loco_MEMexperimenttracking_1.csv", [{}], ["SubNr", "block"])
    with pytest.raises(ValueError, match="lack the columns"):
        recordings.read_recordings(spark, str(tmp_path))
    other = tmp_path / "two"
    other.mkdir()
    write(other, "Loco_MEMexperimenttracking_1.csv", [{}], RECORDING.names)
    write(other, "Loco_MEMexperimenttracking_2.csv", [{}], list(reversed(RECORDING.names)))
    with pytest.raises(Exception):
        recordings.read_recordings(spark, str(other)).collect()


def test_a_name_with_two_parts_is_loaded_twice(spark):
    names = spark.createDataFrame([("Loco_MEMexperimenttracking_Real_MEMexperimenttracking.csv",), ("x.csv",)], "f string")
    got = recordings.route_experiments(names, "f").collect()
    assert sorted((r.ExpNr, r.offset) for r in got) == [(1, 0), (3, 48)]


@pytest.mark.parametrize("split", ["128m", "20k"])  # whole files; files read in many splits
def test_file_round_trip(spark, split):
    rows = trace.trace_in_order(spark, SF)
    folder = trace.write_recording_files(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back = recordings.ingest(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    columns = [*RECORDING.names, "ExpNr", "seq"]
    assert back.count() == rows.count() == 6000
    assert back.select(columns).exceptAll(rows.select(columns)).count() == 0


def test_numbers_are_dense_and_in_order_for_any_partitioning(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    rows = numbering.number_sorted(df, ["v"], "seq").collect()
    assert len(rows) == 5000 and all(r.seq == r.v + 1 for r in rows)


def test_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id")).alias("v"), "id")
    rows = numbering.number_sorted(df, ["v", "id"]).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 3001))
    assert [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_stored_table_is_pruned_by_experiment(spark):
    rows = trace.trace_in_order(spark, SF).filter("ExpNr = 2").select("eyeX")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ExpNr" in plan and "ReadSchema: struct<eyeX:double>" in plan


def test_spread(spark):
    long = spark.createDataFrame([(1, -1, 0.5), (1, 1, 2.0), (2, 0, 3.0)], "SubNr int, cueFrame int, v double")
    wide = reshape.spread_frames(long, ["SubNr"], "v", [-1, 0, 1]).orderBy("SubNr")
    assert wide.columns == ["SubNr", "f_m1", "f_0", "f_1"]
    assert [tuple(r) for r in wide.collect()] == [(1, 0.5, None, 2.0), (2, None, 3.0, None)]
    with pytest.raises(Exception, match="more than one value per cell"):
        reshape.spread_frames(long.union(long), ["SubNr"], "v", [-1, 0, 1]).collect()


def test_stored_tables_lie_in_the_shared_folder(spark):
    stored = materialize(spark.range(5), "five")
    assert all(shared_folder(spark).split("://")[-1].split(":")[-1] in f for f in stored.inputFiles())


def test_a_stored_table_can_be_deleted(spark):
    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(5), "gone")
    folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
    delete_stored(gone)
    assert not folder.exists() and kept.count() == 5
    delete_stored(spark.range(3))


def test_a_table_grows_by_new_files_only(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "files", growing.GrowingRecordings(spark, str(tmp_path / "table"))
    source.mkdir()
    read = []
    monkeypatch.setattr(growing, "read_recordings", lambda spark, paths: (
        read.append(sorted(p.rsplit("/", 1)[1] for p in paths)), recordings.read_recordings(spark, paths))[1])

    def same_as_one_ingest():
        columns = [*RECORDING.names, "ExpNr", "seq", "phase"]
        want = recordings.ingest(spark, str(source)).select(columns).orderBy("seq").collect()
        assert table.rows().select(columns).orderBy("seq").collect() == want

    write(source, "Real_MEMexperimenttracking_2.csv", [{"SubNr": 2, "trial": i} for i in (3, 1, 2)])
    write(source, "Real_1_MEMexperimenttracking_1.csv", [{"SubNr": 1, "eyeX": "NA"}])
    write(source, "Real_1_MEMexperimenttracking_3.csv", [])
    assert table.grow(str(source)) == 3
    same_as_one_ingest()
    # Sorts before all old files, between two of them, and behind them; one belongs to two experiments.
    write(source, "Loco_MEMexperimenttracking_9.csv", [{"SubNr": 9, "trial": i} for i in range(5)])
    write(source, "Real_MEMexperimenttracking_1.csv", [{"SubNr": 1}] * 2)
    write(source, "Real_MEMexperimenttracking_3.csv", [{"SubNr": 3}])
    write(source, "Loco_MEMexperimenttracking_Real_MEMexperimenttracking_4.csv", [{"SubNr": 4}])
    write(source, "Practice_9.csv", [{"SubNr": 9}])
    assert table.grow(str(source), "Real_*") == 2
    assert table.grow(str(source)) == 2
    same_as_one_ingest()
    assert table.grow(str(source)) == 0
    assert [len(files) for files in read] == [3, 2, 2] and len({f for files in read for f in files}) == 7
    (source / "Loco_MEMexperimenttracking_9.csv").unlink()  # stays in the table
    write(source, "Real_MEMexperimenttracking_2.csv", [{"SubNr": 2}])
    with pytest.raises(ValueError, match="have changed: .'Real_MEMexperimenttracking_2.csv'"):
        table.grow(str(source))
    assert table.rows().filter("ExpNr = 1").count() == 6
    assert table.rows(labels=recordings.POOLED_LABELS).filter("ExpNr = 2").count() == 6


def test_a_failed_growth_leaves_no_rows(spark, tmp_path):
    source, table = tmp_path / "files", growing.GrowingRecordings(spark, str(tmp_path / "table"))
    source.mkdir()
    write(source, "Loco_MEMexperimenttracking_1.csv", [{"SubNr": 1}] * 3)
    table.grow(str(source))
    rows = recordings.read_recordings(spark, str(source))
    rows.write.partitionBy("ExpNr").parquet(str(tmp_path / "table" / "rows" / "batch=lost"))
    assert [r.seq for r in table.rows().orderBy("seq").collect()] == [1, 2, 3]


def test_growing_table_in_splits_is_pruned_and_written_once(spark, tmp_path):
    rows = trace.trace_in_order(spark, SF)
    folder, table = trace.write_recording_files(rows), growing.GrowingRecordings(spark, str(tmp_path / "table"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        table.grow(folder, "Real_*")
        table.grow(folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    columns = [*RECORDING.names, "ExpNr", "seq"]
    back = table.rows()
    assert back.count() == rows.count() == 6000
    assert back.select(columns).exceptAll(rows.select(columns)).count() == 0
    plan = back.filter("ExpNr = 2").select("eyeX", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ExpNr" in plan and "headYaw" not in plan
