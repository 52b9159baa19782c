"""Inputs that used to give silent or no results."""

import pytest
from pyspark.sql import functions as F

from cuetrace.operators.averaging import toward
from cuetrace.operators.inference import jzs_bayes_factor
from cuetrace.schema import PHASE, RECORDING
from cuetrace.sources.recordings import ingest


def write(folder, name, **changes):
    names = RECORDING.names
    row = {n: "1" for n in names} | {"item": "item L"} | changes
    (folder / name).write_text(",".join(names) + "\n" + ",".join(str(row[n]) for n in names) + "\n")


@pytest.mark.parametrize("other", ["AAA_first.csv", "zzz_last.csv"])
def test_unrelated_files_are_not_opened(spark, tmp_path, other):
    write(tmp_path, "Loco_MEMexperimenttracking_1.csv", trial="3.0")
    (tmp_path / other).write_text("a,b\n1,2\n")
    rows = ingest(spark, str(tmp_path)).collect()
    assert [r["trial"] for r in rows] == [3]


@pytest.mark.parametrize("cell", [{"trial": "3.5"}, {"trial": "x"}, {"eyeX": "0.1 m"}, {"SubNr": "25"}])
def test_bad_cells_and_subjects_fail(spark, tmp_path, cell):
    write(tmp_path, "Loco_MEMexperimenttracking_1.csv", **cell)
    with pytest.raises(Exception):
        ingest(spark, str(tmp_path)).collect()


def test_double_cell_fails(spark):
    rows = [(25, 0, "item R", "same", 10.0), (25, 0, "item L", "same", 0.0), (25, 0, "item R", "same", 2.0)]
    table = spark.createDataFrame(rows, f"SubNr int, cueFrame int, item string, {PHASE} string, x double")
    with pytest.raises(Exception, match="several rows"):
        toward(table, ["x"]).collect()


def test_bayes_factor_of_strong_effects(spark):
    frame = spark.createDataFrame([(49.0, 2400.0), (60.0, 1000.0), (2.0, 20.0)], "t double, n double")
    found = [r[0] for r in frame.select(jzs_bayes_factor(F.col("t"), F.col("n"), 0.707)).collect()]
    assert found[0] > 1e200 and found[1] > 1e200 and 0.5 < found[2] < 5
