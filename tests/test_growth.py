"""What numbering, storing and smoothing move, and in how many tasks, as the rows grow."""

import re

import pytest
from pyspark.sql import functions as F

from cuetrace.operators import numbering, smoothing
from cuetrace.sources import recordings, trace

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stored(monkeypatch):
    """Tables by the name under which `module` stores them."""
    found = {}

    def watch(module):
        store = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, **options: found.setdefault(
            name, store(df, name, **options)))
        return found

    return watch


def test_sort_tasks_grow_with_the_rows(spark, stored, monkeypatch):
    monkeypatch.setattr(numbering, "ROWS_A_TASK", 100)
    tables = stored(numbering)
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    rows = numbering.number_sorted(df, [F.col("v") % 50, "v"]).collect()
    assert {r.seq: r.v for r in rows} == dict(enumerate(sorted(range(5000), key=lambda v: (v % 50, v)), start=1))
    sizes = tables["sorted"].groupBy(F.shiftright("_id", 33)).count().collect()
    assert len(sizes) > 40 and max(r["count"] for r in sizes) < 500


def test_tasks_stay_few_enough_to_be_written_straight(spark):
    rows = [0, 36_000_000, 216_000_000, 400_000_000, 1_000_000_000]
    assert [numbering.tasks_for(spark, n) for n in rows] == [spark.sparkContext.defaultParallelism, 72, 200, 200, 500]


def test_only_what_was_read_is_moved_and_stored_for_numbering(spark, stored, monkeypatch):
    monkeypatch.setattr(trace, "_STORED", {})
    tables = stored(numbering)
    rows = trace.trace_in_order(spark, SF)
    assert set(tables["sorted"].columns) == {*trace.TRACE_INPUT, "_id"}
    order = ["ExpNr", "SubNr", "block", "trial", "cueFrame", "Time"]
    got = [[r[c] for c in order] for r in rows.orderBy("seq").collect()]
    assert len(got) == 6000 and got == sorted(got)


def test_nulls_and_repeated_rows_are_numbered_in_order(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, " \
             "l_extendedprice double, l_discount double, l_tax double"
    raw = [(25, 7, 1, 1, 1.0, 2.0, 0.1, 0.1), (None, 7, 1, 1, 1.0, 2.0, 0.1, 0.1), (1, None, 1, 1, 1.0, 2.0, 0.1, 0.1),
           (1, 7, 1, None, 1.0, 2.0, 0.1, 0.1), (1, 7, 1, 1, 1.0, None, 0.1, 0.1), (1, 7, 1, 1, 1.0, 2.0, 0.1, 0.1),
           (1, 7, 1, 1, 1.0, 2.0, 0.1, 0.1)]
    spark.createDataFrame(raw, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = trace.trace_in_order(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 8))
    # Order key, line, trial, frame, order key, price; NULL before the values.
    assert [(r.Time, r.block, r.cueFrame, r.eyeX is None) for r in rows] == [
        (None, 1, -3, False), (None, None, -3, False), (11.0, 1, None, False), (11.0, 1, -3, True),
        (11.0, 1, -3, False), (11.0, 1, -3, False), (251.0, 1, -3, False)]


@pytest.mark.parametrize("open_files", [8, 2])  # 2: five experiments in a task, so the rest is sorted
def test_recordings_are_stored_without_a_sort(spark, recording, monkeypatch, open_files):
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(option), []
    store = recordings.materialize
    monkeypatch.setattr(recordings, "OPEN_FILES", open_files)
    monkeypatch.setattr(recordings, "materialize", lambda *a, **b: (seen.append(spark.conf.get(option)), store(*a, **b))[1])
    rows = recording(*[{"ExpNr": i % 5, "trial": i} for i in range(200)]).coalesce(1)
    back = recordings.store_recordings(rows)
    assert seen == [str(open_files)] and spark.conf.get(option) == before
    assert {(r.seq, r.ExpNr, r.trial) for r in back.collect()} == {(i + 1, i % 5, i) for i in range(200)}
    assert back.filter("ExpNr = 3").count() == 40
    with pytest.raises(Exception, match="broken"):
        recordings.store_recordings(rows.withColumn("eyeX", F.raise_error(F.lit("broken")).cast("double")))
    assert spark.conf.get(option) == before


@pytest.mark.parametrize("scope", ["stream", "experiment", "trial"])
def test_smoothing_tasks_grow_with_the_chunks(spark, recording, monkeypatch, scope):
    monkeypatch.setattr(numbering, "ROWS_A_TASK", 100)
    rows = recording(*[{"ExpNr": i // 1000, "trial": i // 500, "eyeX": float(i), "headX": -float(i)} for i in range(2000)])
    out = smoothing.moving_average(rows, ["eyeX", "headX"], 4, scope=scope, chunk=50, keep_chunk=True)
    assert out.columns == [*rows.columns, "_chunk"]
    got = out.orderBy("seq").collect()
    new = {"stream": 2000, "experiment": 1000, "trial": 500}[scope]
    assert [r.eyeX for r in got] == [None if i % new < 3 else i - 1.5 for i in range(2000)]
    assert [r.headX for r in got] == [None if i % new < 3 else 1.5 - i for i in range(2000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # 2,000 rows have `seq` 1 .. 2,000, which lie in 41 chunks of 50.
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*_chunk[^\n]*?, (\d+)\)", plan)] == [21]
