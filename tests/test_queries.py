import pytest

import __spark_entry__
from catalog import oracle, queries
from compare import connect, difference

SF = "/root/testdata/sf0.001"

# A cross-section; `python tests/compare.py <folder>` compares every query.
SAMPLE = [
    "ingest_csv", "ingest_growing", "route_experiment", "excl_overall", "summary_se", "sma_stream", "baseline_correct", "block_mean",
    "position_head_direction", "toward_summary_gaze_exp2", "eye_head_overlay", "tested_rows_roll", "perm_f_yaw",
    "cluster_depth_translation", "residual_f_gaze", "cluster_depth_residual_yaw", "sig_times_head_direction", "behaviour_summary", "behaviour_anova", "behaviour_bayes",
    "density_1d", "density_map", "fig_behaviour", "fig_toward_yaw",
]


def test_every_query_has_sql():
    assert set(queries.build()) == set(oracle.build()) and len(queries.build()) > 120


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    ours = queries.build()[name](spark, SF).toPandas()
    assert difference(ours, con.execute(oracle.build()[name]).fetch_df()) is None


def test_entry(spark):
    result = __spark_entry__.entry(spark)
    assert result.columns == ["item", "cue_frame", "n", "mean", "sd", "se", "ci", "time_ms"]
    assert result.count() == 78
