import pytest
from pyspark.sql import functions as F

from cuetrace import Params
from cuetrace.operators import averaging, baseline, exclusion
from cuetrace.schema import TRIAL_ITEM

P = Params()


def frames(df):
    return sorted(r.cueFrame for r in df.collect())


def test_windows_are_strict(recording):
    rows = recording(*[{"cueFrame": f, "trial": i, "eyeX": 0.6} for i, f in enumerate(
        [-46, -45, -19, -18, 0, 1, 179, 180])])
    assert frames(exclusion.artefact_rows(rows, P)) == [-45, -19, -18, 0, 1, 179]
    assert frames(rows.filter(baseline.in_analysis(P))) == [-18, 0, 1, 179]
    assert frames(rows.filter(baseline.in_baseline(P))) == [-18, 0]


@pytest.mark.parametrize("column, limit", [("eyeX", 0.5), ("headBiasX", 0.5), ("headRoll", 20.0), ("headYaw", 20.0)])
def test_each_limit_alone(recording, column, limit):
    rows = recording({"trial": 1, column: limit}, {"trial": 2, column: -limit - 0.01},
                     {"trial": 3, column: None}, {"trial": 4, column: limit + 0.01})
    assert sorted(r.trial for r in exclusion.bad_trials(rows, P).collect()) == [2, 4]


def test_null_limit_does_not_hide_another(recording):
    rows = recording({"eyeX": None, "headYaw": 25.0})
    assert exclusion.bad_trials(rows, P).count() == 1


def test_artefact_without_time_does_not_count(recording):
    rows = recording({"trial": 1, "eyeX": 0.9, "Time": None}, {"trial": 2, "eyeX": 0.9})
    assert [r.trial for r in exclusion.bad_trials(rows, P).collect()] == [2]


def test_anti_join_is_full_join_and_null_test(recording):
    rows = recording({"trial": 1, "eyeX": 0.9}, {"trial": 1}, {"trial": 1, "item": "item R"},
                     {"trial": 2}, {"trial": None})
    bad = exclusion.bad_trials(rows, P)
    full = rows.join(bad.withColumn("excl", F.lit(1)), TRIAL_ITEM, "full").filter("excl IS NULL")
    kept = exclusion.clean_rows(rows, bad)
    assert sorted(r.seq for r in kept.collect()) == sorted(r.seq for r in full.collect()) == [3, 4, 5]


def test_report_counts_rows_and_only_subjects_with_a_bad_trial(recording):
    rows = recording({"SubNr": 1, "trial": 1, "eyeX": 0.9}, {"SubNr": 1, "trial": 1}, {"SubNr": 1, "trial": 2},
                     {"SubNr": 2, "trial": 1})
    p = Params(trials_per_subject=2)
    report = exclusion.exclusion_report(rows, p).first()
    assert (report.n_rows, report.n_kept, report.n_subjects_with_bad) == (4, 2, 1)
    assert report.row_excl_pct == 50.0 and report.subj_excl_pct == 50.0
    assert exclusion.exclusion_report(rows, p, include_clean_subjects=True).first().subj_excl_pct == 25.0


def test_one_sided_cell_has_no_contrast(recording):
    rows = recording({"SubNr": 1, "item": "item R", "eyeX": 3.0}, {"SubNr": 1, "item": "item L", "eyeX": 1.0},
                     {"SubNr": 2, "item": "item L"}, {"SubNr": 3, "item": "item R"})
    got = {r.SubNr: (r.phase, r.eyeX) for r in averaging.toward(rows, ["eyeX"]).collect()}
    assert got == {1: ("same", 1.0), 2: (None, None), 3: ("same", None)}
