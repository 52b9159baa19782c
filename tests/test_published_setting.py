"""From recording files to significant times with the published parameters: one row per frame, all checks on."""

import random

import pytest

from cuetrace import Params, Study
from cuetrace.schema import RECORDING
from cuetrace.sources import recordings

STEMS = ["Loco_MEMexperimenttracking", "Real_1_MEMexperimenttracking", "Real_MEMexperimenttracking"]
EFFECT_FROM = 60


def write_files(folder, missing=None):
    """24 subjects per experiment with a trial per item; the head turns to the item from EFFECT_FROM on."""
    draw = random.Random(11)
    for stem in STEMS:
        for subject in range(1, 25):
            lines = [",".join(RECORDING.names)]
            for trial, side in enumerate("LR", start=1):
                for frame in range(-45, 180):
                    if (stem, subject, frame) == missing:
                        continue
                    turn = (0.004 if frame >= EFFECT_FROM else 0.0) * (1 if side == "R" else -1)
                    row = {"SubNr": subject, "block": 1, "trial": trial, "item": f"item {side}", "cueFrame": frame,
                           "headBiasX": turn + draw.gauss(0, 0.002)}
                    lines.append(",".join(str(row.get(name, 0.1)) for name in RECORDING.names))
            (folder / f"{stem}_{subject}.csv").write_text("\n".join(lines) + "\n")


def test_files_to_significant_times(spark, tmp_path):
    write_files(tmp_path)
    rows = recordings.store_recordings(recordings.ingest(spark, str(tmp_path)))
    assert rows.count() == 3 * 24 * 2 * 225
    study = Study(rows, Params())
    summary = {r["cue_frame"]: r for r in study.toward_summary("head_direction").collect()}
    assert sorted(summary) == list(range(-18, 180)) and {r["n"] for r in summary.values()} == {72}
    assert abs(summary[0]["mean"]) < 0.1 and summary[100]["mean"] == pytest.approx(0.4, abs=0.1)
    frames = {round(r["time_ms"] * 90 / 1000) for r in study.significant_times(["head_direction"]).collect()}
    assert set(range(EFFECT_FROM + 4, 175)) <= frames and min(frames) >= EFFECT_FROM - 5
    study.close()


def test_a_missing_frame_fails_the_test_over_time(spark, tmp_path):
    write_files(tmp_path, missing=(STEMS[0], 5, 30))
    rows = recordings.store_recordings(recordings.ingest(spark, str(tmp_path), labels=recordings.POOLED_LABELS))
    assert sorted(r[0] for r in rows.select("ExpNr").distinct().collect()) == [2, 3, 4]
    assert rows.agg({"SubNr": "max"}).first()[0] == 72
    study = Study(rows, Params())
    with pytest.raises(Exception):
        study.significant_times(["head_direction"]).collect()
    study.close()
