"""Names and types of the recording table."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of one recording file.
RECORDING = T.StructType([
    T.StructField("SubNr", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("trial", T.IntegerType()),
    T.StructField("item", T.StringType()),
    T.StructField("cueFrame", T.IntegerType()),
    T.StructField("Time", T.DoubleType()),
    T.StructField("eyeX", T.DoubleType()),
    T.StructField("headBiasX", T.DoubleType()),
    T.StructField("headBiasY", T.DoubleType()),
    T.StructField("DisplayHeight", T.DoubleType()),
    T.StructField("headX", T.DoubleType()),
    T.StructField("headRoll", T.DoubleType()),
    T.StructField("headYaw", T.DoubleType()),
    T.StructField("ResponseTime", T.DoubleType()),
    T.StructField("error", T.DoubleType()),
])

# Columns added at ingest.
EXPERIMENT, SEQ, PHASE = "ExpNr", "seq", "phase"
SAME_PHASE, RANDOM_PHASE = "same", "random"

ITEM_LEFT, ITEM_RIGHT = "item L", "item R"

# A trial is identified with its item for exclusion, without it for the baseline.
TRIAL_ITEM = ["SubNr", "item", "block", "trial", PHASE]
TRIAL = ["SubNr", "block", "trial"]

# Factor from recorded unit to reported unit (m -> cm; roll has its sign flipped).
SIGNAL_FACTOR = {
    "headBiasX": 100.0,
    "eyeX": 100.0,
    "headX": 100.0,
    "headRoll": -1.0,
    "headYaw": 1.0,
}

# Result name -> recorded column.
SIGNALS = {
    "head_direction": "headBiasX",
    "gaze": "eyeX",
    "translation": "headX",
    "roll": "headRoll",
    "yaw": "headYaw",
}

MEASURES = ["error", "ResponseTime"]
