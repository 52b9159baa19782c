import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, functions as F, types as T

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cuetrace.schema import PHASE, RECORDING, SAME_PHASE  # noqa: E402
from cuetrace.workspace import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("cuetrace-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def recording(spark):
    """Recording rows from dicts; columns not given have harmless values."""
    usual = {"SubNr": 1, "block": 1, "trial": 1, "item": "item L", "cueFrame": 0, "Time": 1.0,
             "ResponseTime": 1.0, "error": 10.0, "ExpNr": 1}

    def make(*rows: dict):
        schema = T.StructType([*RECORDING.fields, T.StructField("ExpNr", T.IntegerType()),
                               T.StructField("seq", T.LongType())])
        full = [{**{n: 0.0 for n in RECORDING.names}, **usual, "seq": i, **row}
                for i, row in enumerate(rows, start=1)]

        return spark.createDataFrame([[r[n] for n in schema.names] for r in full], schema).withColumn(
            PHASE, F.lit(SAME_PHASE))

    return make
