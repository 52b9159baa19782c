"""Run named queries in Spark and their SQL in DuckDB, and compare all values.

    python tests/compare.py /root/testdata/sf0.01 [parts of query names]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from catalog import oracle, queries  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, missing values as None, floats by their digits."""
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    rows = [tuple(repr(float(v)) if isinstance(v, float) else v for v in row)
            for row in df.itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None if equal, else what differs first."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    pairs = [(a, b) for a, b in zip(canonical(spark_rows), canonical(sql_rows)) if a != b]
    return f"{len(pairs)} rows, first {pairs[0]}" if pairs else None


def main(sf_dir: str, *parts: str) -> int:
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle.build()
    bad, begin = 0, time.time()
    for name, query in queries.build().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        ours = query(spark, sf_dir).toPandas()
        middle = time.time()
        if name not in sql:
            print(f"{name}: {len(ours)} rows, no SQL, {middle - start:.2f} s", flush=True)
            continue
        found = difference(ours, con.execute(sql[name]).fetch_df())
        bad += found is not None
        print(f"{'DIFF' if found else 'ok'} {name}: {len(ours)} rows, spark {middle - start:.2f} s, "
              f"sql {time.time() - middle:.2f} s {found or ''}"[:600], flush=True)
    print(f"{bad} differ, {time.time() - begin:.0f} s")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
