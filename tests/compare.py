"""Runs registered queries beside their SQL and compares the rows.

python tests/compare.py SF_DIR [NAME...]: prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def keyed(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows with the columns by name; null and NaN are None, times are text."""
    df = df[sorted(df.columns)]
    plain = [[None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else str(pd.Timestamp(v)) if hasattr(v, "isoformat")
              else v.item() if hasattr(v, "item") else v for v in row] for row in df.itertuples(index=False)]
    return sorted((tuple(r) for r in plain), key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty where the two hold the same rows."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} against {sorted(sql_rows.columns)}"
    a, b = keyed(spark_rows), keyed(sql_rows)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", "/tmp/w/wh").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    oracle, con, bad = entry.oracle_sql(), connect(sf_dir), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - t
            word = differences(got, con.execute(oracle[name]).df()) if name in oracle else "no SQL"
        except Exception as e:  # a report of every query, whatever fails
            took, word, got = time.time() - t, f"{type(e).__name__}: {str(e)[:400]}", []
        bad += word not in ("", "no SQL")
        print(f"{name:32s} {took:7.2f}s {len(got):8d} rows  {word or 'equal'}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
