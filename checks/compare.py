"""Run registered queries in Spark and their SQL in DuckDB and compare every value.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con.sql(sql).df()


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs first, or None. Row order does not matter."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)

    def canonical(df: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool)
                                          else v for v in df[c]], dtype=object) for c in cols})
        return out.iloc[sorted(range(len(out)), key=lambda i: tuple(str(v) for v in out.iloc[i]))].reset_index(drop=True)

    a, b = canonical(got), canonical(want)
    unequal = [(i, c) for c in cols for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (x is None and y is None)]
    if unequal:
        i, c = unequal[0]
        return f"{len(unequal)} values, first {c}: {a[c][i]!r} != {b[c][i]!r} in {a.iloc[i].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import oracle as sqls
    from .registry import QUERIES

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            mid = time.time()
            problem = difference(got, oracle(sf_dir, sqls.SQL[name])) if name in sqls.SQL else "no sql"
        except Exception as exc:  # report and go on with the next query
            got, mid, problem = [], time.time(), f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem not in (None, "no sql")
        print(f"{name:24s} rows {len(got):7d} spark {mid - start:6.2f}s sql {time.time() - mid:5.2f}s {problem or 'equal'}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
