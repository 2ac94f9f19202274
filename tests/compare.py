"""Spark results against the same SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = DATA):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from '{source}'")
    return c


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        made = []
        for v in row:
            if hasattr(v, "tolist"):
                v = v.tolist()
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
                made.append("null")
            else:
                made.append(f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
        out.append(tuple(made))
    return sorted(out)


def same(spark, query, sql: str, folder: str = DATA) -> None:
    ours = query(spark, folder).toPandas()
    theirs = connection(folder).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
