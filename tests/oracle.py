"""Compare a query with its SQL in DuckDB, order aside."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


def rows(frame: pd.DataFrame) -> list[str]:
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x
    return sorted(repr([number(plain(x)) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def run_sql(sql: str, sf_dir: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.execute(sql).df()


def same(df, sql: str, sf_dir: str = DATA) -> None:
    ours, theirs = df.toPandas(), run_sql(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
