"""Run queries and their DuckDB counterparts side by side: ``python tests/check_oracle.py [sf] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).map(lambda v: "" if pd.isna(v) else repr(v + 0.0))
        else:
            df[c] = df[c].map(lambda v: "" if v is None or pd.isna(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if not bad:
        return None
    rows = (a[bad] != b[bad]).any(axis=1)
    return f"{int(rows.sum())} rows differ in {bad}\n{a[rows].head(3)[bad]}\n{b[rows].head(3)[bad]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    oracle = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"rows {name}: {len(got)} ({took:.1f}s)", flush=True)
                continue
            start = time.time()
            want = con.execute(oracle[name]).df()
            found = differences(got, want)
            print(
                f"{'DIFF' if found else 'ok  '} {name}: {len(got)} rows, spark {took:.1f}s,"
                f" duckdb {time.time() - start:.1f}s {found or ''}",
                flush=True,
            )
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
