"""Spark results against DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]) or df[c].map(lambda x: hasattr(x, "isoformat")).any():
            df[c] = df[c].map(lambda x: None if pd.isna(x) else pd.Timestamp(x).isoformat())
        elif pd.api.types.is_bool_dtype(df[c]) or pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x)
    keys = [c for c in df.columns if not pd.api.types.is_float_dtype(df[c])] + [c for c in df.columns if pd.api.types.is_float_dtype(df[c])]
    return df.sort_values(keys, na_position="last", kind="stable").reset_index(drop=True)


def differences(spark_df, sql, con) -> list[str]:
    a, b = canonical(spark_df.toPandas()), canonical(con.execute(sql).df())
    if list(a.columns) != list(b.columns):
        return [f"columns {list(a.columns)} and {list(b.columns)}"]
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    out = []
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {int(bad.sum())} of {len(a)}, such as {a[c][i]!r} and {b[c][i]!r} in {a.loc[i].to_dict()}")
    return out
