"""A Spark result against DuckDB's, as sorted rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return tuple(_value(x) for x in v)
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_value, r)) for r in df[cols].itertuples(index=False)), key=repr)
