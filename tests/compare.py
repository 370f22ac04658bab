"""A query's Spark result against its DuckDB SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, numbers rounded, in an order of their own."""
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "null"
        if isinstance(x, bool):
            return str(x)
        return repr(round(float(x), 6)) if hasattr(x, "__float__") else str(x)

    ordered = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in ordered.itertuples(index=False))
