"""Compare a Spark result with DuckDB's: names, row count and values in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal_form(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_float_dtype(column):
            column = column.round(6)
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.astype("datetime64[us]")
        if pd.api.types.is_bool_dtype(column):
            column = column.astype(object)
        frame[name] = column.astype(object).where(column.notna(), None).map(
            lambda value: int(value) if isinstance(value, float) and value.is_integer() else value
        )
    as_text = frame.astype(str).agg("|".join, axis=1) if len(frame) else pd.Series(dtype=str)
    return frame.iloc[as_text.argsort().values].reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"rows {len(spark_frame)} / {len(duck_frame)}"
    left, right = normal_form(spark_frame), normal_form(duck_frame)
    for name in left.columns:
        unequal = left[name].astype(str) != right[name].astype(str)
        if unequal.any():
            at = unequal.idxmax()
            return f"{name}: {left.loc[at].to_dict()} / {right.loc[at].to_dict()}"
    return None
