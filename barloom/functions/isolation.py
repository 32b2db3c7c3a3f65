"""M5: one ticker's fault is a row, not the end of the job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(g: pd.DataFrame) -> None:
    """Raise where a history cannot be computed on: dates that are missing or repeated, closes that are no prices."""
    if g["date"].isna().any():
        raise ValueError("bar without a date")
    if g["date"].duplicated().any():
        raise ValueError(f"two bars on {min(g.loc[g['date'].duplicated(), 'date'])}")
    if not (g["close"] > 0).all():
        raise ValueError(f"{int((~(g['close'] > 0)).sum())} closes that are no prices")


def isolated(f: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], key: str = "ticker") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``f`` for one group, with the column ``error``: null on its rows; where it raises, one row with key and message."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at = g[key].iloc[0]
        try:
            return f(g).reindex(columns=columns).assign(error=None)
        except Exception as e:
            return pd.DataFrame({key: [at]}).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None).assign(error=f"{type(e).__name__}: {e}")

    return run


def per_ticker(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "ticker") -> DataFrame:
    """Apply ``f`` to every group by itself; ``schema`` and ``error``."""
    columns = [c.split()[0] for c in schema.split(", ")]
    return df.groupBy(key).applyInPandas(isolated(f, columns, key), f"{schema}, error string")


def faults(rows: DataFrame, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """The rows of the groups that went well, and (key, error) of the others."""
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull()).select(key, "error")
