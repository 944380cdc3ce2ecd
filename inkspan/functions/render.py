"""Text for numbers as C's printf writes it, from the exact binary value; Spark's own rounds the shortest
decimal. For reports: queries keep the numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def fixed(value: Column, places: int) -> Column:
    """printf's %.<places>f; null stays null."""

    @pandas_udf(StringType())
    def make(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{places}f}")

    return make(value.cast("double"))


@pandas_udf(StringType())
def seconds_text(millis: pd.Series) -> pd.Series:
    """Milliseconds as seconds with up to two decimals: .00, or else one 0 at the end, goes."""

    def one(ms):
        if pd.isna(ms):
            return None
        text = f"{int(ms) / 1000:.2f}"
        if text.endswith(".00"):
            return text[:-3]
        return text.removesuffix("0")

    return millis.map(one)


def limits_text(name: str, low: float, high: float, kind: str = "int") -> str:
    """One line of an explorer's configuration; kind: int, or seconds with two decimals below and none above."""
    return f"{name};{low:.2f};{high:2.0f}" if kind == "seconds" else f"{name};{int(low)};{int(high)}"
