"""Top-k per group with a total order.

``row_number() <= k`` over a window lets Spark plan a partial ``WindowGroupLimit``
before the shuffle, so even a group holding a third of all rows sends only k rows
per map partition through the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= k)
