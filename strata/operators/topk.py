"""Ranking operators: top-k / bottom-k and rank-then-filter.

Both keep only k rows per task before anything is gathered (Spark plans
``ORDER BY .. LIMIT k`` as a take-ordered and a filtered row number as a
window group limit), so the final single task sees at most k rows per input
partition.  Ties are broken by the caller's trailing columns: the source
picks an arbitrary row among ties, which would make results depend on
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """``SELECT TOP k ... ORDER BY order_by``."""
    return df.orderBy(*order_by).limit(k)


def rank_filter(df: DataFrame, order_by: Sequence[Column], k: int, rank_name: str) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order_by) AS rank_name`` kept where ``<= k``."""
    w = Window.orderBy(*order_by)
    ranked = df.withColumn(rank_name, F.row_number().over(w).cast("long"))
    return ranked.filter(F.col(rank_name) <= k)
