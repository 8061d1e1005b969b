"""Window operators that stay safe when one key holds a large share of rows.

``next_start`` is ``LEAD(start) OVER (PARTITION BY key ORDER BY start, tie, rest of the row)``
without sorting all rows of a key in one task.  Equal rows are grouped with a
count, and rows are reduced to one per distinct (key, start) with the last row
that has it; both are aggregates, so a busy key is combined map-side, and only
distinct starts are windowed per key.  One copy of the last row of a start takes
the next distinct start; every other row is followed by one of its own start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_start(df: DataFrame, key: str, start: str, tie: str, out: str) -> DataFrame:
    """Add ``out`` = the ``start`` of the row that follows in (start, tie, rest of the row)
    order within ``key``; NULL for the last row of a key.  NULLs sort
    first, like an ascending window order."""
    names = df.columns
    place = F.struct(tie, *[c for c in names if c not in (key, start, tie)])
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    pairs = counted.groupBy(key, start).agg(F.max(place).alias("_last"))
    following = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_first())
    pairs = pairs.select(
        F.col(key).alias("_k"), F.col(start).alias("_s"), "_last",
        F.lead(start).over(following).alias("_next_distinct"),
    )
    joined = counted.join(pairs, counted[key].eqNullSafe(pairs["_k"]) & counted[start].eqNullSafe(pairs["_s"]), "inner")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    last = place.eqNullSafe(F.col("_last")) & (F.col("_copy") == F.col("_copies"))
    return joined.select(*names, F.when(last, F.col("_next_distinct")).otherwise(F.col(start)).alias(out))
