"""Key operators: dense surrogate keys and keep-latest deduplication.

``dense_key`` is ``ROW_NUMBER() OVER (ORDER BY ...)`` without the single
partition a global window needs.  Rows are range-partitioned on the full sort
tuple (Spark samples the boundaries) and sorted, which is the only exchange; a row's number is its
position in its range plus the rows of all earlier ranges.  Ranges and positions are written to
the checkpoint folder first, so the per-range counts and the numbering read
the very same rows even if an executor is lost and stages are recomputed.
The answer does not depend on the boundaries: equal sort tuples always share
a range and ranges are numbered in key order.

``keep_latest`` keeps one row per key -- the one with the greatest ordering
tuple -- as an aggregate, so a key holding a large share of all rows is
reduced map-side before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

_RANGE, _PLACE, _OFFSET, _N = "_range_id", "_range_place", "_range_offset", "_range_rows"
# The low 33 bits of ``monotonically_increasing_id`` count the rows of a partition.
_IN_PARTITION = (1 << 33) - 1


def dense_key(df: DataFrame, order_by: Sequence[Column], key_name: str, ranges: int | None = None,
              expensive_input: bool = False) -> DataFrame:
    """Add ``key_name`` = 1..N in ``order_by`` order (ascending NULLs first by default).

    ``order_by`` should end in a unique column so the numbering is
    deterministic; ties are numbered in an arbitrary but fixed order.
    Range partitioning samples its input in a job of its own before the
    shuffle; with ``expensive_input`` (say, a join of large tables) the input
    is first written to the checkpoint folder so it is computed once.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    if expensive_input:
        df = df.checkpoint(eager=True)
    # one exchange: a row's place is its range and its position in the sorted range
    placed = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).select(
        "*", F.spark_partition_id().alias(_RANGE), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(_PLACE))
    placed = placed.checkpoint(eager=True)

    # One row per range (at most n rows): the prefix sum is tiny, and the
    # broadcast below is bounded by n, not by the data.
    counts = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias(_N))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_RANGE, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFFSET))
    numbered = placed.join(F.broadcast(offsets), _RANGE).withColumn(key_name, (F.col(_OFFSET) + F.col(_PLACE) + 1).cast("long"))
    return numbered.drop(_RANGE, _PLACE, _OFFSET)


def keep_latest(df: DataFrame, key: str, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per ``key``: the row whose (``order_by``..., remaining columns)
    tuple is greatest.  NULLs in an ordering column rank lowest, as a
    descending sort with NULLs last would; later columns break ties so the
    choice is deterministic.
    """
    cols = list(columns or df.columns)
    rest = [c for c in cols if c not in order_by]
    pick = F.max(F.struct(*[F.col(c) for c in list(order_by) + rest])).alias("_latest")
    return df.groupBy(key).agg(pick).select(*[F.col(f"_latest.{c}").alias(c) for c in cols])
