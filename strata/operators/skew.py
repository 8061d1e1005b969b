"""Key-skew measurement.

A layout that pins every row of a key to one place -- a bucket, a window
partition -- is only safe when no key is too heavy.  ``heaviest_key`` finds
the largest key group with one aggregate (partial counts per task, then one
row per key), so only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def heaviest_key(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows of the largest ``key`` group, total rows); NULL keys form one group."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    row = per_key.agg(F.max("n").alias("hottest"), F.sum("n").alias("total")).first()
    return int(row.hottest or 0), int(row.total or 0)


# A bucketed scan reads each bucket in one task: keep buckets near this size.
ROWS_PER_BUCKET = 5_000_000


def bucket_count(rows: int, heaviest: int, min_buckets: int, max_buckets: int, rows_per_bucket: int = ROWS_PER_BUCKET,
                 max_share: float = 4.0) -> int | None:
    """Buckets for a table of ``rows`` rows: enough that each holds about
    ``rows_per_bucket`` (at least ``min_buckets``, at most the session's ``max_buckets``), or None when the
    heaviest key would hold more than ``max_share`` average buckets."""
    n = min(max(min_buckets, -(-rows // rows_per_bucket)), max_buckets)
    if rows and heaviest * n > max_share * rows:
        return None
    return n


def max_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
