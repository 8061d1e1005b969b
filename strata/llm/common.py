"""What the operators share: tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(df: DataFrame) -> None:
    """Delete what :func:`store` wrote, once nothing will read it any more."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Catalyst's size estimate of a frame."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches, max_bytes: int = 4 << 20, text: str = "text"):
    """Arrow batches cut so that the text of each is about ``max_bytes`` at most (one row at least)."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        sizes = pa.compute.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > max_bytes:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += size
        yield b.slice(start, n - start)
