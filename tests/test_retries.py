"""Task failures and retries do not change surrogate keys.

Runs in its own process: the session needs task retries (``local[4,4]``),
which the shared test session does not allow.  A test-only Python UDF makes
one input partition fail on its first attempt in every job (sampling,
checkpoint, numbering), as a lost executor would.
"""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent("""
    import sys, tempfile
    sys.path.insert(0, ROOT)
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, Window, functions as F
    from strata.operators.keys import dense_key

    spark = (SparkSession.builder.master("local[4,4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())

    @F.udf("long")
    def flaky(x):
        tc = TaskContext.get()
        if tc.partitionId() == 1 and tc.attemptNumber() == 0:
            raise RuntimeError("task lost")
        return x

    df = spark.range(0, 3000, numPartitions=4).select(flaky("id").alias("v"), (F.col("id") % 7).alias("g"))
    order = [F.col("g"), F.col("v")]
    keyed = dense_key(df, order, "k", ranges=3)
    expected = df.withColumn("e", F.row_number().over(Window.orderBy(*order)))
    bad = keyed.join(expected, ["g", "v"]).filter("k != e").count()
    print("RESULT", keyed.count(), bad)
""").replace("ROOT", repr(ROOT))


def test_dense_keys_survive_task_retries():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=900)
    assert "RESULT 3000 0" in done.stdout, done.stdout[-2000:] + done.stderr[-2000:]
