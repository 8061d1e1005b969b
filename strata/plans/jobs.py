"""Load jobs: bronze (land the six extracts) and silver (clean them).

Each job truncates-and-reloads its six tables and returns one metrics row
per table plus one for the batch: ``(layer, table_name, rows, bad_rows, seconds,
status, error, layout)``.  The six tables of a layer are independent, so they are
submitted as concurrent Spark jobs from driver threads; the scheduler
interleaves their stages on the cluster.  A transform is evaluated once: rows, bad rows, column sizes and
key skew are observed by the tasks that write.  All tables of a load become visible in one commit;
a failure is recorded in the metrics and then raised, and readers keep the tables of the last load.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.skew import bucket_count, max_buckets
from strata.plans.silver import transform
from strata.schemas import AUDIT_COLUMN, LOAD_ORDER, SOURCE_FILES
from strata.sources.csv_bronze import CORRUPT, is_bad, read_bronze_csv
from strata.sources.tables import LayerStore

METRICS_SCHEMA = ("layer string, table_name string, rows long, bad_rows long, seconds double, status string, "
                  "error string, layout string")

# Which of the tables just written to store bucketed: table -> (least number of buckets, column).
Layout = Callable[[LayerStore], dict[str, tuple[int, str]]]


class LoadError(RuntimeError):
    def __init__(self, message: str, metrics: list[tuple]):
        super().__init__(message)
        self.metrics = metrics


def _run(spark: SparkSession, layer: str, steps: dict[str, Callable[[], DataFrame]], store: LayerStore,
         parallel: bool, heavy: dict[str, str] | None = None, layout: Layout | None = None,
         no_bad_rows: bool = False) -> DataFrame:
    batch_start = time.time()
    names = [n for n in LOAD_ORDER if n in steps]

    def one(name: str) -> tuple:
        start = time.time()
        try:
            df = steps[name]()
            hidden = [CORRUPT] if CORRUPT in df.columns else []
            made = store.write(layer, name, df, heavy=(heavy or {}).get(name), hidden=hidden, count=is_bad() if hidden else None)
            bad = made.counted if hidden else 0 if no_bad_rows else None
            return (layer, name, made.rows, bad, round(time.time() - start, 3), "ok", None, "plain")
        except Exception as exc:  # recorded, then re-raised below
            return (layer, name, None, None, round(time.time() - start, 3), "failed",
                    f"{type(exc).__name__}: {exc}", "plain")

    def all_tables() -> list[tuple]:
        if not parallel:
            return [one(n) for n in names]
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            return list(pool.map(one, names))

    def bucketed(row: tuple, least: int, column: str) -> tuple:
        """Store a table again in buckets, from the rows just stored, unless a key would overload its bucket."""
        start, name = time.time(), row[1]
        made = store.generation(layer, name)
        n = bucket_count(made.rows, made.heaviest or 0, least, max_buckets(spark))
        if n is None:
            return (*row[:7], f"plain: {column} too skewed to bucket")
        store.write(layer, name, store.read(layer, name), (n, column))
        return (*row[:4], round(row[4] + time.time() - start, 3), *row[5:7], f"bucketed({n}, {column})")

    with store.batch():
        results = all_tables()
        failed = [r for r in results if r[5] != "ok"]
        if layout is not None and not failed:
            wanted = layout(store)
            results = [bucketed(r, *wanted[r[1]]) if r[1] in wanted else r for r in results]
        bad_total = sum(r[3] for r in results if r[3] is not None) if any(r[3] is not None for r in results) else None
        total = (layer, "(batch)", sum(r[2] or 0 for r in results), bad_total, round(time.time() - batch_start, 3),
                 "failed" if failed else "ok", failed[0][6] if failed else None, None)
        metrics = results + [total]
        if failed:  # leaves the batch without a commit
            raise LoadError(f"loading {layer} failed: {failed[0][1]}: {failed[0][6]}", metrics)
    return spark.createDataFrame(metrics, METRICS_SCHEMA)


def load_bronze(spark: SparkSession, source_dir: str, store: LayerStore, on_bad_rows: str = "fail",
                parallel: bool = True) -> DataFrame:
    """S11: land the six CSV extracts found under ``source_dir``.  ``bad_rows``
    is 0 in ``fail`` mode (a bad row fails the table); in ``null`` mode a bad row is stored with NULLs and its
    text, counted in the same parse, and listed by :func:`rejects`."""
    path = lambda n: f"{source_dir.rstrip('/')}/{SOURCE_FILES[n]}"
    keep = on_bad_rows == "null"
    steps = {name: (lambda n=name: read_bronze_csv(spark, path(n), n, on_bad_rows, keep_corrupt=keep)) for name in LOAD_ORDER}
    return _run(spark, "bronze", steps, store, parallel, no_bad_rows=not keep)


def rejects(store: LayerStore, table: str) -> DataFrame:
    """Rows of a bronze table that did not convert, with the text they came from (``null`` mode; else none)."""
    df = store.read("bronze", table, hidden=True)
    return df.filter(is_bad()) if CORRUPT in df.columns else df.withColumn(CORRUPT, F.lit(None).cast("string")).limit(0)


def land_bronze_frames(spark: SparkSession, frames: dict[str, DataFrame], store: LayerStore,
                       parallel: bool = True) -> DataFrame:
    """S11 for frames that already exist as DataFrames."""
    steps = {name: (lambda n=name: frames[n]) for name in frames}
    return _run(spark, "bronze", steps, store, parallel)


def load_silver(spark: SparkSession, store: LayerStore, as_of: date | str | None = None,
                bronze: dict[str, DataFrame] | None = None, parallel: bool = True,
                layout: Layout | None = None, collation: str | None = None) -> DataFrame:
    """S12: the six silver transforms, each stamped with ``dwh_create_date``, the
    time of the load, which is one for all its rows.

    Bronze is read from ``store`` unless frames are passed in.  ``layout``
    names tables to store bucketed once all are written and measured
    (catalog stores only); the metrics' ``layout`` says what was done.  ``collation``: of the text columns.
    """
    stamp = F.lit(datetime.now(timezone.utc)).cast("timestamp")

    def step(name: str) -> DataFrame:
        src = bronze[name] if bronze is not None else store.read("bronze", name)
        return transform(name, src, as_of, collation).withColumn(AUDIT_COLUMN, stamp)

    steps = {name: (lambda n=name: step(n)) for name in LOAD_ORDER}
    heavy = {"crm_sales_details": "sls_cust_id"} if layout is not None else None
    return _run(spark, "silver", steps, store, parallel, heavy, layout)
