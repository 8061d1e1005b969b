"""Layer storage and catalog listings.

Every table is a Parquet folder of its own generation below ``<root>/<layer>/<name>/`` (see ``generations``): a reload
writes beside the old rows and then moves one pointer, so readers see the old table or the new one, whole.
The root must be a folder every executor sees (HDFS, object store, shared mount).  A write measures what it stores --
rows, bytes of every column and, if asked, the rows of a column's heaviest value -- in the same pass
(``DataFrame.observe``).  ``LayerStore`` also answers the catalog questions -- which objects
exist, with which columns -- from the committed tables and the declared views.

With ``catalog_prefix`` every table is also a catalog table
(``<prefix><layer>.<name>``) over its newest generation.  Only catalog tables
keep a bucket layout: a table written with ``bucket_by=(n, column)`` is
hash-clustered into n buckets, and a join or aggregate on that column against
another table bucketed the same way needs no shuffle.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.joins import TableSize
from strata.schemas import LAYERS
from strata.sources.generations import Generation, Manifests

# Values tracked by the sketch of a column's heaviest value: counts are exact up to that many values
# per task and merge, and never too low beyond.
SKETCH_ITEMS = 10_000

# Every table is written once a load and read by many queries, so its files take the stronger codec.
CODEC = "zstd"


def _spark_type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def _value_bytes(field: T.StructField):
    """Bytes of a column's values: their text, or the type's width."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(f"`{field.name}`").cast("long")), F.lit(0))
    width = {"int": 4, "date": 4, "boolean": 1, "smallint": 2, "tinyint": 1, "float": 4}.get(field.dataType.simpleString(), 8)
    return F.count(F.lit(1)) * width


def point_table(spark: SparkSession, qualified: str, path: str, schema: T.StructType, buckets: tuple[int, str] | None) -> None:
    """Make ``qualified`` an external table over ``path``.  A table of the same columns and layout is moved in one step,
    so it never goes missing; otherwise it is made anew."""
    if spark.catalog.tableExists(qualified):
        extended = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {qualified}").collect()}
        layout = (int(extended["Num Buckets"]), extended["Bucket Columns"].strip("[]`")) if "Num Buckets" in extended else None
        here = [(f.name, f.dataType) for f in spark.table(qualified).schema.fields]
        if layout == buckets and here == [(f.name, f.dataType) for f in schema.fields]:
            spark.sql(f"ALTER TABLE {qualified} SET LOCATION '{path}'")
            spark.catalog.refreshTable(qualified)
            return
        spark.sql(f"DROP TABLE {qualified}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    clustered = f"CLUSTERED BY (`{buckets[1]}`) SORTED BY (`{buckets[1]}`) INTO {buckets[0]} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE {qualified} ({columns}) USING parquet {clustered} LOCATION '{path}'")


class LayerStore:
    def __init__(self, spark: SparkSession, root: str, catalog_prefix: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog_prefix = catalog_prefix
        self.views: dict[tuple[str, str], DataFrame] = {}
        self.manifests = Manifests(spark, self.root)
        self._staged: dict[tuple[str, str], Generation] = {}
        self._batches = 0
        self._lock = threading.RLock()

    # --- writing ------------------------------------------------------------------
    def write(self, layer: str, name: str, df: DataFrame, bucket_by: tuple[int, str] | None = None,
              heavy: str | None = None, hidden: Sequence[str] = (), count: Column | None = None) -> Generation:
        """Replace the table's contents (the source's TRUNCATE + INSERT): at once, or with the
        others of the :meth:`batch` it is part of.  ``heavy``: a column whose heaviest value is estimated;
        ``hidden``: columns kept in the files but not among the table's; ``count``: a condition to count."""
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        if bucket_by is not None and self.catalog_prefix is None:
            raise ValueError("bucketed tables need a catalog_prefix")
        folder = self.manifests.new_folder(layer, name)
        path = f"{self.root}/{folder}"
        if bucket_by is not None:
            # Without this each task would write one file per bucket it
            # holds (tasks x buckets files); hash-partitioning on the
            # bucket column (the same hash) first gives one file per bucket.
            df = df.repartition(bucket_by[0], bucket_by[1])
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        measures = [F.count(F.lit(1)).alias("rows"), *[_value_bytes(f).alias(f"bytes of {f.name}") for f in schema.fields]]
        if heavy:
            measures += [F.expr(f"approx_top_k(`{heavy}`, 1, {SKETCH_ITEMS})").alias("top"), F.count(F.when(F.col(heavy).isNull(), 1)).alias("unknown")]
        if count is not None:
            measures.append(F.count(F.when(count, 1)).alias("counted"))
        seen = Observation()
        # measured in the stage that writes, whose tasks count once
        out = df.observe(seen, *measures).write.format("parquet").option("compression", CODEC).option("path", path)
        if bucket_by is None:
            out.mode("error").save()
        else:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.catalog_prefix}{layer}")
            staging = f"{self.catalog_prefix}{layer}.{name}_{folder[-16:]}"
            out.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1]).saveAsTable(staging)
            self.spark.sql(f"DROP TABLE {staging}")  # external: the files stay
        found = self._observed(seen) or self.spark.read.schema(schema).parquet(path).agg(*measures).first().asDict()
        heaviest = max([found["unknown"], *[t["count"] for t in found["top"] or []]]) if heavy else None
        made = Generation(folder, schema.json(), found["rows"], {f.name: found[f"bytes of {f.name}"] for f in schema.fields}, bucket_by, heaviest,
                          found.get("counted"), list(hidden))
        with self._lock:
            self._staged[(layer, name)] = made
            if not self._batches:
                self._commit()
        return made

    @staticmethod
    def _observed(seen: Observation) -> dict | None:
        """The measures of a finished write, which reach the driver a moment later; None where Spark has dropped the
        measuring step, as it does for rows it knows to be none (they are then counted in the stored table)."""
        until = time.monotonic() + 2
        while time.monotonic() < until:
            if seen._jo.future().isCompleted():
                return seen.get
            time.sleep(0.01)
        return None

    @contextmanager
    def batch(self):
        """Writes inside become visible together, or, after an error, not at all."""
        with self._lock:
            self._batches += 1
        try:
            yield self
        except BaseException:
            with self._lock:
                self._batches -= 1
                self._staged.clear()
            raise
        with self._lock:
            self._batches -= 1
            if not self._batches:
                self._commit()

    def _commit(self) -> None:
        changed, self._staged = self._staged, {}
        if not changed:
            return
        self.manifests.commit(changed)
        if self.catalog_prefix is not None:
            for (layer, name), g in changed.items():
                self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.catalog_prefix}{layer}")
                point_table(self.spark, self.table(layer, name), f"{self.root}/{g.folder}", self.schema(layer, name), g.buckets)

    def clean(self, keep: int = 2, grace_seconds: float = 86_400) -> list[str]:
        """Remove generations that neither the last ``keep`` commits nor a running load name (see ``Manifests.clean``)."""
        with self._lock:
            return self.manifests.clean(keep, grace_seconds, {g.folder for g in self._staged.values()})

    def refresh(self) -> None:
        """Read what other writers have committed since this store was opened."""
        self.manifests.refresh()

    # --- reading --------------------------------------------------------------------
    @property
    def stored(self) -> set[tuple[str, str]]:
        return set(self.manifests.tables)

    def generation(self, layer: str, name: str) -> Generation:
        with self._lock:
            found = self._staged.get((layer, name)) or self.manifests.tables.get((layer, name))
        if found is None:
            raise KeyError(f"{layer}.{name} has not been written to {self.root}")
        return found

    def table(self, layer: str, name: str) -> str:
        """Catalog name of a stored table (catalog mode only)."""
        return f"{self.catalog_prefix}{layer}.{name}"

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{self.generation(layer, name).folder}"

    def read(self, layer: str, name: str, hidden: bool = False) -> DataFrame:
        if (layer, name) in self.views:
            return self.views[(layer, name)]
        g = self.generation(layer, name)
        if g.buckets and self.manifests.tables.get((layer, name)) == g:
            return self.spark.table(self.table(layer, name))
        return self.spark.read.schema(self.schema(layer, name, hidden)).parquet(f"{self.root}/{g.folder}")

    def schema(self, layer: str, name: str, hidden: bool = False) -> T.StructType:
        g = self.generation(layer, name)
        fields = T.StructType.fromJson(json.loads(g.schema)).fields
        return T.StructType([f for f in fields if hidden or f.name not in g.hidden])

    def register_view(self, layer: str, name: str, df: DataFrame) -> None:
        """A live view: a stored query, recomputed on every read."""
        self.views[(layer, name)] = df

    def rows(self, layer: str, name: str) -> int:
        """Rows, as measured by the write."""
        return self.generation(layer, name).rows

    def size(self, layer: str, name: str) -> TableSize:
        g = self.generation(layer, name)
        return TableSize(g.rows, g.column_bytes)

    def table_names(self, layer: str) -> list[str]:
        """Tables written through this store (paths may be on any Hadoop file system)."""
        return sorted(n for (lay, n) in self.stored if lay == layer)

    # --- catalog (object and column listings) ---------------------------------
    def objects(self) -> DataFrame:
        """One row per table or view: (table_schema, table_name, table_type)."""
        rows = []
        for layer in LAYERS:
            rows += [(layer, n, "BASE TABLE") for n in self.table_names(layer) if (layer, n) not in self.views]
        rows += [(layer, n, "VIEW") for (layer, n) in self.views]
        schema = "table_schema string, table_name string, table_type string"
        return self.spark.createDataFrame(sorted(rows), schema)

    def columns(self, layer: str | None = None) -> DataFrame:
        """Column listing by position: (table_schema, table_name, column_name,
        ordinal_position, data_type, is_nullable)."""
        rows = []
        objs = [(l, n) for l in LAYERS for n in self.table_names(l)] + list(self.views)
        for lay, name in sorted(set(objs)):
            if layer is not None and lay != layer:
                continue
            for i, f in enumerate(self.read(lay, name).schema.fields, start=1):
                rows.append((lay, name, f.name, i, _spark_type_name(f.dataType), "YES" if f.nullable else "NO"))
        schema = ("table_schema string, table_name string, column_name string, ordinal_position int, "
                  "data_type string, is_nullable string")
        return self.spark.createDataFrame(rows, schema).orderBy("table_name", "ordinal_position")


def schema_listing(spark: SparkSession, frames: dict[str, DataFrame], layer: str) -> DataFrame:
    """Column listing for frames that are not stored (e.g. lazy gold views)."""
    rows = [
        (layer, name, f.name, i, _spark_type_name(f.dataType), "YES" if f.nullable else "NO")
        for name, df in sorted(frames.items())
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    schema = ("table_schema string, table_name string, column_name string, ordinal_position int, "
              "data_type string, is_nullable string")
    return spark.createDataFrame(rows, schema)


def row_counts(frames: dict[str, DataFrame], layer: str, label: str = "table_name") -> DataFrame:
    """``SELECT 'layer.t' AS table_name, COUNT(*) AS row_count FROM t UNION ALL ...``"""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(f"{layer}.{name}").alias(label), "row_count")
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
