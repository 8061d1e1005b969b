"""The warehouse: stored silver tables, stored gold dimensions, live fact view and reports.

``Warehouse.build`` runs the silver load into a ``LayerStore`` and then
materialises the two dimensions (their surrogate keys are computed once per
load, never per query).  Facts stay a live view over stored silver sales, reports live views over it.
Bytes per column measured by the loads and key uniqueness drive the join plans:
a dimension is broadcast only when the columns shipped are small enough, and a join is
skipped only when its key is proven unique.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import SOURCE_COLLATION
from strata.operators.joins import MAX_BROADCAST_BYTES, TableSize, fits, lookup
from strata.plans import gold
from strata.plans.jobs import land_bronze_frames, load_bronze, load_silver
from strata.plans.reports import Thresholds
from strata.schemas import AUDIT_COLUMN, BRONZE
from strata.session import checkpoint_dir
from strata.sources.csv_bronze import write_extracts
from strata.sources.standin import standin_bronze
from strata.sources.tables import LayerStore


def _unique(df: DataFrame, key: str) -> bool:
    """True when no value of ``key`` occurs twice (one aggregate job)."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    return dup.count() == 0


class Warehouse:
    def __init__(self, spark: SparkSession, store: LayerStore, as_of: date | str | None = None):
        self.spark = spark
        self.store = store
        self.as_of = as_of
        self.rows: dict[str, int] = {}
        self.bronze_frames: dict[str, DataFrame] | None = None
        self.load_metrics: DataFrame | None = None  # silver load metrics of the last build
        self.thresholds = Thresholds()
        self.products_unique = False
        self.customers_unique = False
        # Largest projected dimension (bytes) looked up by broadcast; above it, queries
        # aggregate fact lines per natural key before joining attributes.
        self.max_broadcast_bytes = MAX_BROADCAST_BYTES
        # Where the customer dimension is too large to broadcast, it and sales are bucketed alike on the
        # customer id (catalog stores only), so the customer lookup is a sort-merge join without a shuffle of the fact.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.sales_bucketed = False
        # Text compares as bytes (leading and trailing blanks count); True reproduces the
        # source's collation, which ignores case and trailing blanks, in checks, joins, grouping and DISTINCT.
        self.source_collation = False

    def layout(self, store: LayerStore) -> dict[str, tuple[int, str]]:
        """Tables of the silver load to bucket: (minimum buckets, column).  Buckets only help a customer
        lookup that is not a broadcast."""
        if store.catalog_prefix is None or fits(store.size("silver", "crm_cust_info"), ["cst_id", "cst_key"], self.max_broadcast_bytes):
            return {}
        return {"crm_sales_details": (self.buckets, "sls_cust_id")}

    # --- construction ----------------------------------------------------------
    @classmethod
    def build(cls, spark: SparkSession, bronze: dict[str, DataFrame] | None = None, store: LayerStore | None = None,
              as_of: date | str | None = None, land_bronze: bool = False, source_collation: bool = False,
              max_broadcast_bytes: int = MAX_BROADCAST_BYTES, thresholds: Thresholds | None = None) -> "Warehouse":
        """Load silver from ``bronze`` frames (optionally landing them as bronze
        tables first) or from the store's bronze tables, then store the gold dimensions.  Without a ``store`` the
        tables go to a fresh folder under the session's checkpoint folder, as
        catalog tables (so the sales table can be bucketed)."""
        if store is None:
            store = cls.fresh_store(spark)
        wh = cls(spark, store, as_of)
        wh.source_collation, wh.max_broadcast_bytes = source_collation, max_broadcast_bytes
        wh.thresholds = thresholds or wh.thresholds
        if land_bronze:
            land_bronze_frames(spark, bronze, store)
            bronze = None
        wh.bronze_frames = bronze
        metrics = load_silver(spark, store, as_of=as_of, bronze=bronze, layout=wh.layout, collation=SOURCE_COLLATION if source_collation else None)
        wh.load_metrics = metrics
        wh.build_gold()
        return wh

    @staticmethod
    def fresh_store(spark: SparkSession) -> LayerStore:
        tag = uuid.uuid4().hex[:8]
        return LayerStore(spark, f"{checkpoint_dir(spark)}/warehouse-{tag}", catalog_prefix=f"strata_{tag}_")

    @classmethod
    def open(cls, spark: SparkSession, store: LayerStore, as_of: date | str | None = None) -> "Warehouse":
        """A warehouse whose layers were loaded earlier (possibly by another
        process): sizes come with the tables; key uniqueness is measured again; the views are registered."""
        wh = cls(spark, store, as_of)
        wh._measure()
        wh.customers_unique = _unique(wh.dim_customers(), "customer_id")
        wh.products_unique = _unique(wh.dim_products(), "product_number")
        wh._views()
        return wh

    @classmethod
    def from_standin(cls, spark: SparkSession, sf_dir: str, as_of: date | str | None = None, **options) -> "Warehouse":
        """Warehouse over the driver tables, on the path the extracts take: the stand-in rows are written as CSV extracts, landed
        as bronze, and loaded from there.  The driver's Parquet files hold a single
        row group each, so a scan is one task; the line items are spread by their join with the orders,
        so the extracts are written in parallel."""
        store = cls.fresh_store(spark)
        landing = f"{store.root}/_landing"
        write_extracts(standin_bronze(spark, sf_dir, spread=True), landing)
        load_bronze(spark, landing, store)
        return cls.build(spark, store=store, as_of=as_of, **options)

    def _measure(self) -> None:
        """Rows as stored; the layout of sales decides the dimension's."""
        self.rows.update({f"{layer}.{name}": self.store.rows(layer, name) for layer, name in self.store.stored if layer != "bronze"})
        made = self.store.generation("silver", "crm_sales_details").buckets
        self.sales_bucketed = made is not None
        if made:
            self.buckets = made[0]

    def size(self, name: str) -> TableSize | None:
        """Measured size of a stored table, e.g. ``gold.dim_customers``."""
        layer, table = name.split(".")
        return self.store.size(layer, table) if (layer, table) in self.store.stored else None

    def _views(self) -> None:
        """The live views, each on those before it."""
        from strata.plans import analytics

        self.store.register_view("gold", "fact_sales", self.fact_sales())
        self.store.register_view("gold", "report_customers", analytics.n6_report_customers(self))
        self.store.register_view("gold", "report_products", analytics.n7_report_products(self))

    def build_gold(self) -> None:
        """Store both dimensions (built as two concurrent Spark jobs) in one commit, check
        their natural keys, register the live views."""
        s = self.silver
        self._measure()

        def customers() -> None:
            cust = gold.build_dim_customers(s("crm_cust_info"), s("erp_cust_az12"), s("erp_loc_a101"))
            # bucket the dimension only if the sales it is joined to were bucketed
            self.store.write("gold", "dim_customers", cust, (self.buckets, "customer_id") if self.sales_bucketed else None)

        def products() -> None:
            prod = gold.build_dim_products(s("crm_prd_info"), s("erp_px_cat_g1v2"), self.size("silver.erp_px_cat_g1v2"))
            self.store.write("gold", "dim_products", prod)

        with ThreadPoolExecutor(max_workers=2) as pool:
            with self.store.batch():
                for done in [pool.submit(customers), pool.submit(products)]:
                    done.result()
            self._measure()
            c, p = (pool.submit(_unique, df, key) for df, key in ((self.dim_customers(), "customer_id"), (self.dim_products(), "product_number")))
            self.customers_unique, self.products_unique = c.result(), p.result()
        self._views()

    # --- layer access --------------------------------------------------------------
    def silver(self, name: str) -> DataFrame:
        return self.store.read("silver", name).drop(AUDIT_COLUMN)

    def bronze(self, name: str) -> DataFrame:
        """Bronze rows: the landed table, or the frames the build started from."""
        if self.bronze_frames is not None:
            return self.bronze_frames[name]
        return self.store.read("bronze", name)

    def dim_customers(self) -> DataFrame:
        return self.store.read("gold", "dim_customers")

    def dim_products(self) -> DataFrame:
        return self.store.read("gold", "dim_products")

    def _sizes(self) -> dict:
        return dict(
            products_unique=self.products_unique, customers_unique=self.customers_unique,
            products_size=self.size("gold.dim_products"), customers_size=self.size("gold.dim_customers"),
            max_broadcast_bytes=self.max_broadcast_bytes,
        )

    def fact_sales(self) -> DataFrame:
        return gold.fact_sales(self.silver("crm_sales_details"), self.dim_products(), self.dim_customers(),
                               **self._sizes())

    def star(self, product=(), customer=(), product_key: bool = False, customer_key: bool = False) -> DataFrame:
        """Fact rows joined to the dimension attributes a query needs (see ``gold.star``)."""
        return gold.star(self.silver("crm_sales_details"), self.dim_products(), self.dim_customers(),
                         product=product, customer=customer, product_key=product_key,
                         customer_key=customer_key, **self._sizes())

    def lines(self, dated: bool = False, fan_out: tuple[str, ...] = ("product", "customer")) -> DataFrame:
        """Fact lines with their natural keys (``dated``: order date present).

        Lines are repeated exactly as often as the fact view repeats them: a
        dimension listed in ``fan_out`` whose natural key is not proven unique
        is looked up (key only) so that a duplicated key duplicates its lines.
        """
        out = gold.lines(self.silver("crm_sales_details"))
        if dated:
            out = out.filter(F.col("order_date").isNotNull())
        if "customer" in fan_out and not self.customers_unique:
            out = lookup(out, self.dim_customers(), "sls_cust_id", "customer_id", ["customer_key"],
                         self.size("gold.dim_customers"), self.max_broadcast_bytes).drop("customer_key")
        if "product" in fan_out and not self.products_unique:
            out = lookup(out, self.dim_products(), "sls_prd_key", "product_number", ["product_key"],
                         self.size("gold.dim_products"), self.max_broadcast_bytes).drop("product_key")
        return out

    def rollup_products(self, attrs, aggs, by=(), dated: bool = False) -> DataFrame:
        """Fact lines aggregated to product attributes (see ``gold.rollup``)."""
        return gold.rollup(self.lines(dated, fan_out=("customer",)), self.dim_products(), "sls_prd_key",
                           "product_number", attrs, aggs, by, self.size("gold.dim_products"),
                           self.max_broadcast_bytes)

    def rollup_customers(self, attrs, aggs, by=(), dated: bool = False) -> DataFrame:
        """Fact lines aggregated to customer attributes (see ``gold.rollup``)."""
        return gold.rollup(self.lines(dated, fan_out=("product",)), self.dim_customers(), "sls_cust_id",
                           "customer_id", attrs, aggs, by, self.size("gold.dim_customers"),
                           self.max_broadcast_bytes)

    def products_broadcast(self) -> bool:
        """True when the product keys are small enough to look up per line."""
        return fits(self.size("gold.dim_products"), ["product_key", "product_number"], self.max_broadcast_bytes)

    def customers_broadcast(self) -> bool:
        """True when the customer keys are small enough to look up per line."""
        return fits(self.size("gold.dim_customers"), ["customer_key", "customer_id"], self.max_broadcast_bytes)

    def distinct_customers(self, out: str, by=(), dated: bool = False) -> DataFrame:
        """Distinct customer keys among fact lines, per ``by`` groups (repeated
        lines add no new pairs, so no fan-out lookup is needed)."""
        return gold.distinct_attribute(self.lines(dated, fan_out=()), self.dim_customers(), "sls_cust_id",
                                       "customer_id", "customer_key", out, by,
                                       self.size("gold.dim_customers"), self.max_broadcast_bytes)
