"""Publish the warehouse in the session catalog, and list what it holds.

``publish`` creates one schema per layer and registers every stored table
as an external Parquet table over its newest generation, bucket layout included, so SQL users can write
``SELECT ... FROM silver.crm_cust_info``.  The fact and the two reports are persistent SQL views -- stored
queries, recomputed on every read, like the source's views -- created in the order in which they
read each other, from the same definitions that the DataFrame queries use.
Re-publishing after a reload moves each table to its new generation in one step, so it never goes missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.plans.gold import FACT_MEASURES
from strata.plans.reports import customer_report_sql, product_report_sql
from strata.schemas import GOLD, LAYERS
from strata.sources.tables import point_table

# dimension, natural key in silver sales, natural key in the dimension
FACT_LOOKUPS = (
    ("dim_customers", "sls_cust_id", "customer_id"),
    ("dim_products", "sls_prd_key", "product_number"),
)


def fact_sql(silver: str, gold: str) -> str:
    """The fact view: the declared fact columns, from sales and the keys looked up for them."""
    source = {fact: column for column, fact in FACT_MEASURES}
    columns = ", ".join(f"{source.get(f.name, f.name)} AS {f.name}" for f in GOLD["fact_sales"])
    lookups = " ".join(f"LEFT JOIN {gold}.{dim} ON {mine} = {theirs}" for dim, mine, theirs in FACT_LOOKUPS)
    return f"SELECT {columns} FROM {silver}.crm_sales_details {lookups}"


def view_definitions(wh, silver: str, gold: str) -> dict[str, str]:
    """Every view with its text, each after those it reads."""
    named = {"facts": f"{gold}.fact_sales", "customers": f"{gold}.dim_customers", "products": f"{gold}.dim_products"}
    return {
        "fact_sales": fact_sql(silver, gold),
        "report_customers": customer_report_sql(wh.as_of, wh.thresholds.customer).format(**named),
        "report_products": product_report_sql(wh.as_of, wh.thresholds.product).format(**named),
    }


def schema_name(layer: str, prefix: str = "") -> str:
    return f"{prefix}{layer}"


def publish(wh, prefix: str = "") -> None:
    """Register the warehouse's stored tables and its views."""
    spark: SparkSession = wh.spark
    for layer in LAYERS:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema_name(layer, prefix)}")
        for name in wh.store.table_names(layer):
            generation = wh.store.generation(layer, name)
            point_table(spark, f"{schema_name(layer, prefix)}.{name}", wh.store.path(layer, name), wh.store.schema(layer, name), generation.buckets)
    gold = schema_name("gold", prefix)
    for name, text in view_definitions(wh, schema_name("silver", prefix), gold).items():
        spark.sql(f"CREATE OR REPLACE VIEW {gold}.{name} AS {text}")


def objects(spark: SparkSession, prefix: str = "") -> DataFrame:
    """``INFORMATION_SCHEMA.TABLES``: (table_schema, table_name, table_type)."""
    rows = []
    for layer in LAYERS:
        db = schema_name(layer, prefix)
        if spark.catalog.databaseExists(db):
            rows += [(db, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE")
                     for t in spark.catalog.listTables(db) if not t.isTemporary]
    return spark.createDataFrame(sorted(rows), "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, layer: str, prefix: str = "") -> DataFrame:
    """``INFORMATION_SCHEMA.COLUMNS`` of one layer, by table and position."""
    db = schema_name(layer, prefix)
    rows = []
    for t in sorted(spark.catalog.listTables(db), key=lambda t: t.name):
        if t.isTemporary:
            continue
        for i, c in enumerate(spark.catalog.listColumns(t.name, db), start=1):
            rows.append((db, t.name, c.name, i, c.dataType, "YES" if c.nullable else "NO"))
    schema = ("table_schema string, table_name string, column_name string, ordinal_position int, "
              "data_type string, is_nullable string")
    return spark.createDataFrame(rows, schema)
