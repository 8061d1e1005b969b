"""Exploratory queries (E1-E7): inventory, dimensions, dates, measures,
the KPI report, magnitudes and rankings.

Every function takes a ``Warehouse`` and returns a lazy DataFrame.  Queries
grouped by dimension attributes use ``wh.rollup_products`` /
``wh.rollup_customers`` (aggregate per natural key first when the dimension
is too large to broadcast); others use ``wh.star`` (one lookup per needed
dimension).  Rankings break ties on the grouping columns so the answer does
not depend on partitioning; NULL groups (fact rows that found no dimension
row) are kept, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import as_of_date, full_name, idiv, trunc_avg, year_boundaries
from strata.operators.topk import rank_filter, top_k
from strata.schemas import GOLD
from strata.sources.tables import schema_listing


# --- E1 database inventory (catalog metadata) ----------------------------------
def e1_1_objects(wh) -> DataFrame:
    return wh.store.objects()


def e1_2_gold_columns(wh) -> DataFrame:
    frames = {name: wh.store.read("gold", name) for name in GOLD}
    return schema_listing(wh.spark, frames, "gold")


# --- E2 dimensions ---------------------------------------------------------------
def e2_1_countries(wh) -> DataFrame:
    return wh.dim_customers().select("country").distinct().orderBy("country")


def e2_2_product_hierarchy(wh) -> DataFrame:
    cols = ["category", "subcategory", "product_name"]
    return wh.dim_products().select(*cols).distinct().orderBy(*cols)


# --- E3 dates --------------------------------------------------------------------
def e3_1_order_range(wh) -> DataFrame:
    f = wh.star()
    return f.agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        year_boundaries(F.min("order_date"), F.max("order_date")).alias("years_of_sales_data"),
    )


def e3_2_birthdate_range(wh) -> DataFrame:
    today = as_of_date(wh.as_of)
    c = wh.dim_customers()
    return c.agg(
        F.min("birthdate").alias("oldest_birthdate"),
        year_boundaries(F.min("birthdate"), today).alias("oldest_age"),
        F.max("birthdate").alias("youngest_birthdate"),
        year_boundaries(F.max("birthdate"), today).alias("youngest_age"),
        trunc_avg(year_boundaries("birthdate", today)).alias("avg_age_of_customer"),
    )


def e3_3_oldest_youngest(wh) -> DataFrame:
    """Oldest and youngest customer by name.  The source ranks the whole table
    twice with global windows; ``min_by``/``max_by`` are plain aggregates
    (partial per task, no single-partition sort).  Ties on the birthdate go to
    the lowest customer key."""
    today = as_of_date(wh.as_of)
    c = wh.dim_customers().filter(F.col("birthdate").isNotNull()).select(
        "customer_key", "birthdate",
        full_name("first_name", "last_name").alias("customer_name"),
        year_boundaries("birthdate", today).alias("age"),
    )
    oldest = F.struct(F.col("birthdate"), F.col("customer_key"))
    youngest = F.struct(F.col("birthdate"), -F.col("customer_key"))
    return c.agg(
        F.min_by("customer_name", oldest).alias("oldest_customer_name"),
        F.min("birthdate").alias("oldest_birthdate"),
        F.min_by("age", oldest).alias("oldest_age"),
        F.max_by("customer_name", youngest).alias("youngest_customer_name"),
        F.max("birthdate").alias("youngest_birthdate"),
        F.max_by("age", youngest).alias("youngest_age"),
        trunc_avg("age").alias("avg_age_of_customer"),
    )


# --- E4 measures -----------------------------------------------------------------
def e4_1_totals(wh) -> DataFrame:
    return wh.star().agg(F.sum("quantity").alias("total_quantity"), F.sum("sales_amount").alias("total_sales"))


def e4_2_avg_price(wh) -> DataFrame:
    return wh.star().agg(trunc_avg("price").alias("avg_price"))


def e4_3_order_counts(wh) -> DataFrame:
    return wh.star().agg(
        F.count("order_number").alias("total_entries"),
        F.countDistinct("order_number").alias("total_distinct_orders"),
    )


def e4_4_products(wh) -> DataFrame:
    return wh.dim_products().agg(F.countDistinct("product_key").alias("total_products"))


def e4_5_registered_customers(wh) -> DataFrame:
    return wh.dim_customers().agg(F.countDistinct("customer_key").alias("total_registered_customers"))


def e4_6_active_customers(wh) -> DataFrame:
    return wh.distinct_customers("total_active_customers")


def e4_7_order_averages(wh) -> DataFrame:
    orders = F.countDistinct("order_number")
    return wh.star().agg(
        idiv(F.sum("quantity"), orders).alias("avg_items_per_order"),
        idiv(F.sum("sales_amount"), orders).alias("avg_order_value"),
    )


# --- E5 KPI report -----------------------------------------------------------------
def _stack(df: DataFrame, metrics: list[tuple[str, str]]) -> DataFrame:
    """One aggregate row -> one (metric, value) row per metric."""
    args = ", ".join(f"'{label}', `{col}`" for label, col in metrics)
    return df.selectExpr(f"stack({len(metrics)}, {args}) AS (metric, value)")


def e5_kpi_report(wh) -> DataFrame:
    """Nine headline figures as text.  The source writes nine UNION ALL
    branches, each scanning its table again; here the fact is aggregated
    once (plus one pass for the distinct buyers), each dimension once, and the
    rows are unpivoted with ``stack``."""
    as_text = lambda c: c.cast("string")
    fact = wh.star().agg(
        as_text(F.sum("sales_amount")).alias("revenue"),
        as_text(F.sum("quantity")).alias("units"),
        as_text(trunc_avg("price").cast("decimal(10,2)")).alias("avg_price"),
        as_text(F.min("price")).alias("min_price"),
        as_text(F.max("price")).alias("max_price"),
        as_text(F.countDistinct("order_number")).alias("orders"),
    )
    buyers = wh.distinct_customers("buyers").select(as_text(F.col("buyers")).alias("buyers"))
    products = wh.dim_products().agg(as_text(F.countDistinct("product_key")).alias("products"))
    customers = wh.dim_customers().agg(as_text(F.countDistinct("customer_key")).alias("customers"))
    # The report's metric labels.
    return (
        _stack(fact, [("Total Revenue", "revenue"), ("Total Units Sold", "units"),
                      ("Average Unit Price", "avg_price"), ("Min Unit Price", "min_price"),
                      ("Max Unit Price", "max_price"), ("Total Distinct Orders", "orders")])
        .unionByName(_stack(products, [("Total Products in Catalogue", "products")]))
        .unionByName(_stack(customers, [("Total Registered Customers", "customers")]))
        .unionByName(_stack(buyers, [("Customers Who Placed an Order", "buyers")]))
    )


# --- E6 magnitude --------------------------------------------------------------------
def e6_1_customers_by_country(wh) -> DataFrame:
    return (wh.dim_customers().groupBy("country").agg(F.countDistinct("customer_key").alias("total_customers"))
            .orderBy(F.desc("total_customers")))


def e6_2_customers_by_gender(wh) -> DataFrame:
    return (wh.dim_customers().groupBy("gender").agg(F.countDistinct("customer_key").alias("total_customers"))
            .orderBy(F.desc("total_customers")))


def e6_3_products_by_category(wh) -> DataFrame:
    return (wh.dim_products().groupBy("category").agg(F.countDistinct("product_key").alias("total_products"))
            .orderBy(F.desc("total_products")))


def e6_4_avg_cost_by_category(wh) -> DataFrame:
    return (wh.dim_products().groupBy("category").agg(trunc_avg("cost").alias("avg_cost"))
            .orderBy(F.desc("avg_cost")))


REVENUE = [("total_revenue", "sum", "sales_amount")]


def e6_5_revenue_by_category(wh) -> DataFrame:
    return wh.rollup_products(["category"], REVENUE).orderBy(F.desc("total_revenue"))


def _revenue_by_customer(wh) -> DataFrame:
    agg = wh.rollup_customers(["customer_key", "first_name", "last_name"], REVENUE)
    return agg.select("customer_key", full_name("first_name", "last_name").alias("customer_name"),
                      "total_revenue", "first_name", "last_name")


def e6_6_revenue_by_customer(wh) -> DataFrame:
    return _revenue_by_customer(wh).orderBy(F.desc("total_revenue")).drop("first_name", "last_name")


def e6_7_units_by_country(wh) -> DataFrame:
    return (wh.rollup_customers(["country"], [("total_units_sold", "sum", "quantity")])
            .orderBy(F.desc("total_units_sold")))


# --- E7 ranking ------------------------------------------------------------------------
def e7_1a_top_products(wh, k: int = 5) -> DataFrame:
    cols = ["product_name", "category", "subcategory"]
    agg = wh.rollup_products(cols, REVENUE)
    return top_k(agg, [F.desc_nulls_last("total_revenue")] + [F.asc_nulls_first(c) for c in cols], k)


def e7_1b_top_products_ranked(wh, k: int = 5) -> DataFrame:
    agg = wh.rollup_products(["product_name"], REVENUE)
    return rank_filter(agg, [F.desc_nulls_last("total_revenue"), F.asc_nulls_first("product_name")], k,
                       "revenue_rank")


def e7_2_top_subcategories(wh, k: int = 5) -> DataFrame:
    agg = wh.rollup_products(["subcategory"], REVENUE)
    return top_k(agg, [F.desc_nulls_last("total_revenue"), F.asc_nulls_first("subcategory")], k)


def e7_3_top_customers(wh, k: int = 10) -> DataFrame:
    ranked = top_k(_revenue_by_customer(wh),
                   [F.desc_nulls_last("total_revenue"), F.asc_nulls_first("customer_key"),
                    F.asc_nulls_first("first_name"), F.asc_nulls_first("last_name")], k)
    return ranked.drop("first_name", "last_name")


def e7_4_fewest_orders(wh, k: int = 3) -> DataFrame:
    agg = wh.rollup_customers(["customer_key", "first_name", "last_name"],
                              [("total_orders", "count_distinct", "order_number")])
    ranked = rank_filter(agg, [F.asc_nulls_first("total_orders"), F.asc_nulls_first("customer_key"),
                               F.asc_nulls_first("first_name"), F.asc_nulls_first("last_name")], k,
                         "order_frequency_rank")
    return ranked.select("customer_key", full_name("first_name", "last_name").alias("customer_name"),
                         "total_orders", "order_frequency_rank")


def e7_5_bottom_products(wh, k: int = 5) -> DataFrame:
    cols = ["product_name", "subcategory"]
    agg = wh.rollup_products(cols, REVENUE)
    return top_k(agg, [F.asc_nulls_first("total_revenue")] + [F.asc_nulls_first(c) for c in cols], k)
