"""Advanced analytics (N1-N7): trends, cumulative measures, year over year,
segmentation, part-to-whole, and the two reporting views.

Windows always run on already-aggregated rows (one per year, per product and
year, per category), never on order lines, so no window sorts fact-sized
data.  The global windows of N2 and N5 see one row per year / category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import idiv, month_boundaries, sign_label, trunc_avg
from strata.operators.distinct import count_words, key_words
from strata.operators.joins import lookup
from strata.plans.reports import cost_range_sql, report_customers, report_products, segment


def _dated(wh, **star) -> DataFrame:
    return wh.star(**star).filter(F.col("order_date").isNotNull())


# --- N1 change over time ---------------------------------------------------------
def _by_period(wh, period) -> DataFrame:
    """Sales, distinct buyers and units per period of dated lines, in one pass: lines are summed per period and word of
    64 neighbouring customer keys, whose bits are then counted.  With a customer dimension too large to broadcast the sums
    come straight from the lines and the buyers from distinct (customer id, period) pairs."""
    sums = (F.sum("sales_amount").alias("total_sales"), F.sum("quantity").alias("total_quantity"))
    if wh.customers_broadcast():
        words = key_words(_dated(wh, customer_key=True), period, "customer_key", *sums)
        keys = words.columns[: len(period)]
        return count_words(words, keys, "total_customers", *(F.sum(c).alias(c) for c in ("total_sales", "total_quantity"))).select(
            *keys, "total_sales", "total_customers", "total_quantity")
    totals = wh.lines(dated=True).groupBy(*period).agg(*sums)
    buyers = wh.distinct_customers("total_customers", by=period, dated=True)
    keys = totals.columns[: len(period)]
    return totals.join(buyers, keys, "left").select(*keys, "total_sales", "total_customers", "total_quantity")


def n1a_sales_by_month(wh) -> DataFrame:
    period = [F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month")]
    return _by_period(wh, period).orderBy("order_year", "order_month")


def n1b_sales_by_month_start(wh) -> DataFrame:
    return _by_period(wh, [F.trunc("order_date", "MM").alias("order_date")]).orderBy("order_date")


def n1c_sales_by_month_label(wh) -> DataFrame:
    """Grouped by the text label 'yyyy-MMM'; sorts as text, like the source."""
    return _by_period(wh, [F.date_format("order_date", "yyyy-MMM").alias("order_date")]).orderBy("order_date")


# --- N2 cumulative ------------------------------------------------------------------
def n2_running_totals(wh) -> DataFrame:
    """Yearly sales with a running total and an expanding mean of yearly mean
    prices (integer means, truncated, as the source computes them)."""
    yearly = _dated(wh).groupBy(F.trunc("order_date", "YEAR").alias("order_date")).agg(
        F.sum("sales_amount").alias("total_sales"), trunc_avg("price").alias("avg_price"))
    so_far = Window.orderBy("order_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return yearly.select(
        "order_date", "total_sales",
        F.sum("total_sales").over(so_far).alias("running_total_sales"),
        idiv(F.sum("avg_price").over(so_far), F.count("avg_price").over(so_far)).alias("moving_average_price"),
    )


# --- N3 performance ------------------------------------------------------------------
def n3_yoy_products(wh) -> DataFrame:
    """Yearly sales per product name against the name's own mean and its prior year."""
    yearly = wh.rollup_products(["product_name"], [("current_sales", "sum", "sales_amount")],
                                by=[F.year("order_date").alias("order_year")], dated=True)
    per_name = Window.partitionBy("product_name")
    by_year = Window.partitionBy("product_name").orderBy("order_year")
    avg_sales = idiv(F.sum("current_sales").over(per_name), F.count("current_sales").over(per_name))
    py_sales = F.lag("current_sales").over(by_year)
    out = yearly.select(
        "order_year", "product_name", "current_sales",
        avg_sales.alias("avg_sales"),
        (F.col("current_sales") - avg_sales).alias("diff_avg"),
        py_sales.alias("py_sales"),
        (F.col("current_sales") - py_sales).alias("diff_py"),
    )
    return out.select(
        "order_year", "product_name", "current_sales", "avg_sales", "diff_avg",
        sign_label("diff_avg", "Above Avg", "Below Avg", "Avg").alias("avg_change"),
        "py_sales", "diff_py",
        sign_label("diff_py", "Increase", "Decrease", "No Change").alias("py_change"),
    ).orderBy("product_name", "order_year")


# --- N4 segmentation ---------------------------------------------------------------------
def n4a_cost_ranges(wh) -> DataFrame:
    return (wh.dim_products().select("product_key", F.expr(cost_range_sql("cost", wh.thresholds.cost)).alias("cost_range"))
            .groupBy("cost_range").agg(F.count("product_key").alias("total_products"))
            .orderBy(F.desc("total_products")))


def n4b_customer_segments(wh) -> DataFrame:
    """Customers per lifecycle segment.  All fact rows count (no date filter);
    the group of rows without a customer is kept and counts as 0."""
    per_customer = wh.rollup_customers(
        ["customer_key"],
        [("total_spending", "sum", "sales_amount"), ("first_order", "min", "order_date"),
         ("last_order", "max", "order_date")],
    ).withColumn("lifespan", month_boundaries("first_order", "last_order"))
    seg = segment("lifespan", "total_spending", wh.thresholds.customer)
    return (per_customer.select("customer_key", seg.alias("customer_segment"))
            .groupBy("customer_segment").agg(F.count("customer_key").alias("total_customers"))
            .orderBy(F.desc("total_customers")))


# --- N5 part-to-whole -------------------------------------------------------------------
def n5_category_share(wh) -> DataFrame:
    by_category = wh.rollup_products(["category"], [("total_sales", "sum", "sales_amount")])
    everything = Window.partitionBy()
    overall = F.sum("total_sales").over(everything)
    return by_category.select(
        "category", "total_sales",
        overall.alias("overall_sales"),
        F.round(F.col("total_sales").cast("double") / overall * 100, 2).alias("percentage_of_total"),
    ).orderBy(F.desc("total_sales"))


# --- N6 / N7 reporting views ------------------------------------------------------------
def n6_report_customers(wh) -> DataFrame:
    """G4.  With a product dimension too large to broadcast (and its key
    proven unique), products are not looked up per line but on distinct (customer, product number) pairs;
    customers are, shuffle-free when sales are bucketed."""
    t = wh.thresholds.customer
    if wh.products_broadcast() or not wh.products_unique:
        return report_customers(wh.star(customer_key=True, product_key=True), wh.dim_customers(), wh.as_of, t)
    keyed = lookup(wh.lines(fan_out=()), wh.dim_customers(), "sls_cust_id", "customer_id", ["customer_key"],
                   wh.size("gold.dim_customers"), wh.max_broadcast_bytes)
    return report_customers(keyed, wh.dim_customers(), wh.as_of, t, products=wh.dim_products())


def n7_report_products(wh) -> DataFrame:
    """G5.  Mirror of G4: with a customer dimension too large to broadcast
    (key proven unique), distinct customers come from distinct (product,
    customer id) pairs."""
    t = wh.thresholds.product
    if wh.customers_broadcast() or not wh.customers_unique:
        return report_products(wh.star(product_key=True, customer_key=True), wh.dim_products(), wh.as_of, t)
    keyed = lookup(wh.lines(fan_out=()), wh.dim_products(), "sls_prd_key", "product_number", ["product_key"],
                   wh.size("gold.dim_products"), wh.max_broadcast_bytes)
    return report_products(keyed, wh.dim_products(), wh.as_of, t, customers=wh.dim_customers())
