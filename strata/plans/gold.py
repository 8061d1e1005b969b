"""Gold star schema: two dimensions and one fact.

``build_dim_customers`` / ``build_dim_products`` return the dimension rows
with their dense surrogate key; the warehouse stores them once per load so a
query never recomputes the numbering.  ``fact_sales`` is a live view: silver
sales with the two surrogate keys looked up by natural key.

``star`` is the query-side form of the fact view: it looks each dimension up
by natural key once and carries the requested attributes along, which gives
the same rows as ``fact_sales LEFT JOIN dim ON surrogate key`` (a fact row's
surrogate key identifies exactly the dimension row it was looked up from)
with one join per dimension instead of two.  A dimension nobody asked for is
not joined at all, but only when its natural key is proven unique, since a
duplicated key would multiply fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.joins import MAX_BROADCAST_BYTES, TableSize, fits, lookup
from strata.operators.distinct import distinct_keys
from strata.operators.keys import dense_key
from strata.schemas import GOLD, collated, conform

UNKNOWN = "n/a"


def _conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns; text keeps the collation it came with."""
    collations = {f.dataType.collation for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - {"UTF8_BINARY"}
    return conform(df, collated(GOLD[name], min(collations, default=None)))


def dim_customers_rows(customers: DataFrame, erp_customers: DataFrame, locations: DataFrame) -> DataFrame:
    """G1 without the key: CRM customers enriched from the two ERP tables.

    CRM gender is trusted; the ERP value is the fallback, then 'n/a'.
    """
    ci = customers.alias("ci")
    ca = erp_customers.alias("ca")
    la = locations.alias("la")
    joined = ci.join(ca, F.col("ci.cst_key") == F.col("ca.cid"), "left").join(
        la, F.col("ci.cst_key") == F.col("la.cid"), "left"
    )
    gender = F.when(F.col("ci.cst_gndr") != UNKNOWN, F.col("ci.cst_gndr")).otherwise(
        F.coalesce(F.col("ca.gen"), F.lit(UNKNOWN))
    )
    return joined.select(
        F.col("ci.cst_id").alias("customer_id"),
        F.col("ci.cst_key").alias("customer_number"),
        F.col("ci.cst_firstname").alias("first_name"),
        F.col("ci.cst_lastname").alias("last_name"),
        F.col("la.cntry").alias("country"),
        F.col("ci.cst_marital_status").alias("marital_status"),
        gender.alias("gender"),
        F.col("ca.bdate").alias("birthdate"),
        F.col("ci.cst_create_date").alias("create_date"),
    )


# Surrogate key order; trailing columns only order rows that the source
# would number arbitrarily (a customer repeated by a duplicated ERP key).
CUSTOMER_KEY_ORDER = ("customer_id", "country", "birthdate", "gender")
PRODUCT_KEY_ORDER = ("start_date", "product_number", "product_id")


def build_dim_customers(customers: DataFrame, erp_customers: DataFrame, locations: DataFrame) -> DataFrame:
    rows = dim_customers_rows(customers, erp_customers, locations)
    # three customer-sized tables joined: computed once, not again for sampling
    keyed = dense_key(rows, [F.col(c).asc_nulls_first() for c in CUSTOMER_KEY_ORDER], "customer_key",
                      expensive_input=True)
    return _conform(keyed, "dim_customers")


def dim_products_rows(products: DataFrame, categories: DataFrame, categories_size: TableSize | None = None) -> DataFrame:
    """G2 without the key: current product versions with their category."""
    current = products.filter(F.col("prd_end_dt").isNull())
    enriched = lookup(current, categories, "cat_id", "id", ["cat", "subcat", "maintenance"], categories_size)
    return enriched.select(
        F.col("prd_id").alias("product_id"),
        F.col("prd_key").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.col("cat_id").alias("category_id"),
        F.col("cat").alias("category"),
        F.col("subcat").alias("subcategory"),
        F.col("maintenance"),
        F.col("prd_cost").alias("cost"),
        F.col("prd_line").alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )


def build_dim_products(products: DataFrame, categories: DataFrame, categories_size: TableSize | None = None) -> DataFrame:
    rows = dim_products_rows(products, categories, categories_size)
    keyed = dense_key(rows, [F.col(c).asc_nulls_first() for c in PRODUCT_KEY_ORDER], "product_key")
    return _conform(keyed, "dim_products")


# silver sales column -> fact column
FACT_MEASURES = (
    ("sls_ord_num", "order_number"),
    ("sls_order_dt", "order_date"),
    ("sls_ship_dt", "shipping_date"),
    ("sls_due_dt", "due_date"),
    ("sls_sales", "sales_amount"),
    ("sls_quantity", "quantity"),
    ("sls_price", "price"),
)


def lines(sales: DataFrame) -> DataFrame:
    """Fact lines under their fact names, still carrying the natural keys."""
    return sales.select("sls_prd_key", "sls_cust_id", *[F.col(a).alias(b) for a, b in FACT_MEASURES])


def star(sales: DataFrame, dim_products: DataFrame, dim_customers: DataFrame, *,
         product: Sequence[str] = (), customer: Sequence[str] = (),
         product_key: bool = False, customer_key: bool = False,
         products_unique: bool = False, customers_unique: bool = False,
         products_size: TableSize | None = None, customers_size: TableSize | None = None,
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Fact rows with the requested surrogate keys and dimension attributes."""
    fact = lines(sales)
    # Customers first: when sales and customers are bucketed alike on the
    # customer id, that join runs in place before anything reshuffles the fact.
    if customer or customer_key or not customers_unique:
        take = ["customer_key", *[c for c in customer if c != "customer_key"]]
        fact = lookup(fact, dim_customers, "sls_cust_id", "customer_id", take, customers_size, max_broadcast_bytes)
    if product or product_key or not products_unique:
        take = ["product_key", *[c for c in product if c != "product_key"]]
        fact = lookup(fact, dim_products, "sls_prd_key", "product_number", take, products_size, max_broadcast_bytes)
    return fact.drop("sls_prd_key", "sls_cust_id")


# How a partial result of each mergeable aggregate is merged again.
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def rollup(fact_lines: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, attrs: Sequence[str],
           aggs: Sequence[tuple[str, str, str]], by: Sequence = (), dim_size: TableSize | None = None,
           max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Aggregate fact lines to (``by``..., dimension ``attrs``...).

    ``aggs`` are (output, function, fact column) with function sum, min or
    max, or a single (output, "count_distinct", column); ``by`` are extra
    grouping columns of the fact line.  A dimension small enough to broadcast is looked up on every line and aggregated once.
    A larger one is not joined to lines at all: the lines are aggregated per
    natural key first (combined map-side, one row per key and group), the
    attributes are looked up on those rows, and the partial results merged --
    the big join then moves one row per key instead of one per line.  Both
    give the rows of ``fact LEFT JOIN dim`` grouped by the attributes, a
    duplicated dimension key included (each copy receives the key's totals).
    """
    by_cols = [F.col(b) if isinstance(b, str) else b for b in by]
    by_names = [fact_lines.select(c).columns[0] for c in by_cols]
    if len(aggs) == 1 and aggs[0][1] == "count_distinct":
        return _rollup_distinct(fact_lines, dim, fact_key, dim_key, attrs, aggs[0], by_cols, by_names,
                                dim_size, max_broadcast_bytes)
    if fits(dim_size, [dim_key, *attrs], max_broadcast_bytes):
        looked = lookup(fact_lines, dim, fact_key, dim_key, attrs, dim_size, max_broadcast_bytes)
        return looked.groupBy(*by_cols, *attrs).agg(*[_MERGE[fn](c).alias(out) for out, fn, c in aggs])
    partial = fact_lines.groupBy(fact_key, *by_cols).agg(*[_MERGE[fn](c).alias(out) for out, fn, c in aggs])
    looked = lookup(partial, dim, fact_key, dim_key, attrs, dim_size, max_broadcast_bytes)
    return looked.groupBy(*by_names, *attrs).agg(*[_MERGE[fn](out).alias(out) for out, fn, _ in aggs])


def fact_sales(sales: DataFrame, dim_products: DataFrame, dim_customers: DataFrame, **sizes) -> DataFrame:
    """G3: the fact view, one row per order line (more if a key is duplicated)."""
    f = star(sales, dim_products, dim_customers, product_key=True, customer_key=True, **sizes)
    return _conform(f, "fact_sales")


def _rollup_distinct(fact_lines, dim, fact_key, dim_key, attrs, agg, by_cols, by_names, dim_size,
                     max_broadcast_bytes) -> DataFrame:
    """``COUNT(DISTINCT col)`` per attributes.  For a large dimension the lines
    are first reduced to distinct (natural key, col) pairs; the count stays
    distinct because keys that share an attribute group (e.g. all unmatched
    keys) may share values."""
    out, _, col = agg
    if fits(dim_size, [dim_key, *attrs], max_broadcast_bytes):
        looked = lookup(fact_lines, dim, fact_key, dim_key, attrs, dim_size, max_broadcast_bytes)
        return looked.groupBy(*by_cols, *attrs).agg(F.countDistinct(col).alias(out))
    pairs = fact_lines.select(fact_key, *by_cols, col).distinct()
    looked = lookup(pairs, dim, fact_key, dim_key, attrs, dim_size, max_broadcast_bytes)
    return looked.groupBy(*by_names, *attrs).agg(F.countDistinct(col).alias(out))


def distinct_attribute(fact_lines: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, attr: str, out: str,
                       by: Sequence = (), dim_size: TableSize | None = None,
                       max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``COUNT(DISTINCT dim.attr)`` over ``fact LEFT JOIN dim``, grouped by fact
    columns ``by`` (e.g. buyers per month), for an integer key ``attr``: sets are bitmap words
    (``operators.distinct``).  For a large dimension only the
    distinct (natural key, group) pairs are looked up, not every line."""
    by_cols = [F.col(b) if isinstance(b, str) else b for b in by]
    if fits(dim_size, [dim_key, attr], max_broadcast_bytes):
        looked = lookup(fact_lines, dim, fact_key, dim_key, [attr], dim_size, max_broadcast_bytes)
        return distinct_keys(looked, by_cols, attr, out)
    pairs = fact_lines.select(fact_key, *by_cols).distinct()
    by_names = [c for c in pairs.columns if c != fact_key]
    looked = lookup(pairs, dim, fact_key, dim_key, [attr], dim_size, max_broadcast_bytes)
    return distinct_keys(looked, by_names, attr, out)
