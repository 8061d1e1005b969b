"""Reporting views (G4, G5): one row per customer / per product with KPIs.

Each report is one Spark SQL text, which is both the persistent view's definition (``sources.catalog``) and, with
DataFrames in place of its tables, the query.  Shape: fact lines -> a few narrow aggregates per entity ->
dimension attributes -> labels and ratios.  No aggregate holds a distinct count next to others, so no line is copied
(Expand): orders are counted by grouping by (entity, order) first, the entity's other keys as bitmap words
(``operators.distinct``).  Each aggregate is combined map-side; one of them shuffles rows in number like the lines', and
a very busy customer or product is spread over many tasks by the order or the word.  Attributes are joined to
one row per entity.

Lines without a dimension row are a group of their own; it is carried as ``UNMATCHED`` (surrogate keys are 1..N) so
that the aggregates of an entity join on plain equality, and becomes NULL again at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.schemas import GOLD

UNMATCHED = -1


@dataclass(frozen=True)
class CustomerThresholds:
    """Segmentation rules of the customer report (fixed values of the source)."""
    vip_lifespan_months: int = 12
    vip_spend: int = 5000
    # Age bands: (low, high, label), checked in order; anything else is the last label.
    under_label: str = "Under 20"
    under_age: int = 20
    bands: tuple = ((20, 29, "20-29"), (30, 39, "30-39"), (40, 49, "40-49"))
    top_label: str = "50 and above"
    # The source's CASE sends an unknown age (no birthdate) to the top band;
    # set a label here to report those customers separately instead.
    unknown_age_label: str | None = None


@dataclass(frozen=True)
class ProductThresholds:
    high_revenue: int = 50000
    mid_revenue: int = 10000


@dataclass(frozen=True)
class CostTiers:
    """Cost ranges (fixed values of the source): both ends belong to a tier and the first that fits wins, so 500 is '100-500'."""
    tiers: tuple = ((None, 99, "Below 100"), (100, 500, "100-500"), (500, 1000, "500-1000"))
    otherwise: str = "Above 1000"


@dataclass(frozen=True)
class Thresholds:
    """All rules that a user may set."""
    customer: CustomerThresholds = field(default_factory=CustomerThresholds)
    product: ProductThresholds = field(default_factory=ProductThresholds)
    cost: CostTiers = field(default_factory=CostTiers)


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ladder(branches: list[tuple[str, str]], otherwise: str) -> str:
    """CASE whose first true branch wins; an unknown condition is not true."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {text(label)}" for cond, label in branches) + f" ELSE {text(otherwise)} END"


def segment_sql(lifespan: str, spend: str, t: CustomerThresholds) -> str:
    """VIP / Regular / New by lifespan in months and total spend."""
    long = f"{lifespan} >= {t.vip_lifespan_months}"
    return ladder([(f"{long} AND {spend} > {t.vip_spend}", "VIP"), (f"{long} AND {spend} <= {t.vip_spend}", "Regular")], "New")


def cost_range_sql(cost: str, t: CostTiers) -> str:
    return ladder([(f"{cost} <= {high}" if low is None else f"{cost} BETWEEN {low} AND {high}", label) for low, high, label in t.tiers], t.otherwise)


def as_of_sql(as_of: date | str | None) -> str:
    return "current_date()" if as_of is None else f"DATE '{as_of if isinstance(as_of, str) else as_of.isoformat()}'"


def _months(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


def _ratio(total: str, n: str, without: str) -> str:
    return f"CASE WHEN {n} = 0 THEN {without} ELSE {total} div nullif({n}, 0) END"


def _dated(table: str, key: str, *columns: str) -> str:
    return f"SELECT coalesce({key}, {UNMATCHED}) AS k, {', '.join(columns)} FROM {table} WHERE order_date IS NOT NULL"


def _distinct_words(table: str, key: str, other: str, out: str) -> list[tuple[str, str]]:
    """COUNT(DISTINCT other) per key: words of 64 neighbouring keys, counted by their bits."""
    return [
        (f"{out}_words", f"SELECT k, shiftright(o, 6) AS word, bit_or(shiftleft(1L, CAST(o & 63 AS INT))) AS bits FROM ({_dated(table, key, f'{other} AS o')}) GROUP BY k, shiftright(o, 6)"),
        (out, f"SELECT k, coalesce(sum(bit_count(bits)), 0) AS {out} FROM {out}_words GROUP BY k"),
    ]


def _distinct_pairs(keyed: str, key: str, other: str, dim: str, dim_key: str, dim_number: str, out: str) -> list[tuple[str, str]]:
    """The same where the other dimension is too large to look up per line and its natural key is unique: one look-up per
    distinct pair, and a pair is a key."""
    return [
        (f"{out}_pairs", f"SELECT DISTINCT k, o FROM ({_dated(keyed, key, f'{other} AS o')})"),
        (out, f"SELECT k, count(d.{dim_key}) AS {out} FROM {out}_pairs LEFT JOIN {dim} d ON o = d.{dim_number} GROUP BY k"),
    ]


def _statement(ctes: list[tuple[str, str]], report: str, columns: dict[str, str], source: str) -> str:
    """Columns in the declared order and of the declared types."""
    chosen = ", ".join(f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" if f.dataType.simpleString() != "string" else f"{columns[f.name]} AS {f.name}" for f in GOLD[report].fields)
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + f"\nSELECT {chosen}\nFROM {source}"


def customer_report_sql(as_of: date | str | None = None, t: CustomerThresholds = CustomerThresholds(), by_pairs: bool = False) -> str:
    """G4 over ``{facts}`` (the fact view's columns) and ``{customers}``.  ``by_pairs``: ``{facts}`` carries the product
    number instead of its key, which is looked up in ``{products}``."""
    today = as_of_sql(as_of)
    products = (_distinct_pairs("{facts}", "customer_key", "sls_prd_key", "{products}", "product_key", "product_number", "total_products")
                if by_pairs else _distinct_words("{facts}", "customer_key", "product_key", "total_products"))
    ctes = [
        ("orders", f"SELECT k, order_number, sum(sales_amount) AS sales, sum(quantity) AS units, min(order_date) AS first_day, max(order_date) AS last_day FROM ({_dated('{facts}', 'customer_key', 'order_number', 'sales_amount', 'quantity', 'order_date')}) GROUP BY k, order_number"),
        ("totals", f"SELECT k, count(order_number) AS total_orders, sum(sales) AS total_sales, sum(units) AS total_quantity, max(last_day) AS last_day, {_months('min(first_day)', 'max(last_day)')} AS lifespan FROM orders GROUP BY k"),
        *products,
        ("people", f"SELECT customer_key, customer_number, concat(coalesce(first_name, ''), ' ', coalesce(last_name, '')) AS name, year({today}) - year(birthdate) AS age FROM {{customers}}"),
    ]
    unknown = [("age IS NULL", t.unknown_age_label)] if t.unknown_age_label is not None else []
    columns = {
        "customer_key": f"nullif(totals.k, {UNMATCHED})", "customer_number": "customer_number",
        # lines without a customer: the name of nobody
        "customer_name": "coalesce(name, ' ')", "age": "age",
        "age_group": ladder([*unknown, (f"age < {t.under_age}", t.under_label), *((f"age BETWEEN {low} AND {high}", label) for low, high, label in t.bands)], t.top_label),
        "customer_segment": segment_sql("lifespan", "total_sales", t), "last_order_date": "last_day", "recency": _months("last_day", today),
        "total_orders": "total_orders", "total_sales": "total_sales", "total_quantity": "total_quantity", "total_products": "total_products", "lifespan": "lifespan",
        "avg_order_value": _ratio("total_sales", "total_orders", "0"), "avg_monthly_spend": _ratio("total_sales", "lifespan", "total_sales"),
    }
    return _statement(ctes, "report_customers", columns, "totals JOIN total_products ON totals.k = total_products.k LEFT JOIN people ON totals.k = people.customer_key")


def product_report_sql(as_of: date | str | None = None, t: ProductThresholds = ProductThresholds(), by_pairs: bool = False) -> str:
    """G5 over ``{facts}`` and ``{products}``; ``by_pairs``: with the customer id, looked up in ``{customers}``.

    The mean unit price is made of whole numbers: sales are summed per quantity, each sum is divided once as a decimal and
    decimals are added, so the mean does not depend on the order in which lines arrive."""
    today = as_of_sql(as_of)
    customers = (_distinct_pairs("{facts}", "product_key", "sls_cust_id", "{customers}", "customer_key", "customer_id", "total_customers")
                 if by_pairs else _distinct_words("{facts}", "product_key", "customer_key", "total_customers"))
    ctes = [
        ("sizes", f"SELECT k, quantity, sum(sales_amount) AS sales, count(sales_amount) AS priced, count(*) AS n, min(order_date) AS first_day, max(order_date) AS last_day FROM ({_dated('{facts}', 'product_key', 'quantity', 'sales_amount', 'order_date')}) GROUP BY k, quantity"),
        ("totals", f"SELECT k, sum(sales) AS total_sales, sum(CAST(quantity AS BIGINT) * n) AS total_quantity, max(last_day) AS last_day, {_months('min(first_day)', 'max(last_day)')} AS lifespan, "
                   "round(CAST(sum(CAST(sales AS DECIMAL(20, 0)) / nullif(CAST(quantity AS DECIMAL(10, 0)), 0)) AS DOUBLE) / nullif(sum(CASE WHEN quantity <> 0 THEN priced END), 0), 1) AS unit_price "
                   "FROM sizes GROUP BY k"),
        ("total_orders", f"SELECT k, count(order_number) AS total_orders FROM (SELECT DISTINCT k, order_number FROM ({_dated('{facts}', 'product_key', 'order_number')})) GROUP BY k"),
        *customers,
    ]
    columns = {
        "product_key": f"nullif(totals.k, {UNMATCHED})", "product_name": "product_name", "category": "category", "subcategory": "subcategory", "cost": "cost",
        "last_sale_date": "last_day", "recency_in_months": _months("last_day", today),
        "product_segment": ladder([(f"total_sales > {t.high_revenue}", "High-Performer"), (f"total_sales >= {t.mid_revenue}", "Mid-Range")], "Low-Performer"),
        "lifespan": "lifespan", "total_orders": "total_orders", "total_sales": "total_sales", "total_quantity": "total_quantity", "total_customers": "total_customers",
        "avg_selling_price": "unit_price",
        "avg_order_revenue": _ratio("total_sales", "total_orders", "0"), "avg_monthly_revenue": _ratio("total_sales", "lifespan", "total_sales"),
    }
    return _statement(ctes, "report_products", columns, "totals JOIN total_orders ON totals.k = total_orders.k JOIN total_customers ON totals.k = total_customers.k LEFT JOIN {products} p ON totals.k = p.product_key")


def report_customers(facts: DataFrame, customers: DataFrame, as_of: date | str | None = None,
                     t: CustomerThresholds = CustomerThresholds(), products: DataFrame | None = None) -> DataFrame:
    """G4.  ``facts`` = fact rows with customer_key and product_key; ``customers`` = the customer
    dimension.  With ``products`` the facts carry ``sls_prd_key`` instead of ``product_key``."""
    more = {} if products is None else {"products": products}
    return facts.sparkSession.sql(customer_report_sql(as_of, t, products is not None), facts=facts, customers=customers, **more)


def report_products(facts: DataFrame, products: DataFrame, as_of: date | str | None = None,
                    t: ProductThresholds = ProductThresholds(), customers: DataFrame | None = None) -> DataFrame:
    """G5.  ``facts`` = fact rows with product_key and customer_key; ``products`` = the product dimension.
    With ``customers`` the facts carry ``sls_cust_id`` instead of ``customer_key``."""
    more = {} if customers is None else {"customers": customers}
    return facts.sparkSession.sql(product_report_sql(as_of, t, customers is not None), facts=facts, products=products, **more)


def segment(lifespan: str, spend: str, t: CustomerThresholds) -> F.Column:
    return F.expr(segment_sql(lifespan, spend, t))
