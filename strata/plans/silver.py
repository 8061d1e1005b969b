"""Silver transforms: one pure ``bronze DataFrame -> silver DataFrame`` per table.

T1 and T2 shuffle by their key (an aggregate, and an aggregate plus a
window over distinct start dates); T3-T6 are map-only projections that run
inside one codegen stage per scan split.
The audit column is added by the load job, not here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import as_of_date, decode, yyyymmdd_to_date
from strata.operators.keys import keep_latest
from strata.operators.windows import next_start
from strata.schemas import SILVER, collated, conform

# Code tables of the source system.
MARITAL_CODES = [(["S"], "Single"), (["M"], "Married")]
GENDER_CODES = [(["F"], "Female"), (["M"], "Male")]
PRODUCT_LINE_CODES = [(["M"], "Mountain"), (["R"], "Road"), (["S"], "Other Sales"), (["T"], "Touring")]
ERP_GENDER_CODES = [(["F", "FEMALE"], "Female"), (["M", "MALE"], "Male")]
ERP_CUSTOMER_PREFIX = "NAS"
COUNTRY_CODES = [(["DE"], "Germany"), (["US", "USA"], "United States")]
UNKNOWN = "n/a"


def _conform(df: DataFrame, name: str) -> DataFrame:
    return conform(df, SILVER[name])


def silver_customers(bronze: DataFrame) -> DataFrame:
    """T1: latest row per customer id, trimmed names, decoded codes.

    Rows without an id cannot be linked and are dropped.  The newest
    ``cst_create_date`` wins (a NULL date only when the id has no other).
    """
    latest = keep_latest(
        bronze.filter(F.col("cst_id").isNotNull()),
        key="cst_id",
        order_by=["cst_create_date"],
        columns=["cst_id", "cst_create_date", "cst_key", "cst_firstname", "cst_lastname",
                 "cst_marital_status", "cst_gndr"],
    )
    out = latest.select(
        "cst_id",
        "cst_key",
        F.trim("cst_firstname").alias("cst_firstname"),
        F.trim("cst_lastname").alias("cst_lastname"),
        decode("cst_marital_status", MARITAL_CODES, UNKNOWN).alias("cst_marital_status"),
        decode("cst_gndr", GENDER_CODES, UNKNOWN).alias("cst_gndr"),
        "cst_create_date",
    )
    return _conform(out, "crm_cust_info")


def silver_products(bronze: DataFrame) -> DataFrame:
    """T2: split the composite key, default the cost, decode the line, and
    derive each version's end date as the day before the next version starts.

    The next start is taken over the *raw* key (category prefix included),
    before the key is shortened, in (start, id) order.  The raw end date is
    ignored: it is unreliable.
    """
    raw_key = F.col("prd_key")
    versions = next_start(bronze, key="prd_key", start="prd_start_dt", tie="prd_id", out="_next_start")
    out = versions.select(
        "prd_id",
        F.replace(F.substring(raw_key, 1, 5), F.lit("-"), F.lit("_")).alias("cat_id"),
        F.expr("substring(prd_key, 7)").alias("prd_key"),
        "prd_nm",
        F.coalesce(F.col("prd_cost"), F.lit(0)).alias("prd_cost"),
        decode("prd_line", PRODUCT_LINE_CODES, UNKNOWN).alias("prd_line"),
        F.col("prd_start_dt").cast("date").alias("prd_start_dt"),
        F.date_sub(F.col("_next_start").cast("date"), 1).alias("prd_end_dt"),
    )
    return _conform(out, "crm_prd_info")


def silver_sales(bronze: DataFrame) -> DataFrame:
    """T3: integer dates to dates; repair amounts.

    Sales are recomputed from quantity x |price| when missing, not positive
    or inconsistent; a missing or non-positive price is derived from the
    *raw* sales and quantity (truncating integer division, NULL for quantity
    0).  Both are computed in one projection so the price rule sees the raw
    sales value.  A NULL price leaves ``sales != qty * |price|`` unknown, so
    the raw sales value is kept.
    """
    sales, qty, price = F.col("sls_sales"), F.col("sls_quantity"), F.col("sls_price")
    recomputed = qty * F.abs(price)
    fixed_sales = F.when(sales.isNull() | (sales <= 0) | (sales != recomputed), recomputed).otherwise(sales)
    derived_price = F.call_function("div", sales, F.nullif(qty, F.lit(0))).cast("int")
    fixed_price = F.when(price.isNull() | (price <= 0), derived_price).otherwise(price)
    out = bronze.select(
        "sls_ord_num",
        "sls_prd_key",
        "sls_cust_id",
        yyyymmdd_to_date("sls_order_dt").alias("sls_order_dt"),
        yyyymmdd_to_date("sls_ship_dt").alias("sls_ship_dt"),
        yyyymmdd_to_date("sls_due_dt").alias("sls_due_dt"),
        fixed_sales.alias("sls_sales"),
        qty.alias("sls_quantity"),
        fixed_price.alias("sls_price"),
    )
    return _conform(out, "crm_sales_details")


def silver_erp_customers(bronze: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """T4: drop the 'NAS' prefix, NULL future birthdates, normalise gender."""
    cid = F.col("cid")
    out = bronze.select(
        F.when(cid.startswith(ERP_CUSTOMER_PREFIX), F.expr("substring(cid, 4)")).otherwise(cid).alias("cid"),
        F.when(F.col("bdate") > as_of_date(as_of), F.lit(None).cast("date")).otherwise(F.col("bdate")).alias("bdate"),
        decode("gen", ERP_GENDER_CODES, UNKNOWN).alias("gen"),
    )
    return _conform(out, "erp_cust_az12")


def silver_locations(bronze: DataFrame) -> DataFrame:
    """T5: remove hyphens from the key; expand country codes; blank -> n/a."""
    country = F.trim(F.col("cntry"))
    blank = (country == "") | country.isNull()
    known = [(country.isin(codes), F.lit(name)) for codes, name in COUNTRY_CODES]
    cleaned = F.coalesce(*[F.when(cond, name) for cond, name in [*known, (blank, F.lit(UNKNOWN))]], country)
    out = bronze.select(F.replace(F.col("cid"), F.lit("-"), F.lit("")).alias("cid"), cleaned.alias("cntry"))
    return _conform(out, "erp_loc_a101")


def silver_categories(bronze: DataFrame) -> DataFrame:
    """T6: reference data, copied as is."""
    return _conform(bronze.select("id", "cat", "subcat", "maintenance"), "erp_px_cat_g1v2")


TRANSFORMS = {
    "crm_cust_info": silver_customers,
    "crm_prd_info": silver_products,
    "crm_sales_details": silver_sales,
    "erp_loc_a101": silver_locations,
    "erp_cust_az12": silver_erp_customers,
    "erp_px_cat_g1v2": silver_categories,
}


def transform(table: str, bronze: DataFrame, as_of: date | str | None = None, collation: str | None = None) -> DataFrame:
    """The silver rows of a bronze table.  The rules themselves compare text as bytes; with ``collation`` the
    text columns they give carry it, and so do the joins and groupings of everything built on them."""
    fn = TRANSFORMS[table]
    out = fn(bronze, as_of) if table == "erp_cust_az12" else fn(bronze)
    return conform(out, collated(SILVER[table], collation)) if collation else out
