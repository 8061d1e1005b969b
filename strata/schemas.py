"""Declared schemas of the three layers.

Nothing is inferred: every bronze file is read against one of these, and every
silver table is written with exactly these columns in this order.  All columns
are nullable, as in the source definitions.
"""

from __future__ import annotations

from pyspark.sql import types as T

LAYERS = ("bronze", "silver", "gold")

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- bronze: raw mirror of the six source files -----------------------------
BRONZE = {
    "crm_cust_info": _struct(
        ("cst_id", I), ("cst_key", S), ("cst_firstname", S), ("cst_lastname", S),
        ("cst_marital_status", S), ("cst_gndr", S), ("cst_create_date", D),
    ),
    "crm_prd_info": _struct(
        ("prd_id", I), ("prd_key", S), ("prd_nm", S), ("prd_cost", I), ("prd_line", S),
        ("prd_start_dt", TS), ("prd_end_dt", TS),
    ),
    "crm_sales_details": _struct(
        ("sls_ord_num", S), ("sls_prd_key", S), ("sls_cust_id", I), ("sls_order_dt", I),
        ("sls_ship_dt", I), ("sls_due_dt", I), ("sls_sales", I), ("sls_quantity", I), ("sls_price", I),
    ),
    "erp_loc_a101": _struct(("cid", S), ("cntry", S)),
    "erp_cust_az12": _struct(("cid", S), ("bdate", D), ("gen", S)),
    "erp_px_cat_g1v2": _struct(("id", S), ("cat", S), ("subcat", S), ("maintenance", S)),
}

# The extract file of each bronze table, relative to the
# landing folder, as the two source systems deliver them.
SOURCE_FILES = {
    "crm_cust_info": "source_crm/cust_info.csv",
    "crm_prd_info": "source_crm/prd_info.csv",
    "crm_sales_details": "source_crm/sales_details.csv",
    "erp_loc_a101": "source_erp/LOC_A101.csv",
    "erp_cust_az12": "source_erp/CUST_AZ12.csv",
    "erp_px_cat_g1v2": "source_erp/PX_CAT_G1V2.csv",
}

# Load order of both jobs (CRM first, then ERP).
LOAD_ORDER = (
    "crm_cust_info", "crm_prd_info", "crm_sales_details",
    "erp_loc_a101", "erp_cust_az12", "erp_px_cat_g1v2",
)

AUDIT_COLUMN = "dwh_create_date"

# --- silver: cleaned tables; the audit column is filled by the load job -------
SILVER = {
    "crm_cust_info": _struct(
        ("cst_id", I), ("cst_key", S), ("cst_firstname", S), ("cst_lastname", S),
        ("cst_marital_status", S), ("cst_gndr", S), ("cst_create_date", D),
    ),
    "crm_prd_info": _struct(
        ("prd_id", I), ("cat_id", S), ("prd_key", S), ("prd_nm", S), ("prd_cost", I),
        ("prd_line", S), ("prd_start_dt", D), ("prd_end_dt", D),
    ),
    "crm_sales_details": _struct(
        ("sls_ord_num", S), ("sls_prd_key", S), ("sls_cust_id", I), ("sls_order_dt", D),
        ("sls_ship_dt", D), ("sls_due_dt", D), ("sls_sales", I), ("sls_quantity", I), ("sls_price", I),
    ),
    "erp_loc_a101": _struct(("cid", S), ("cntry", S)),
    "erp_cust_az12": _struct(("cid", S), ("bdate", D), ("gen", S)),
    "erp_px_cat_g1v2": _struct(("id", S), ("cat", S), ("subcat", S), ("maintenance", S)),
}


def conform(df, schema: T.StructType):
    """Select exactly the declared columns, in order, cast to the declared types."""
    from pyspark.sql import functions as F

    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def collated(schema: T.StructType, collation: str | None) -> T.StructType:
    """The schema with its text columns under ``collation``, so that joins, grouping and DISTINCT compare as it does."""
    if collation is None:
        return schema
    text = T.StringType(collation)
    return T.StructType([T.StructField(f.name, text if isinstance(f.dataType, T.StringType) else f.dataType, True) for f in schema.fields])


def with_audit(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(AUDIT_COLUMN, TS, True)])


# --- gold: star schema and reporting views ----------------------------------
GOLD = {
    "dim_customers": _struct(
        ("customer_key", L), ("customer_id", I), ("customer_number", S), ("first_name", S),
        ("last_name", S), ("country", S), ("marital_status", S), ("gender", S),
        ("birthdate", D), ("create_date", D),
    ),
    "dim_products": _struct(
        ("product_key", L), ("product_id", I), ("product_number", S), ("product_name", S),
        ("category_id", S), ("category", S), ("subcategory", S), ("maintenance", S),
        ("cost", I), ("product_line", S), ("start_date", D),
    ),
    "fact_sales": _struct(
        ("order_number", S), ("product_key", L), ("customer_key", L), ("order_date", D),
        ("shipping_date", D), ("due_date", D), ("sales_amount", I), ("quantity", I), ("price", I),
    ),
    "report_customers": _struct(
        ("customer_key", L), ("customer_number", S), ("customer_name", S), ("age", I),
        ("age_group", S), ("customer_segment", S), ("last_order_date", D), ("recency", I),
        ("total_orders", L), ("total_sales", L), ("total_quantity", L), ("total_products", L),
        ("lifespan", I), ("avg_order_value", L), ("avg_monthly_spend", L),
    ),
    "report_products": _struct(
        ("product_key", L), ("product_name", S), ("category", S), ("subcategory", S), ("cost", I),
        ("last_sale_date", D), ("recency_in_months", I), ("product_segment", S), ("lifespan", I),
        ("total_orders", L), ("total_sales", L), ("total_quantity", L), ("total_customers", L),
        ("avg_selling_price", T.DoubleType()), ("avg_order_revenue", L), ("avg_monthly_revenue", L),
    ),
}
