"""Every query of the warehouse by name: ``name -> fn(warehouse) -> DataFrame``.

Names are the inventory id in lower case plus a word (t = silver transform,
g = gold object, qb/qs/qg = checks, e = exploratory, n = analytics).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strata.plans import analytics, eda, quality
from strata.plans.silver import transform

Query = Callable[..., DataFrame]


def _silver(table: str) -> Query:
    return lambda wh: transform(table, wh.bronze(table), wh.as_of)


QUERIES: dict[str, Query] = {
    "t1_silver_customers": _silver("crm_cust_info"),
    "t2_silver_products": _silver("crm_prd_info"),
    "t3_silver_sales": _silver("crm_sales_details"),
    "t4_silver_erp_customers": _silver("erp_cust_az12"),
    "t5_silver_locations": _silver("erp_loc_a101"),
    "t6_silver_categories": _silver("erp_px_cat_g1v2"),
    "g1_dim_customers": lambda wh: wh.dim_customers(),
    "g2_dim_products": lambda wh: wh.dim_products(),
    "g3_fact_sales": lambda wh: wh.fact_sales(),
    "qb_row_counts": quality.bronze_row_counts,
    "qs_row_counts": quality.silver_row_counts,
    "qg_row_counts": quality.gold_row_counts,
    **{name: fn for name, (_, fn) in quality.CHECKS.items()},
    "qa_quality_summary": quality.summary,
    "e2_1_countries": eda.e2_1_countries,
    "e2_2_product_hierarchy": eda.e2_2_product_hierarchy,
    "e3_1_order_range": eda.e3_1_order_range,
    "e3_2_birthdate_range": eda.e3_2_birthdate_range,
    "e3_3_oldest_youngest": eda.e3_3_oldest_youngest,
    "e4_1_totals": eda.e4_1_totals,
    "e4_2_avg_price": eda.e4_2_avg_price,
    "e4_3_order_counts": eda.e4_3_order_counts,
    "e4_4_products": eda.e4_4_products,
    "e4_5_registered_customers": eda.e4_5_registered_customers,
    "e4_6_active_customers": eda.e4_6_active_customers,
    "e4_7_order_averages": eda.e4_7_order_averages,
    "e5_kpi_report": eda.e5_kpi_report,
    "e6_1_customers_by_country": eda.e6_1_customers_by_country,
    "e6_2_customers_by_gender": eda.e6_2_customers_by_gender,
    "e6_3_products_by_category": eda.e6_3_products_by_category,
    "e6_4_avg_cost_by_category": eda.e6_4_avg_cost_by_category,
    "e6_5_revenue_by_category": eda.e6_5_revenue_by_category,
    "e6_6_revenue_by_customer": eda.e6_6_revenue_by_customer,
    "e6_7_units_by_country": eda.e6_7_units_by_country,
    "e7_1a_top_products": eda.e7_1a_top_products,
    "e7_1b_top_products_ranked": eda.e7_1b_top_products_ranked,
    "e7_2_top_subcategories": eda.e7_2_top_subcategories,
    "e7_3_top_customers": eda.e7_3_top_customers,
    "e7_4_fewest_orders": eda.e7_4_fewest_orders,
    "e7_5_bottom_products": eda.e7_5_bottom_products,
    "n1a_sales_by_month": analytics.n1a_sales_by_month,
    "n1b_sales_by_month_start": analytics.n1b_sales_by_month_start,
    "n1c_sales_by_month_label": analytics.n1c_sales_by_month_label,
    "n2_running_totals": analytics.n2_running_totals,
    "n3_yoy_products": analytics.n3_yoy_products,
    "n4a_cost_ranges": analytics.n4a_cost_ranges,
    "n4b_customer_segments": analytics.n4b_customer_segments,
    "n5_category_share": analytics.n5_category_share,
    "g4_report_customers": analytics.n6_report_customers,
    "g5_report_products": analytics.n7_report_products,
}
