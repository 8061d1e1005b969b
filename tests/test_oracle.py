"""Every registered query against its DuckDB statement on the smallest
driver tables (the driver runs the same gate at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strata.oracle import AS_OF, oracle_sql
from strata.plans import eda, quality
from strata.plans.registry import QUERIES
from strata.sources import catalog
from tools.compare import TABLES, TYPE_NAMES, digest

from .conftest import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not available")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(sdf.columns, srows)[0] == digest(ocols, orows)[0]
    rel = duck.sql(entry.oracle_sql()[name])
    otypes = dict(zip(rel.columns, (str(t) for t in rel.types)))
    stypes = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    assert stypes == otypes


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "total_sales", "overall_sales", "percentage_of_total"]
    assert df.count() > 0


# ORDER BY of every ordered query: column, descending.
ORDERS = {
    "e2_1_countries": [("country", False)], "e2_2_product_hierarchy": [("category", False), ("subcategory", False), ("product_name", False)],
    "e6_1_customers_by_country": [("total_customers", True)], "e6_2_customers_by_gender": [("total_customers", True)],
    "e6_3_products_by_category": [("total_products", True)], "e6_4_avg_cost_by_category": [("avg_cost", True)],
    "e6_5_revenue_by_category": [("total_revenue", True)], "e6_6_revenue_by_customer": [("total_revenue", True)], "e6_7_units_by_country": [("total_units_sold", True)],
    "e7_1a_top_products": [("total_revenue", True)], "e7_1b_top_products_ranked": [("revenue_rank", False)], "e7_2_top_subcategories": [("total_revenue", True)],
    "e7_3_top_customers": [("total_revenue", True)], "e7_4_fewest_orders": [("order_frequency_rank", False)], "e7_5_bottom_products": [("total_revenue", False)],
    "n1a_sales_by_month": [("order_year", False), ("order_month", False)], "n1b_sales_by_month_start": [("order_date", False)], "n1c_sales_by_month_label": [("order_date", False)],
    "n2_running_totals": [], "n3_yoy_products": [("product_name", False), ("order_year", False)],
    "n4a_cost_ranges": [("total_products", True)], "n4b_customer_segments": [("total_customers", True)], "n5_category_share": [("total_sales", True)],
    "qs13_sales_rule": [("sls_sales", False), ("sls_quantity", False), ("sls_price", False)], "qs16_country_values": [("country_values", False)],
}


@pytest.mark.parametrize("name", sorted(n for n, keys in ORDERS.items() if keys))
def test_rows_come_in_order(spark, name):
    """NULL is lowest, as in the source: first ascending, last descending."""
    found = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]

    def before(a, b):
        for column, descending in ORDERS[name]:
            x, y = ((r[column] is not None, r[column]) for r in (a, b))
            if x != y:
                return (x > y) if descending else (x < y)
        return True

    assert len(found) > 1 and all(before(a, b) for a, b in zip(found, found[1:]))


def test_only_guaranteed_checks_are_empty(spark):
    """The stand-in trips every check but those the load itself guarantees (tested on violating frames)."""
    wh = entry.warehouse(spark, SF)
    empty = {name for name, (_, fn) in quality.CHECKS.items() if fn(wh).limit(1).count() == 0}
    assert empty == {"qs1_customer_id_dupes", "qs3_name_blanks", "qg3_customer_key_dupes", "qg6_product_key_dupes",
                     "qg12_customer_id_dupes", "qg13_product_number_dupes"}


def test_quality_summary(spark):
    wh = entry.warehouse(spark, SF)
    s = {r.check: r for r in quality.summary(wh).collect()}
    # checks the stand-in data is built to trip, and ones it must pass
    assert s["qg8_missing_category"].status == "failed" and s["qg8_missing_category"].violations > 0
    assert s["qs12_sales_date_order"].violations > 0
    for name in ("qs2_customer_key_blanks", "qs6_product_id_dupes", "qs8_product_cost", "qs10_product_dates", "qs11_raw_due_dates", "qg7_missing_start_date"):
        assert s[name].status == "failed" and s[name].violations == quality.CHECKS[name][1](wh).count() > 0, name
    for ok in ("qs1_customer_id_dupes", "qs4_gender_values", "qs9_product_lines",
               "qg3_customer_key_dupes", "qg6_product_key_dupes"):
        assert s[ok].status == "ok", ok
    assert all(r.status == "ok" for k, r in s.items() if k.startswith(("structure:", "row_count:")))
    assert sum(k.startswith("structure:") for k in s) == 15 and sum(k.startswith("row_count:") for k in s) == 15


def test_published_catalog_matches_warehouse(spark):
    wh = entry.warehouse(spark, SF)
    catalog.publish(wh, prefix="t_")
    for name, query in (("dim_customers", "g1_dim_customers"), ("dim_products", "g2_dim_products"), ("fact_sales", "g3_fact_sales"),
                        ("report_customers", "g4_report_customers"), ("report_products", "g5_report_products")):
        view, frame = spark.table(f"t_gold.{name}"), QUERIES[query](wh)
        assert view.dtypes == frame.dtypes, name
        assert view.exceptAll(frame).count() == 0 and frame.exceptAll(view).count() == 0, name
    kinds = {(r.table_schema, r.table_name): r.table_type for r in catalog.objects(spark, "t_").collect()}
    assert kinds[("t_gold", "fact_sales")] == "VIEW" and kinds[("t_silver", "crm_sales_details")] == "BASE TABLE"
    assert kinds[("t_gold", "report_customers")] == kinds[("t_gold", "report_products")] == "VIEW"
    listed = {r.table_name: r.table_type for r in eda.e1_1_objects(wh).filter("table_schema = 'gold'").collect()}
    assert listed == {"dim_customers": "BASE TABLE", "dim_products": "BASE TABLE", "fact_sales": "VIEW", "report_customers": "VIEW", "report_products": "VIEW"}
    assert eda.e1_2_gold_columns(wh).filter("table_name = 'report_products'").count() == 16
    cols = catalog.columns(spark, "gold", "t_").filter("table_name = 'dim_products'").collect()
    assert [c.column_name for c in cols][:2] == ["product_key", "product_id"]
    assert spark.sql("SELECT count(*) FROM t_silver.crm_cust_info").first()[0] == wh.rows["silver.crm_cust_info"]


LARGE_DIMENSION_QUERIES = [
    "g3_fact_sales", "qg1_fact_without_customer", "qg9_null_fact_keys", "e4_6_active_customers",
    "e5_kpi_report", "e6_5_revenue_by_category", "e6_6_revenue_by_customer", "e6_7_units_by_country",
    "e7_1a_top_products", "e7_1b_top_products_ranked", "e7_3_top_customers", "e7_4_fewest_orders",
    "n1a_sales_by_month", "n1b_sales_by_month_start", "n1c_sales_by_month_label", "n3_yoy_products", "n4b_customer_segments", "n5_category_share",
    "g4_report_customers", "g5_report_products",
]


@pytest.fixture
def no_broadcast(spark):
    wh = entry.warehouse(spark, SF)
    before = (wh.max_broadcast_bytes, spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    wh.max_broadcast_bytes = 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    wh.max_broadcast_bytes = before[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


@pytest.mark.parametrize("name", LARGE_DIMENSION_QUERIES)
def test_large_dimension_plans_match_oracle(spark, duck, no_broadcast, name):
    """Dimensions treated as too large to broadcast: sort-merge lookups and
    aggregation per natural key before attributes are attached."""
    test_query_matches_oracle(spark, duck, name)


def _plan(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bucketed_customer_join_needs_no_shuffle(spark, no_broadcast):
    """Where customers are too large to broadcast, sales and customers are bucketed alike on the customer id: the
    per-customer pre-aggregate and the customer lookup run without exchanging the fact."""
    from strata.plans.warehouse import Warehouse

    wh = Warehouse.from_standin(spark, SF, as_of=AS_OF, max_broadcast_bytes=0)
    layouts = {r.table_name: r.layout for r in wh.load_metrics.collect()}
    assert wh.sales_bucketed and layouts["crm_sales_details"].startswith("bucketed(") and layouts["crm_prd_info"] == "plain"
    plan = _plan(QUERIES["n4b_customer_segments"](wh))
    assert "SortMergeJoin [sls_cust_id" in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning(sls_cust_id" not in plan
    assert "Exchange hashpartitioning(_lookup_key" not in plan
    assert rows(QUERIES["n4b_customer_segments"](wh)) == rows(QUERIES["n4b_customer_segments"](entry.warehouse(spark, SF)))
    catalog.publish(wh, prefix="b_")  # keeps the layout
    published = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED b_silver.crm_sales_details").collect()}
    assert published["Bucket Columns"] == "[`sls_cust_id`]" and int(published["Num Buckets"]) == wh.buckets


def test_reports_copy_no_line_and_exchange_the_fact_once(spark):
    """No Expand (several distinct counts in one aggregate); the only exchange whose rows are in number like the lines' is that
    of (entity, order); all else is combined map-side per entity and word or quantity."""
    wh = entry.warehouse(spark, SF)
    for name, entity in (("g4_report_customers", "k"), ("g5_report_products", "k"), ("n1a_sales_by_month", None), ("e4_6_active_customers", None)):
        plan = _plan(QUERIES[name](wh))
        assert "Expand" not in plan, name
        assert plan.count("order_number") == 0 or sum("Exchange hashpartitioning(" in line and "order_number" in line for line in plan.splitlines()) <= 1, name
    assert sum("Scan parquet" in line for line in _plan(QUERIES["n1a_sales_by_month"](wh)).splitlines() if "sls_" in line) == 1


def test_summary_reads_each_table_once_for_its_rules(spark):
    wh = entry.warehouse(spark, SF)
    plan = _plan(quality.summary(wh))
    scans = [line for line in plan.splitlines() if "Scan parquet" in line and "sls_" in line]
    # bronze sales once, silver sales once by itself and once as the fact
    assert len(scans) == 3, scans
    # customers, products: once for rules, once for each unique key; each dimension also as the fact's key
    assert plan.count("Scan parquet") <= 6 + 6 + 3 + 6 + 2


def test_plans_prune_push_down_and_skip_unneeded_joins(spark):
    wh = entry.warehouse(spark, SF)
    assert wh.customers_unique and wh.products_unique
    totals = _plan(QUERIES["e4_1_totals"](wh))
    # two columns read, no dimension joined (both natural keys proven unique)
    assert "ReadSchema: struct<sls_sales:int,sls_quantity:int>" in totals or \
        "ReadSchema: struct<sls_quantity:int,sls_sales:int>" in totals
    assert "Join" not in totals
    dated = _plan(QUERIES["n2_running_totals"](wh))
    assert "PushedFilters: [IsNotNull(sls_order_dt)]" in dated
    ranked = _plan(QUERIES["e7_1b_top_products_ranked"](wh))
    assert ranked.index("Window") < ranked.index("TakeOrderedAndProject")  # top-k below the global window
    lookups = _plan(QUERIES["e6_5_revenue_by_category"](wh))
    assert "BroadcastHashJoin" in lookups and "SortMergeJoin" not in lookups


def test_layer_properties(spark):
    """Silver never has more rows than bronze; with unique dimension keys the
    fact view has exactly one row per silver sales line; keys are dense 1..N."""
    from pyspark.sql import functions as F

    from strata.schemas import BRONZE

    wh = entry.warehouse(spark, SF)
    for name in BRONZE:
        assert wh.silver(name).count() <= wh.bronze(name).count(), name
    assert wh.customers_unique and wh.products_unique
    assert wh.fact_sales().count() == wh.silver("crm_sales_details").count()
    for dim, key in ((wh.dim_customers(), "customer_key"), (wh.dim_products(), "product_key")):
        n = dim.count()
        assert dim.agg(F.min(key), F.max(key), F.countDistinct(key)).first() == (1, n, n)
