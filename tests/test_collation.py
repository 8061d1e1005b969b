"""Text compared as bytes, or as the source's collation does: without case and trailing blanks."""

import pytest

from strata.plans import quality
from strata.plans.jobs import load_bronze
from strata.plans.registry import QUERIES
from strata.plans.warehouse import Warehouse
from strata.sources import catalog
from strata.sources.tables import LayerStore

from .conftest import rows
from .test_sources_and_jobs import EXTRACTS
from .test_sources_and_jobs import write_extracts as write_lines

ODD = dict(EXTRACTS)
# an ERP key in lower case, one with a blank behind it; a product number in lower case, with a blank
ODD["erp_loc_a101"] = ["CID,CNTRY", "aw-00011000,DE", "AW-00011001 ,GERMANY"]
ODD["crm_sales_details"] = EXTRACTS["crm_sales_details"] + ["SO50000,hl-u509-r ,11000,20110105,20110110,20110115,14,1,14"]


@pytest.mark.parametrize("collated", [False, True])
def test_keys_join_group_and_count_by_the_collation(spark, tmp_path, collated):
    store = LayerStore(spark, str(tmp_path / "wh"))
    load_bronze(spark, write_lines(str(tmp_path / "src"), ODD), store)
    wh = Warehouse.build(spark, store=store, as_of="2025-12-01", source_collation=collated)
    country = {r.customer_id: r.country for r in wh.dim_customers().collect()}
    matched = [r for r in wh.fact_sales().collect() if r.order_number == "SO50000"]
    countries = rows(QUERIES["e6_1_customers_by_country"](wh), "total_customers")
    if collated:
        assert country == {11000: "Germany", 11001: "GERMANY"} and matched[0].product_key is not None
        assert countries == [(2,)] and QUERIES["e2_1_countries"](wh).count() == 1  # one country, however it is spelled
        assert QUERIES["qg2_fact_without_product"](wh).count() == 0
        assert QUERIES["qs16_country_values"](wh).count() == 1
    else:
        assert country == {11000: None, 11001: None} and matched[0].product_key is None
        assert countries == [(2,)] and QUERIES["e2_1_countries"](wh).collect()[0].country is None
        assert rows(QUERIES["qg2_fact_without_product"](wh)) == [("SO50000", None)]
        assert QUERIES["qs16_country_values"](wh).count() == 2
    summary = {r.check: r for r in quality.summary(wh).collect()}
    assert all(r.status == "ok" for c, r in summary.items() if c.startswith("structure:"))
    assert summary["qg2_fact_without_product"].violations == (0 if collated else 1)
    assert QUERIES["g4_report_customers"](wh).count() == 2 and QUERIES["g5_report_products"](wh).count() == (2 if collated else 3)
    prefix = f"coll{int(collated)}_"
    catalog.publish(wh, prefix=prefix)
    joined = spark.sql(f"SELECT count(*) AS n FROM {prefix}silver.crm_sales_details JOIN {prefix}gold.dim_products ON sls_prd_key = product_number").first().n
    assert joined == (4 if collated else 3)
