"""Silver transforms on the fixture rows each rule needs."""

from datetime import date, datetime

from strata.plans import silver
from strata.schemas import BRONZE, SILVER

from .conftest import columns, rows


def bronze(spark, table, data):
    return spark.createDataFrame(data, BRONZE[table])


def test_customers_keep_latest_trim_decode(spark):
    data = [
        (None, "AW1", "No", "Id", "S", "F", date(2024, 1, 1)),           # no id: dropped
        (1, "AW1", "  Ann ", " Lee  ", " s ", "f", date(2023, 1, 1)),    # older version
        (1, "AW1", " Anne", "Lee", "M", " m", date(2024, 1, 1)),         # newest wins
        (2, "AW2", "Bo", "Ek", "x", None, None),                         # NULL date loses ...
        (2, "AW2", "Bob", "Ek", "S", "F", date(2020, 1, 1)),             # ... to any dated row
        (3, "AW3", "Cy", "Do", None, "X", None),                         # only row: kept
    ]
    out = silver.silver_customers(bronze(spark, "crm_cust_info", data))
    assert columns(out.schema) == columns(SILVER["crm_cust_info"])
    assert rows(out) == [
        (1, "AW1", "Anne", "Lee", "Married", "Male", date(2024, 1, 1)),
        (2, "AW2", "Bob", "Ek", "Single", "Female", date(2020, 1, 1)),
        (3, "AW3", "Cy", "Do", "n/a", "n/a", None),
    ]


def test_customers_tie_is_deterministic(spark):
    data = [(7, "AW7", "A", "X", "S", "F", date(2024, 1, 1)), (7, "AW7", "B", "X", "M", "M", date(2024, 1, 1))]
    df = bronze(spark, "crm_cust_info", data)
    first = rows(silver.silver_customers(df))
    again = rows(silver.silver_customers(df.repartition(3)))
    assert len(first) == 1 and first == again


def test_products_versions_and_codes(spark):
    ts = lambda y, m=7, d=1: datetime(y, m, d)
    data = [
        (1, "CO-RF-FR-1", "Frame", None, "R ", ts(2011), ts(2007, 12, 28)),   # NULL cost -> 0
        (2, "CO-RF-FR-1", "Frame", 12, "r", ts(2012), None),                  # second version
        (3, "CO-RF-FR-1", "Frame", 14, None, ts(2013), None),                 # third, active
        (4, "AC-HE-HL-2", "Helmet", 5, "Z", ts(2012), None),                  # unknown line
        (5, "BI-MB-M-3", "Bike", 900, "M", ts(2011), ts(2012)),               # single version
        (6, "BI-MB-S-4", "Bike S", 1, "S", ts(2011), None),
        (7, "BI-TB-T-5", "Bike T", 2, "T", ts(2011), None),
    ]
    out = silver.silver_products(bronze(spark, "crm_prd_info", data))
    assert columns(out.schema) == columns(SILVER["crm_prd_info"])
    got = {r.prd_id: r for r in out.collect()}
    assert (got[1].cat_id, got[1].prd_key, got[1].prd_cost, got[1].prd_line) == ("CO_RF", "FR-1", 0, "Road")
    assert got[1].prd_end_dt == date(2012, 6, 30)
    assert got[2].prd_end_dt == date(2013, 6, 30) and got[2].prd_line == "Road"
    assert got[3].prd_end_dt is None and got[3].prd_line == "n/a"
    assert got[4].prd_line == "n/a" and got[4].cat_id == "AC_HE"
    assert got[5].prd_end_dt is None and got[5].prd_line == "Mountain" and got[5].prd_start_dt == date(2011, 7, 1)
    assert got[6].prd_line == "Other Sales" and got[7].prd_line == "Touring"


def test_products_window_uses_raw_key(spark):
    # Same short key under two categories: two separate histories.
    ts = datetime(2011, 7, 1)
    data = [(1, "AA-BB-K1", "x", 1, "M", ts, None), (2, "CC-DD-K1", "x", 1, "M", datetime(2012, 7, 1), None)]
    out = silver.silver_products(bronze(spark, "crm_prd_info", data))
    assert [r.prd_end_dt for r in out.orderBy("prd_id").collect()] == [None, None]


def test_sales_dates_and_amounts(spark):
    base = ("SO1", "P1", 1, 20230101, 20230105, 20230110)
    cases = [
        (10, 2, 5),        # consistent
        (None, 2, 5),      # sales missing -> 10
        (0, 2, 5),         # sales 0 -> 10
        (-10, 2, 5),       # negative sales -> 10
        (11, 2, 5),        # inconsistent -> 10
        (10, 2, None),     # price missing: sales kept (unknown comparison), price 10 // 2
        (10, 2, 0),        # price 0: sales 0, price from raw sales
        (-10, 2, -5),      # both negative: sales 10, price -10 // 2 = -5 (residue the check reports)
        (10, 0, 5),        # quantity 0: sales 0, price kept
        (10, None, 5),     # quantity missing: comparison unknown, sales kept
        (None, 2, None),   # sales and price missing
        (7, 2, None),      # price derived with truncation: 7 // 2 = 3
    ]
    data = [base + c for c in cases]
    out = silver.silver_sales(bronze(spark, "crm_sales_details", data))
    assert columns(out.schema) == columns(SILVER["crm_sales_details"])
    got = [(r.sls_sales, r.sls_quantity, r.sls_price) for r in out.collect()]
    assert got == [
        (10, 2, 5), (10, 2, 5), (10, 2, 5), (10, 2, 5), (10, 2, 5),
        (10, 2, 5), (0, 2, 5), (10, 2, -5), (0, 0, 5), (10, None, 5),
        (None, 2, None), (7, 2, 3),
    ]


def test_sales_raw_dates(spark):
    dates = [20230115, 0, None, 20235, 202301151, 20231301]
    data = [("SO", "P", 1, d, d, d, 1, 1, 1) for d in dates]
    out = silver.silver_sales(bronze(spark, "crm_sales_details", data))
    assert [r.sls_order_dt for r in out.collect()] == [date(2023, 1, 15), None, None, None, None, None]


def test_erp_customers(spark, as_of="2024-06-30"):
    data = [
        ("NASAW1", date(1990, 1, 1), "F"),
        ("AW2", date(2024, 6, 29), "Female"),       # yesterday
        ("AW3", date(2024, 6, 30), " m"),           # today: kept
        ("AW4", date(2024, 7, 1), "MALE"),          # tomorrow: NULL
        ("AW5", None, ""),
        ("AW6", date(1950, 1, 1), None),
    ]
    out = silver.silver_erp_customers(bronze(spark, "erp_cust_az12", data), as_of)
    assert rows(out) == [
        ("AW1", date(1990, 1, 1), "Female"), ("AW2", date(2024, 6, 29), "Female"),
        ("AW3", date(2024, 6, 30), "Male"), ("AW4", None, "Male"), ("AW5", None, "n/a"),
        ("AW6", date(1950, 1, 1), "n/a"),
    ]


def test_locations(spark):
    data = [("AW-1", "DE"), ("AW-2", "US"), ("AW-3", "USA "), ("AW-4", " Australia "), ("AW-5", ""),
            ("AW-6", None), ("A-W-7", "  ")]
    out = silver.silver_locations(bronze(spark, "erp_loc_a101", data))
    assert rows(out) == [("AW1", "Germany"), ("AW2", "United States"), ("AW3", "United States"),
                         ("AW4", "Australia"), ("AW5", "n/a"), ("AW6", "n/a"), ("AW7", "n/a")]


def test_categories_copy(spark):
    data = [("AC_BR", "Accessories", "Bike Racks", "Yes"), ("CO_PD", "Components", "Pedals ", "No")]
    out = silver.silver_categories(bronze(spark, "erp_px_cat_g1v2", data))
    assert rows(out) == sorted(data)
