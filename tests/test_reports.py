"""Reporting views: segment edges, age bands, tiers and ratio guards."""

from datetime import date

from strata.plans.analytics import n3_yoy_products
from strata.plans.reports import CustomerThresholds, report_customers, report_products

AS_OF = "2025-06-30"


def _facts(spark, data):
    return spark.createDataFrame(
        data, "order_number string, product_key long, customer_key long, order_date date, sales_amount int, quantity int")


def _customers(spark, data):
    return spark.createDataFrame(
        data, "customer_key long, customer_number string, first_name string, last_name string, birthdate date")


def test_customer_segments_ages_and_ratios(spark):
    facts = _facts(spark, [
        # key 1: lifespan 12 months, spend 5001 -> VIP
        ("O1", 1, 1, date(2024, 1, 31), 2500, 1), ("O2", 2, 1, date(2025, 1, 1), 2501, 2),
        # key 2: lifespan 12, spend 5000 -> Regular
        ("O3", 1, 2, date(2024, 1, 1), 5000, 1), ("O4", 1, 2, date(2025, 1, 31), 0, 1),
        # key 3: lifespan 11 -> New; same order twice counts once
        ("O5", 1, 3, date(2024, 2, 1), 9000, 1), ("O5", 2, 3, date(2024, 12, 31), 1000, 1),
        # key 4: single day -> lifespan 0, monthly spend = total
        ("O6", 1, 4, date(2025, 6, 1), 700, 7),
        # no customer, and an undated line (excluded)
        ("O7", 1, None, date(2025, 1, 1), 40, 1), ("O8", 1, 4, None, 99, 1),
    ])
    customers = _customers(spark, [
        (1, "AW1", "Ann", "Lee", date(2006, 1, 1)),   # 19
        (2, "AW2", "Bo", None, date(2005, 12, 31)),   # 20
        (3, "AW3", None, "Ek", date(1975, 6, 1)),     # 50
        (4, "AW4", "Di", "Fo", None),                 # NULL age -> last band
    ])
    out = {r.customer_key: r for r in report_customers(facts, customers, AS_OF).collect()}
    assert (out[1].customer_segment, out[1].lifespan, out[1].total_orders, out[1].total_products) == ("VIP", 12, 2, 2)
    assert (out[1].age, out[1].age_group, out[1].avg_order_value, out[1].avg_monthly_spend) == (19, "Under 20", 2500, 416)
    assert (out[2].customer_segment, out[2].age_group, out[2].customer_name) == ("Regular", "20-29", "Bo ")
    assert (out[3].customer_segment, out[3].lifespan, out[3].total_orders, out[3].age_group) == ("New", 10, 1, "50 and above")
    assert out[3].customer_name == " Ek"
    assert (out[4].lifespan, out[4].avg_monthly_spend, out[4].age, out[4].age_group) == (0, 700, None, "50 and above")
    assert (out[4].recency, out[4].last_order_date) == (0, date(2025, 6, 1))
    assert (out[None].customer_name, out[None].customer_number, out[None].total_sales) == (" ", None, 40)


def test_product_tiers_and_selling_price(spark):
    facts = _facts(spark, [
        ("O1", 1, 1, date(2025, 1, 1), 50001, 1),
        ("O2", 2, 1, date(2025, 1, 1), 50000, 2),
        ("O3", 3, 1, date(2025, 1, 1), 10000, 0),   # quantity 0: ignored in the price mean
        ("O4", 3, 2, date(2025, 2, 1), 1, 1),
        ("O5", 4, 1, date(2025, 1, 1), 9999, 3),
    ])
    products = spark.createDataFrame(
        [(1, "A", "c", "s", 1), (2, "B", "c", "s", 2), (3, "C", "c", "s", 3), (4, "D", "c", "s", 4)],
        "product_key long, product_name string, category string, subcategory string, cost int")
    out = {r.product_key: r for r in report_products(facts, products, AS_OF).collect()}
    assert [out[k].product_segment for k in (1, 2, 3, 4)] == ["High-Performer", "Mid-Range", "Mid-Range", "Low-Performer"]
    assert out[3].avg_selling_price == 1.0 and out[3].total_customers == 2 and out[3].lifespan == 1
    assert out[2].avg_selling_price == 25000.0
    assert out[4].avg_monthly_revenue == 9999 and out[4].avg_order_revenue == 9999


def test_age_band_edges_and_unknown_age_flag(spark):
    ages = {11: 29, 12: 30, 13: 49, 14: 50, 15: 20, 16: 19, 17: None}
    facts = _facts(spark, [(f"O{k}", 1, k, date(2025, 1, 1), 1, 1) for k in ages])
    customers = _customers(spark, [(k, f"AW{k}", "A", "B", None if a is None else date(2025 - a, 3, 3))
                                   for k, a in ages.items()])
    out = {r.customer_key: (r.age, r.age_group) for r in report_customers(facts, customers, AS_OF).collect()}
    assert out == {11: (29, "20-29"), 12: (30, "30-39"), 13: (49, "40-49"), 14: (50, "50 and above"),
                   15: (20, "20-29"), 16: (19, "Under 20"), 17: (None, "50 and above")}
    flagged = report_customers(facts, customers, AS_OF, CustomerThresholds(unknown_age_label="n/a"))
    assert {r.customer_key: r.age_group for r in flagged.collect()}[17] == "n/a"


class _YearlyStub:
    """Stands in for the warehouse: hands n3 its yearly per-name sales."""

    def __init__(self, df):
        self.df = df

    def rollup_products(self, attrs, aggs, by=(), dated=False):
        return self.df


def test_year_over_year_first_gap_and_equal_years(spark):
    yearly = spark.createDataFrame(
        [(2020, "A", 100), (2022, "A", 100), (2023, "A", 40), (2021, "B", 7), (2021, None, 5)],
        "order_year int, product_name string, current_sales long")
    out = {(r.product_name, r.order_year): r for r in n3_yoy_products(_YearlyStub(yearly)).collect()}
    a20, a22, a23 = out[("A", 2020)], out[("A", 2022)], out[("A", 2023)]
    assert (a20.avg_sales, a20.diff_avg, a20.avg_change) == (80, 20, "Above Avg")      # 240 // 3
    assert (a20.py_sales, a20.diff_py, a20.py_change) == (None, None, "No Change")     # first year
    assert (a22.py_sales, a22.diff_py, a22.py_change) == (100, 0, "No Change")         # gap year, equal sales
    assert (a23.diff_py, a23.py_change, a23.avg_change) == (-60, "Decrease", "Below Avg")
    assert (out[("B", 2021)].avg_change, out[(None, 2021)].avg_sales) == ("Avg", 5)   # one year; NULL name kept
