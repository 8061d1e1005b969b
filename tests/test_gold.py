"""Gold dimensions, dense keys and the star lookups."""

import random
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators.keys import dense_key
from strata.plans import gold
from strata.schemas import SILVER

from .conftest import rows


def _global_row_number(df, order):
    return df.withColumn("expected", F.row_number().over(Window.orderBy(*order)).cast("long"))


def test_dense_key_matches_global_row_number(spark):
    rnd = random.Random(7)
    data = [(rnd.choice([None, *range(40)]), f"k{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(data, "a int, b string")
    order = [F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first()]
    got = dense_key(df, order, "key", ranges=7)
    expected = _global_row_number(df, order)
    joined = got.join(expected, ["a", "b"])
    assert joined.filter("key != expected").count() == 0
    assert got.count() == 3000
    assert got.agg(F.min("key"), F.max("key"), F.countDistinct("key")).first() == (1, 3000, 3000)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 10**6)), min_size=1, max_size=60,
                unique_by=lambda t: t[1]))
def test_dense_key_property(spark, data):
    df = spark.createDataFrame(data, "a int, b long")
    order = [F.col("a").desc_nulls_last(), F.col("b").asc()]
    got = rows(dense_key(df, order, "key", ranges=3).select("b", "key"))
    exp = rows(_global_row_number(df, order).select("b", "expected"))
    assert got == exp


def _silver(spark, name, data):
    return spark.createDataFrame(data, SILVER[name])


def test_dim_customers_gender_priority_and_fanout(spark):
    cust = _silver(spark, "crm_cust_info", [
        (3, "AW3", "C", "Z", "Single", "Female", date(2020, 1, 1)),   # CRM gender known
        (1, "AW1", "A", "X", "Married", "n/a", date(2020, 1, 1)),     # ERP fallback
        (2, "AW2", "B", "Y", "n/a", "n/a", date(2020, 1, 1)),         # no ERP row
        (4, "AW4", "D", "W", "n/a", "n/a", date(2020, 1, 1)),         # ERP key duplicated
    ])
    erp = _silver(spark, "erp_cust_az12", [
        ("AW1", date(1980, 5, 5), "Male"), ("AW3", date(1990, 1, 1), "Male"),
        ("AW4", date(1970, 1, 1), "Female"), ("AW4", date(1971, 1, 1), "n/a"),
    ])
    loc = _silver(spark, "erp_loc_a101", [("AW1", "Germany"), ("AW3", "France")])
    dim = gold.build_dim_customers(cust, erp, loc)
    got = rows(dim, "customer_key", "customer_id", "gender", "country", "birthdate")
    assert got == [
        (1, 1, "Male", "Germany", date(1980, 5, 5)),
        (2, 2, "n/a", None, None),
        (3, 3, "Female", "France", date(1990, 1, 1)),
        (4, 4, "Female", None, date(1970, 1, 1)),
        (5, 4, "n/a", None, date(1971, 1, 1)),
    ]


def test_dim_products_current_only_and_unmatched_category(spark):
    prd = _silver(spark, "crm_prd_info", [
        (1, "CO_RF", "FR-1", "Frame", 10, "Road", date(2011, 7, 1), date(2012, 6, 30)),  # expired
        (2, "CO_RF", "FR-1", "Frame", 12, "Road", date(2012, 7, 1), None),
        (3, "CO_PE", "PE-1", "Pedal", 5, "n/a", date(2011, 7, 1), None),                 # no category
        (4, "AC_HE", "HL-1", "Helmet", 7, "Other Sales", date(2011, 7, 1), None),
    ])
    cat = _silver(spark, "erp_px_cat_g1v2", [("CO_RF", "Components", "Road Frames", "Yes"),
                                              ("AC_HE", "Accessories", "Helmets", "Yes"),
                                              ("CO_PD", "Components", "Pedals", "No")])
    dim = gold.build_dim_products(prd, cat)
    got = rows(dim, "product_key", "product_id", "product_number", "category")
    # ordered by start date, then product number
    assert got == [(1, 4, "HL-1", "Accessories"), (2, 3, "PE-1", None), (3, 2, "FR-1", "Components")]


def test_star_equals_fact_join_dimension(spark):
    """Looking attributes up by natural key gives the rows of
    fact_sales LEFT JOIN dim ON surrogate key, including unmatched lines."""
    sales = _silver(spark, "crm_sales_details", [
        ("SO1", "P1", 1, date(2020, 1, 1), None, None, 10, 1, 10),
        ("SO2", "P2", 2, date(2020, 1, 2), None, None, 20, 2, 10),
        ("SO3", "ZZ", 9, date(2020, 1, 3), None, None, 30, 3, 10),
    ])
    prod = spark.createDataFrame([(1, "P1", "one"), (2, "P2", "two")],
                                 "product_key long, product_number string, product_name string")
    cust = spark.createDataFrame([(10, 1, "Ann"), (11, 2, "Bo")],
                                 "customer_key long, customer_id int, first_name string")
    starred = gold.star(sales, prod, cust, product=["product_name"], customer=["first_name"])
    fact = gold.star(sales, prod, cust, product_key=True, customer_key=True)
    via_keys = (fact.join(prod.select("product_key", "product_name"), "product_key", "left")
                .join(cust.select("customer_key", "first_name"), "customer_key", "left"))
    cols = ["order_number", "product_key", "customer_key", "product_name", "first_name"]
    assert rows(starred, *cols) == rows(via_keys, *cols)


def test_star_skips_unused_unique_dimension(spark):
    sales = _silver(spark, "crm_sales_details", [("SO1", "P1", 1, None, None, None, 1, 1, 1)])
    prod = spark.createDataFrame([(1, "P1")], "product_key long, product_number string")
    cust = spark.createDataFrame([(10, 1), (11, 1)], "customer_key long, customer_id int")
    # customers not proven unique: the join stays and fans out, as the view would
    assert gold.star(sales, prod, cust, products_unique=True).count() == 2
    # proven unique and unused: no join, same count
    assert gold.star(sales, prod, cust, products_unique=True, customers_unique=True).count() == 1


def test_next_start_matches_lead_with_ties_and_nulls(spark):
    from strata.operators.windows import next_start

    rnd = random.Random(3)
    data = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(6)])) for i in range(400)]
    df = spark.createDataFrame(data, "id int, k string, s int")
    got = dict(rows(next_start(df, "k", "s", "id", "nxt"), "id", "nxt"))
    w = Window.partitionBy("k").orderBy(F.col("s").asc_nulls_first(), "id")
    exp = dict(rows(df.withColumn("nxt", F.lead("s").over(w)), "id", "nxt"))
    assert got == exp


def test_next_start_with_equal_rows_and_null_ties(spark):
    from strata.operators.windows import next_start

    data = [(7, "a", 1, "x"), (7, "a", 1, "x"), (None, "a", 1, "x"), (7, "a", 1, "w"), (8, "a", 5, "x"), (8, "a", 5, "x"), (None, "b", None, "x")]
    df = spark.createDataFrame(data, "id int, k string, s int, name string")
    w = Window.partitionBy("k").orderBy(F.col("s").asc_nulls_first(), F.col("id").asc_nulls_first(), "name")
    cols = ["id", "k", "s", "name", "nxt"]
    assert rows(next_start(df, "k", "s", "id", "nxt"), *cols) == rows(df.withColumn("nxt", F.lead("s").over(w)), *cols)


def test_bucket_count_grows_with_the_table():
    from strata.operators.skew import bucket_count

    assert bucket_count(5000, 10, 4, 100_000, rows_per_bucket=100) == 50       # 5000 rows / 100
    assert bucket_count(5000, 10, 64, 100_000, rows_per_bucket=100) == 64      # never below the minimum
    assert bucket_count(5000, 10, 4, 40, rows_per_bucket=100) == 40            # nor above what Spark allows
    assert bucket_count(5000, 2500, 4, 100_000, rows_per_bucket=100) is None   # one key, half the rows
    assert bucket_count(0, 0, 4, 100_000) == 4


def test_dense_key_takes_one_exchange(spark):
    import contextlib
    import io

    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("v"))
    keyed = dense_key(df, [F.col("v")], "k", ranges=5)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        keyed.explain()
    # what is left after the range sort (a stored table) is the prefix sum of the ranges and its broadcast
    plan = buf.getvalue()
    assert "rangepartitioning" not in plan and "Window [row_number" not in plan and "BroadcastExchange" in plan
    assert "hashpartitioning(_range_id" in plan and plan.count("Exchange hashpartitioning") == 1
    assert keyed.filter("k != v + 1").count() == 0


def test_distinct_keys_by_words_equal_count_distinct(spark):
    from strata.operators.distinct import count_words, distinct_keys, key_words, merge_words

    rnd = random.Random(5)
    data = [(rnd.choice(["a", "b", None]), rnd.randrange(12), rnd.choice([None, rnd.randrange(1, 200), rnd.randrange(10**12, 10**12 + 70), -rnd.randrange(1, 99)])) for _ in range(4000)]
    data += [("only null", 1, None), ("hot", 1, 63), ("hot", 1, 64), ("hot", 2, 127), ("hot", 2, 128)]
    df = spark.createDataFrame(data, "g string, month int, k long")
    want = rows(df.groupBy("g").agg(F.countDistinct("k").alias("n")))
    assert rows(distinct_keys(df, ["g"], "k", "n")) == want
    words = key_words(df, ["g", "month"], "k", F.count(F.lit(1)).alias("lines"))
    months = count_words(words, ["g", "month"], "n", F.sum("lines").alias("lines"))
    assert rows(months) == rows(df.groupBy("g", "month").agg(F.countDistinct("k").alias("n"), F.count(F.lit(1)).alias("lines")))
    assert rows(count_words(merge_words(words, ["g"]), ["g"], "n")) == want  # months merged, no look at the rows
    assert distinct_keys(df, [], "k", "n").first().n == df.agg(F.countDistinct("k")).first()[0]
    assert distinct_keys(df.limit(0), [], "k", "n").first().n == 0


def test_dimensions_are_broadcast_by_their_bytes(spark):
    from strata.operators.joins import MAX_BROADCAST_BYTES, TableSize, fits, lookup

    narrow = TableSize(1_900_000, {"k": 8 * 1_900_000, "id": 4 * 1_900_000, "biography": 600 * 1_900_000})
    assert fits(narrow, ["k", "id"]) and not fits(narrow, ["k", "biography"]) and not fits(None, ["k"])
    assert narrow.of(["unknown"]) == (100 + 40) * 1_900_000
    fact, dim = spark.range(10).withColumnRenamed("id", "f"), spark.createDataFrame([(1, 2, "x")], "id long, k long, biography string")

    def hint(take):
        return "broadcast" in lookup(fact, dim, "f", "id", take, narrow, MAX_BROADCAST_BYTES)._jdf.queryExecution().logical().toString()

    assert hint(["k"]) and not hint(["k", "biography"])
