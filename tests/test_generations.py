"""Reloads beside the old rows: generations, one pointer, pinned readers; what a load measures."""

import gzip
import threading
from datetime import date, datetime, timedelta, timezone
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans import quality
from strata.plans.jobs import LoadError, _run, load_bronze, load_silver, rejects
from strata.plans.warehouse import Warehouse
from strata.schemas import BRONZE, SILVER, SOURCE_FILES
from strata.sources import csv_bronze
from strata.sources.csv_bronze import write_extracts
from strata.sources.standin import standin_bronze
from strata.sources.tables import LayerStore

from .conftest import columns, rows
from .test_sources_and_jobs import EXTRACTS
from .test_sources_and_jobs import write_extracts as write_lines

SF = "/root/testdata/sf0.001"


def locations(spark, n):
    return spark.createDataFrame([(f"AW{i}", "Germany") for i in range(n)], "cid string, cntry string")


@F.udf(T.StringType())
def broken(x):
    raise RuntimeError("executor lost")


def test_failed_load_leaves_the_old_rows(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    good = {"erp_loc_a101": lambda: locations(spark, 3), "erp_px_cat_g1v2": lambda: spark.createDataFrame([("A", "b", "c", "Yes")], SILVER["erp_px_cat_g1v2"])}
    _run(spark, "silver", good, store, parallel=True)
    bad = {"erp_loc_a101": lambda: locations(spark, 9), "erp_px_cat_g1v2": lambda: spark.createDataFrame([("A", "b", "c", "Yes")], SILVER["erp_px_cat_g1v2"]).withColumn("id", broken("id"))}
    before = store.manifests.number
    with pytest.raises(LoadError) as err:
        _run(spark, "silver", bad, store, parallel=True)
    assert {m[1]: m[5] for m in err.value.metrics} == {"erp_loc_a101": "ok", "erp_px_cat_g1v2": "failed", "(batch)": "failed"}
    # neither table moved, here or for somebody who opens the warehouse now
    for s in (store, LayerStore(spark, str(tmp_path))):
        assert s.read("silver", "erp_loc_a101").count() == s.rows("silver", "erp_loc_a101") == 3 and s.manifests.number == before
        assert s.read("silver", "erp_px_cat_g1v2").count() == 1
    assert store.clean() == []  # the folders nobody named may be another load's
    assert len(store.clean(grace_seconds=0)) >= 1
    assert store.read("silver", "erp_loc_a101").count() == 3


def test_readers_keep_their_generation_during_a_reload(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.write("silver", "erp_loc_a101", locations(spark, 5))
    reader = LayerStore(spark, str(tmp_path))
    held = reader.read("silver", "erp_loc_a101")
    seen, stop = set(), threading.Event()

    def look():
        while not stop.is_set():
            seen.add(held.count())

    t = threading.Thread(target=look)
    t.start()
    try:
        for n in (6, 7):
            store.write("silver", "erp_loc_a101", locations(spark, n))
        assert reader.read("silver", "erp_loc_a101").count() == 5  # pinned
    finally:
        stop.set()
        t.join()
    assert seen == {5}
    reader.refresh()
    assert reader.read("silver", "erp_loc_a101").count() == 7
    assert len(store.clean(keep=2)) == 1 and len(store.clean(keep=1)) == 1 and store.clean(keep=1) == []
    assert LayerStore(spark, str(tmp_path)).read("silver", "erp_loc_a101").count() == 7


def test_a_half_written_manifest_is_passed_over(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.write("silver", "erp_loc_a101", locations(spark, 4))
    number = store.manifests.number
    (tmp_path / "_manifests" / f"{number + 1:012d}.json").write_text('{"silver.erp_loc_a101": {"fol')  # a writer died
    again = LayerStore(spark, str(tmp_path))
    assert again.rows("silver", "erp_loc_a101") == 4
    again.write("silver", "erp_loc_a101", locations(spark, 8))
    store.refresh()
    assert store.rows("silver", "erp_loc_a101") == 8 and store.manifests.number == number + 2


def test_two_writers_keep_each_others_tables(spark, tmp_path):
    one, two = LayerStore(spark, str(tmp_path)), LayerStore(spark, str(tmp_path))
    one.write("silver", "erp_loc_a101", locations(spark, 2))
    two.write("silver", "erp_px_cat_g1v2", spark.createDataFrame([], SILVER["erp_px_cat_g1v2"]))
    assert two.stored == LayerStore(spark, str(tmp_path)).stored == {("silver", "erp_loc_a101"), ("silver", "erp_px_cat_g1v2")}
    assert not one.manifests.files.create(one.manifests._path(1), "{}")  # a number is taken once


def test_catalog_tables_move_without_a_gap(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path), catalog_prefix="gen_")
    store.write("silver", "erp_loc_a101", locations(spark, 2))
    table = spark.table("gen_silver.erp_loc_a101")
    assert table.count() == 2
    store.write("silver", "erp_loc_a101", locations(spark, 3))
    assert spark.table("gen_silver.erp_loc_a101").count() == 3 and table.count() == 2


def test_a_write_measures_what_it_stores(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    rnd = [(f"c{i}", "é" if i % 2 else None, None if i % 4 == 0 else 7 if i % 4 == 1 else i) for i in range(100)]
    made = store.write("silver", "erp_loc_a101", spark.createDataFrame(rnd, "cid string, cntry string, n int"), heavy="n", count=F.col("cntry").isNull())
    assert made.rows == 100 and made.column_bytes == {"cid": 190 + 100, "cntry": 100, "n": 400} and made.heaviest == 26 and made.counted == 50
    assert store.size("silver", "erp_loc_a101").of(["n"]) == 400 + 40 * 100
    empty = store.write("silver", "erp_loc_a101", spark.createDataFrame([], "cid string, n int"), heavy="n")
    assert (empty.rows, empty.column_bytes, empty.heaviest) == (0, {"cid": 0, "n": 0}, 0)


def test_transforms_are_evaluated_once(spark, tmp_path):
    """Rows, sizes and skew come from the write's own tasks: each input row passes the transform once."""
    passed = spark.sparkContext.accumulator(0)

    @F.udf(T.IntegerType())
    def counted(x):
        passed.add(1)
        return x

    src = spark.range(200).select(
        F.concat(F.lit("SO"), F.col("id").cast("string")).alias("sls_ord_num"), F.lit("P").alias("sls_prd_key"), counted(F.col("id").cast("int")).alias("sls_cust_id"),
        *(F.lit(20200101).alias(c) for c in ("sls_order_dt", "sls_ship_dt", "sls_due_dt")), *(F.lit(1).alias(c) for c in ("sls_sales", "sls_quantity", "sls_price")))
    bronze = {n: spark.createDataFrame([], s) for n, s in BRONZE.items()} | {"crm_sales_details": src}
    store = LayerStore(spark, str(tmp_path), catalog_prefix="once_")
    wh = Warehouse(spark, store)
    wh.max_broadcast_bytes = -1  # buckets wanted, so skew is measured and the table laid out again
    metrics = {r.table_name: r for r in load_silver(spark, store, bronze=bronze, layout=wh.layout).collect()}
    assert metrics["crm_sales_details"].rows == 200 and metrics["crm_sales_details"].layout.startswith("bucketed(")
    assert passed.value == 200
    assert store.read("silver", "crm_sales_details").count() == 200


def test_one_load_stamp_for_a_batch(spark, tmp_path):
    src = write_lines(str(tmp_path / "src"))
    store = LayerStore(spark, str(tmp_path / "wh"))
    load_bronze(spark, src, store)
    start = datetime.now(timezone.utc)
    load_silver(spark, store, as_of="2025-12-01")
    stamps = {s for n in SILVER for (s,) in store.read("silver", n).select(F.unix_micros("dwh_create_date")).distinct().collect()}
    assert len(stamps) == 1
    stamp = datetime.fromtimestamp(stamps.pop() / 1e6, timezone.utc)
    assert start <= stamp <= start + timedelta(minutes=5)


def test_bad_rows_are_kept_counted_and_listed_in_one_parse(spark, tmp_path):
    extracts = dict(EXTRACTS)
    extracts["crm_sales_details"] = EXTRACTS["crm_sales_details"] + ["SO1,P,notanumber,1,1,1,1,1,1", "SO2,P,1,1,1,1,1,1,x"]
    src = write_lines(str(tmp_path / "src"), extracts)
    store = LayerStore(spark, str(tmp_path / "wh"))
    metrics = {r.table_name: r for r in load_bronze(spark, src, store, on_bad_rows="null").collect()}
    assert metrics["crm_sales_details"].bad_rows == 2 and metrics["(batch)"].bad_rows == 2
    table = store.read("bronze", "crm_sales_details")
    assert columns(table.schema) == columns(BRONZE["crm_sales_details"]) and table.count() == 5
    listed = {r.sls_ord_num: r._corrupt_record for r in rejects(store, "crm_sales_details").collect()}
    assert listed == {"SO1": "SO1,P,notanumber,1,1,1,1,1,1", "SO2": "SO2,P,1,1,1,1,1,1,x"}
    assert rejects(store, "crm_cust_info").count() == 0
    load_bronze(spark, write_lines(str(tmp_path / "good")), store)
    assert rejects(store, "crm_sales_details").count() == 0  # a strict load keeps no texts


def test_standin_survives_the_extract_format(spark, tmp_path):
    """The driver path lands CSV extracts: every value comes back, an empty text as NULL."""
    frames = standin_bronze(spark, SF)
    write_extracts(frames, str(tmp_path / "src"))
    store = LayerStore(spark, str(tmp_path / "wh"))
    load_bronze(spark, str(tmp_path / "src"), store)
    for name, schema in BRONZE.items():
        want = frames[name].select([F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else f.name for f in schema.fields])
        got = store.read("bronze", name)
        assert columns(got.schema) == columns(schema)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_line_items_are_exchanged_once(spark):
    """Their join with the orders spreads them, whatever the size of the orders; a round robin before it moved them twice."""
    spread = standin_bronze(spark, SF, spread=True)["crm_sales_details"]
    plan = spread._jdf.queryExecution().sparkPlan().toString() + spread._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "REPARTITION" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders
    plain = standin_bronze(spark, SF)["crm_sales_details"]
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


def test_extract_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    """One task reads a compressed file, so no file grows with the extract."""
    monkeypatch.setattr(csv_bronze, "ROWS_PER_FILE", 10, raising=False)
    bronze = standin_bronze(spark, SF)["crm_cust_info"].coalesce(1)
    write_extracts({"crm_cust_info": bronze}, str(tmp_path))
    files = list((tmp_path / SOURCE_FILES["crm_cust_info"]).glob("part-*"))
    held = [len(gzip.decompress(f.read_bytes()).split(b"\r\n")) - 2 for f in files]  # less the header and the end
    assert max(held) == 10 and sum(held) == bronze.count()


def test_stored_tables_take_the_stronger_codec(spark, tmp_path):
    """Plain and bucketed tables alike."""
    store = LayerStore(spark, str(tmp_path / "wh"), catalog_prefix="codec_")
    df = spark.range(100).select(F.col("id").cast("int").alias("cst_id"))
    for buckets in (None, (2, "cst_id")):
        store.write("silver", "crm_cust_info", df, buckets)
        files = list(Path(store.path("silver", "crm_cust_info")).glob("part-*"))
        assert files and all(".zstd." in f.name for f in files)
        assert store.read("silver", "crm_cust_info").exceptAll(df).count() == 0


def test_rules_that_loads_guarantee_find_violations(spark):
    """Checks that are empty on any loaded warehouse, on frames that break them."""
    frames = {
        ("silver", "crm_cust_info"): spark.createDataFrame([(1, "A", " Jo", "X"), (1, "B", "Jo", "X "), (None, "C", None, None), (2, "D", "Al", "Y")],
                                                           "cst_id int, cst_key string, cst_firstname string, cst_lastname string"),
        ("gold", "dim_customers"): spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, None)], "customer_key long, customer_id int"),
        ("gold", "dim_products"): spark.createDataFrame([(4, "P"), (4, "P"), (4, "Q")], "product_key long, product_number string"),
    }
    wh = SimpleNamespace(silver=lambda t: frames[("silver", t)], store=SimpleNamespace(read=lambda layer, t: frames[(layer, t)]), source_collation=False)
    found = lambda name: rows(quality.CHECKS[name][1](wh))
    assert found("qs1_customer_id_dupes") == [(None, 1), (1, 2)]
    assert found("qs3_name_blanks") == [(" Jo", "X"), ("Jo", "X ")]
    assert found("qg3_customer_key_dupes") == [(1, 2)] and found("qg6_product_key_dupes") == [(4, 3)]
    assert found("qg12_customer_id_dupes") == [(6, 2)] and found("qg13_product_number_dupes") == [("P", 2)]


def test_summary_counts_what_the_queries_show(spark, tmp_path):
    """Every count of the one-pass summary against the rows of the check's own query, values outside the lists included."""
    extracts = dict(EXTRACTS)
    extracts["crm_sales_details"] = EXTRACTS["crm_sales_details"] + ["SO9,NONE,5,20240110,20240105,20240101,7,0,", "SO9,NONE,5,20240110,20240105,20240101,7,0,", "SO8,NONE,5,20240110,20240105,99,8,2,3"]
    extracts["erp_cust_az12"] = EXTRACTS["erp_cust_az12"] + ["Z1,1901-01-01,X", "Z2,1901-01-01,", "Z3,1902-01-01,F"]
    extracts["erp_px_cat_g1v2"] = EXTRACTS["erp_px_cat_g1v2"] + ["QQ_QQ,Odd ,Sub,Maybe", "QR_QQ,Odd,Sub,", "QS_QQ,Odd,Sub,Maybe"]
    store = LayerStore(spark, str(tmp_path / "wh"))
    load_bronze(spark, write_lines(str(tmp_path / "src"), extracts), store)
    wh = Warehouse.build(spark, store=store, as_of="2025-12-01")
    found = {r.check: r for r in quality.summary(wh).collect()}
    for name, (_, query) in quality.CHECKS.items():
        shown = query(wh).collect()
        if name in quality.ACCEPTED:
            shown = [r for r in shown if r[0] not in quality.ACCEPTED[name]]
        assert found[name].violations == len(shown), name
        assert found[name].status == ("info" if name in quality.PROFILE_ONLY else "failed" if shown else "ok"), name
    assert found["qs18_maintenance_values"].violations == 2 and found["qs14_birthdates"].violations == 2 and found["qs13_sales_rule"].violations == 1


def test_mean_price_does_not_depend_on_the_order_of_lines(spark):
    from strata.plans.reports import report_products

    lines = [(f"O{i}", 1, 1, date(2025, 1, 1 + i % 20), [1, 7, 10, 3][i % 4], [3, 7, 9, 11][i % 4]) for i in range(2000)] + [("O", 1, 1, date(2025, 1, 1), 9, 0), ("O", 1, 1, date(2025, 1, 1), None, 5)]
    products = spark.createDataFrame([(1, "A", "c", "s", 1)], "product_key long, product_name string, category string, subcategory string, cost int")
    schema = "order_number string, product_key long, customer_key long, order_date date, sales_amount int, quantity int"
    seen = {report_products(spark.createDataFrame(some, schema).repartition(n), products, "2025-06-30").first().avg_selling_price
            for n, some in ((1, lines), (7, lines), (5, lines[::-1]))}
    assert seen == {0.7}  # (1/3 + 1 + 10/9 + 3/11) / 4 = 0.679...
