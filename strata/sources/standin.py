"""Stand-in bronze: the six CRM/ERP extracts derived from the driver tables.

The warehouse normally lands six CSV files (see ``csv_bronze``).  For tests
and benchmarks the same six bronze frames are derived from the TPC-H-like
Parquet tables, with the kinds of dirt the silver layer exists to clean:
padded names, keys and categories, mixed-case codes, older duplicate versions, versions of one day, rows without an id or a start,
impossible dates, inconsistent amounts, prefixed and hyphenated ERP keys.

Each frame is one SQL statement written in the subset that Spark SQL and
DuckDB read the same way, so the DuckDB oracle starts from exactly the rows
Spark starts from.  In Spark the driver tables are passed as DataFrame
parameters (no global views are created); every statement scans whole
tables, so the bronze volume grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.schemas import BRONZE

DRIVER_TABLES = ("customer", "nation", "part", "orders", "lineitem")

# The extracts' ids are INT: ids of very large driver tables go round.
_ID_RANGE = 2_000_000_000
_CUST_ID = f"CAST((c_custkey + 11000) % {_ID_RANGE} AS INT)"
# Customer natural key: 'AW' + id padded to ten digits.
_CUST_DIGITS = "lpad(CAST(c_custkey + 11000 AS STRING), 10, '0')"
_CUST_KEY = f"'AW' || {_CUST_DIGITS}"

# Product natural key: two letters of the part type, the brand number, then
# 'P' + part key; the first five characters are the category id.
_CAT_CODE = "upper(substr(p_type, 1, 2)) || '-' || lpad(substr(p_brand, 7), 2, '0')"
_VERSIONS = "CASE p_partkey % 5 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END"


def _product_version(v: int) -> str:
    """Version ``v`` of each part's product.  Every part has version 0; the
    WHERE only decides which parts also get a newer version 1 (and 2), so
    parts end up with one, two or three versions and none is left out.  A few have lost their id, their cost or their start,
    cost less than nothing, start two versions on one day, or repeat a version whole."""
    where = {0: "", 1: "WHERE p_partkey % 5 IN (3, 4)", 2: "WHERE p_partkey % 5 = 4"}[v]
    # the second version of these starts with the first; the third is the second again
    start = {0: "CASE WHEN p_partkey % 85 = 10 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2011-07-01 00:00:00' END",
             1: "CASE WHEN p_partkey % 60 = 14 THEN TIMESTAMP '2011-07-01 00:00:00' ELSE TIMESTAMP '2012-07-01 00:00:00' END",
             2: "CASE WHEN p_partkey % 70 = 19 THEN TIMESTAMP '2012-07-01 00:00:00' ELSE TIMESTAMP '2013-07-01 00:00:00' END"}[v]
    like = "CASE WHEN p_partkey % 70 = 19 THEN 1 ELSE 2 END" if v == 2 else str(v)
    return f"""
SELECT CASE WHEN p_partkey % 95 = 8 THEN CAST(NULL AS INT) ELSE CAST((p_partkey * 3 + {like} + 1) % {_ID_RANGE} AS INT) END AS prd_id,
       {_CAT_CODE} || '-P' || CAST(p_partkey AS STRING) AS prd_key,
       CASE WHEN p_partkey % 250 = 9 THEN p_name || ' ' ELSE p_name END AS prd_nm,
       CASE WHEN p_partkey % 50 = 0 THEN CAST(NULL AS INT) WHEN p_partkey % 75 = 7 THEN -p_size
            ELSE CAST(p_size * 25 + 5 * ({like}) AS INT) END AS prd_cost,
       CASE p_size % 6 WHEN 0 THEN 'M ' WHEN 1 THEN 'R ' WHEN 2 THEN 'S ' WHEN 3 THEN 'T '
                       WHEN 4 THEN CAST(NULL AS STRING) ELSE 'x' END AS prd_line,
       {start} AS prd_start_dt,
       CASE WHEN {_VERSIONS} = {like} + 1 THEN CAST(NULL AS TIMESTAMP)
            ELSE TIMESTAMP '{2007 + v}-12-28 00:00:00' END AS prd_end_dt
FROM {{part}} {where}"""


def _int_date(d: str) -> str:
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS INT)"


STANDIN_SQL: dict[str, str] = {
    # Newest version of every customer, plus an older version of each (the
    # older copy of a few has lost its id).
    "crm_cust_info": f"""
SELECT {_CUST_ID} AS cst_id,
       CASE WHEN c_custkey % 61 = 9 THEN {_CUST_KEY} || ' ' ELSE {_CUST_KEY} END AS cst_key,
       CASE WHEN c_custkey % 7 = 3 THEN '  ' || substr(c_name, 1, 8) || ' ' ELSE substr(c_name, 1, 8) END AS cst_firstname,
       CASE WHEN c_custkey % 97 = 5 THEN CAST(NULL AS STRING)
            WHEN c_custkey % 11 = 4 THEN substr(c_name, 10) || '  ' ELSE substr(c_name, 10) END AS cst_lastname,
       CASE c_custkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'm ' WHEN 2 THEN 'M' ELSE CAST(NULL AS STRING) END AS cst_marital_status,
       CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN ' m' ELSE CAST(NULL AS STRING) END AS cst_gndr,
       DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS cst_create_date
FROM {{customer}}
UNION ALL
SELECT CASE WHEN c_custkey % 500 = 7 THEN CAST(NULL AS INT) ELSE {_CUST_ID} END,
       {_CUST_KEY},
       substr(c_name, 1, 8),
       substr(c_name, 10),
       'M',
       CAST(NULL AS STRING),
       DATE '2019-01-01' + CAST(c_custkey % 300 AS INT)
FROM {{customer}}""",
    "crm_prd_info": " UNION ALL ".join(_product_version(v) for v in range(3)),
    "crm_sales_details": f"""
SELECT 'SO' || CAST(l_orderkey AS STRING) AS sls_ord_num,
       CASE WHEN l_orderkey % 200 = 11 THEN 'X' ELSE 'P' END || CAST(l_partkey AS STRING) AS sls_prd_key,
       CASE WHEN l_orderkey % 300 = 17 THEN CAST(-1 - o_custkey % {_ID_RANGE} AS INT)
            ELSE CAST((o_custkey + 11000) % {_ID_RANGE} AS INT) END AS sls_cust_id,
       CASE l_orderkey % 100 WHEN 1 THEN 0
            WHEN 2 THEN CAST(year(od) * 10 + month(od) AS INT)
            ELSE {_int_date('od')} END AS sls_order_dt,
       CASE WHEN (l_orderkey + l_linenumber) % 150 = 4
            THEN CAST(year(sd) * 10000 + 1300 + day(sd) AS INT)
            ELSE {_int_date('sd')} END AS sls_ship_dt,
       CASE l_orderkey % 350 WHEN 33 THEN 0 WHEN 34 THEN CAST(year(dd) AS INT) WHEN 35 THEN 30000101
            ELSE {_int_date('dd')} END AS sls_due_dt,
       CASE (l_orderkey + 7 * l_linenumber) % 40 WHEN 6 THEN CAST(NULL AS INT) WHEN 7 THEN 0
            WHEN 8 THEN -(q * p0) WHEN 9 THEN q * p0 + 1 ELSE q * p0 END AS sls_sales,
       q AS sls_quantity,
       CASE (l_orderkey + 3 * l_linenumber) % 50 WHEN 3 THEN CAST(NULL AS INT) WHEN 4 THEN -p0
            WHEN 5 THEN 0 ELSE p0 END AS sls_price
FROM (
  SELECT l_orderkey, l_partkey, l_linenumber, o_custkey,
         CAST(o_orderdate AS DATE) AS od,
         CAST(l_shipdate AS DATE) AS sd,
         CAST(o_orderdate AS DATE) + 12 AS dd,
         CASE WHEN (l_orderkey + l_linenumber) % 97 = 5 THEN 0 ELSE CAST(floor(l_quantity) AS INT) END AS q,
         CAST(floor(l_extendedprice / l_quantity / 100) AS INT) AS p0
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
) s""",
    # ERP demographics: even customers carry a 'NAS' prefix; a few keys match
    # nothing; future, very old and missing birthdates; six gender spellings.
    "erp_cust_az12": f"""
SELECT CASE WHEN c_custkey % 50 = 13 THEN 'XX' || {_CUST_DIGITS}
            WHEN c_custkey % 2 = 0 THEN 'NAS' || {_CUST_KEY}
            ELSE {_CUST_KEY} END AS cid,
       CASE WHEN c_custkey % 250 = 17 THEN DATE '2999-01-01'
            WHEN c_custkey % 333 = 5 THEN DATE '1915-05-05'
            WHEN c_custkey % 113 = 1 THEN CAST(NULL AS DATE)
            ELSE DATE '1940-01-01' + CAST((c_custkey * 7919) % 20000 AS INT) END AS bdate,
       CASE c_custkey % 6 WHEN 0 THEN 'F' WHEN 1 THEN 'Female' WHEN 2 THEN ' m' WHEN 3 THEN 'MALE'
                          WHEN 4 THEN '' ELSE CAST(NULL AS STRING) END AS gen
FROM {{customer}}""",
    # ERP location: hyphenated key; country codes, blanks, NULLs, padded names.
    "erp_loc_a101": f"""
SELECT 'AW-' || {_CUST_DIGITS} AS cid,
       CASE (c_custkey + c_nationkey) % 8 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN 'USA '
            WHEN 3 THEN '' WHEN 4 THEN CAST(NULL AS STRING) ELSE ' ' || n_name || ' ' END AS cntry
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # ERP categories: one row per (type, brand) present in the part table.
    # The CRM codes 'ST-..' are published by the ERP as 'SD_..', so those
    # products find no category -- the mismatch the gold checks look for.
    "erp_px_cat_g1v2": """
SELECT DISTINCT
       CASE WHEN p_type = 'STANDARD' THEN 'SD' ELSE upper(substr(p_type, 1, 2)) END
         || '_' || lpad(substr(p_brand, 7), 2, '0') AS id,
       CASE WHEN p_brand = 'Brand#7' THEN p_type || ' ' ELSE p_type END AS cat,
       p_brand AS subcat,
       CASE WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 0 THEN 'No' ELSE 'Yes' END AS maintenance
FROM {part}""",
}


def standin_sql(name: str, table_ref=lambda t: t) -> str:
    """SQL text of one bronze frame with driver tables named by ``table_ref``."""
    return STANDIN_SQL[name].format(**{t: table_ref(t) for t in DRIVER_TABLES})


def read_driver_tables(spark: SparkSession, sf_dir: str, spread: bool = False) -> dict[str, DataFrame]:
    """The driver tables.  ``spread``: the line items leave the task that scans them (the driver writes each table as one
    Parquet row group, which Spark can only read in one task) by the exchange of their join with the orders, which is
    therefore a merge join at any size.  Line items move once: a round robin before the join would move them a second
    time, after a sort of all rows of the scanning task."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER_TABLES}
    if spread:
        tables["orders"] = tables["orders"].hint("merge")
    return tables


def standin_bronze(spark: SparkSession, sf_dir: str, spread: bool = False) -> dict[str, DataFrame]:
    """The six bronze frames (lazy) with the declared bronze schemas."""
    tables = read_driver_tables(spark, sf_dir, spread)
    out = {}
    for name, schema in BRONZE.items():
        df = spark.sql(standin_sql(name, lambda t: "{" + t + "}"), **tables)
        out[name] = df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    return out
