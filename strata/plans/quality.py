"""Data-quality checks for the three layers.

A check is a ``Rule``: a table, a condition of offending rows (or, for value profiles, an accepted
list), and the columns to show.  From the same rules come the queries -- one DataFrame of offending rows or values per
check, expected to be empty unless noted -- and ``summary``: one row per check, (layer, check,
kind, status, violations).  The summary compiles all rules of a table into one aggregate, so a table is read once whatever the number
of its rules, plus one grouping for each key that must be unique; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import as_of_date, has_outer_blanks
from strata.operators.joins import orphans
from strata.schemas import BRONZE, GOLD, SILVER, collated, with_audit
from strata.sources.tables import row_counts


# --- row counts (bronze / silver / gold) -----------------------------------------
def bronze_row_counts(wh) -> DataFrame:
    return row_counts({n: wh.bronze(n) for n in BRONZE}, "bronze")


def silver_row_counts(wh) -> DataFrame:
    return row_counts({n: wh.silver(n) for n in SILVER}, "silver")


def gold_row_counts(wh) -> DataFrame:
    frames = {"dim_customers": wh.dim_customers(), "dim_products": wh.dim_products(), "fact_sales": wh.fact_sales()}
    return row_counts(frames, "gold", label="view_name")


def structure_differences(actual: DataFrame, expected) -> list[str]:
    """Columns whose name, position or type differ from the declared schema."""
    a = [(f.name, f.dataType.simpleString()) for f in actual.schema.fields]
    e = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    return [f"{i}: {x} != {y}" for i, (x, y) in enumerate(zip(a, e), start=1) if x != y] + (
        [f"column count {len(a)} != {len(e)}"] if len(a) != len(e) else [])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """``SELECT TOP n *``: any n rows."""
    return df.limit(n)


# --- rules ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """One check of one table.

    ``where``: offending rows, given the warehouse.  ``values``: a violation is a distinct combination of the
    columns, not a row.  ``accepted``: the values a column may have; without ``where``, all others and NULL offend
    (a profile shows every value).  ``repeats``: a key that must not occur twice, and with ``null_key`` must not be NULL.
    """
    layer: str
    table: str
    columns: dict[str, str | Callable[[], Column]]  # shown as -> column
    where: Callable[..., Column] | None = None
    values: bool = False
    accepted: frozenset[str] | None = None
    repeats: bool = False
    null_key: bool = False
    order: tuple[str, ...] = ()
    query: Callable[..., DataFrame] | None = None  # a cheaper plan for the offending rows alone

    @property
    def kind(self) -> str:
        return "profile" if self.is_profile else "rule"

    @property
    def is_profile(self) -> bool:
        return self.where is None and not self.repeats


def _shown(rule: Rule) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c()).alias(name) for name, c in rule.columns.items()]


def _source(wh, rule: Rule, all_columns: bool = False) -> DataFrame:
    """The table of a rule; the fact with the keys only where they are needed."""
    if (rule.layer, rule.table) == ("gold", "fact_sales"):
        keys = all_columns or any(c in ("customer_key", "product_key") for c in rule.columns.values())
        return wh.star(product_key=keys, customer_key=keys)
    if rule.layer == "gold":
        return wh.store.read("gold", rule.table)
    return (wh.silver if rule.layer == "silver" else wh.bronze)(rule.table)


def offending(wh, rule: Rule) -> DataFrame:
    """Offending rows or values of one rule; all values for a profile."""
    if rule.query is not None:
        return rule.query(wh)
    df = _source(wh, rule)
    if rule.repeats:
        (column,) = rule.columns.values()
        repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("duplicate_count"))
        return repeated.filter(_repeated(rule, column))
    out = df.filter(rule.where(wh)) if rule.where is not None else df
    out = out.select(*_shown(rule))
    out = out.distinct() if rule.values or rule.is_profile else out
    return out.orderBy(*rule.order) if rule.order else out


def _repeated(rule: Rule, column: str) -> Column:
    twice = F.col("duplicate_count") > 1
    return twice | F.col(column).isNull() if rule.null_key else twice


def _blank(*columns: str):
    """Values with blanks at either end."""
    def where(wh) -> Column:
        first, *more = (has_outer_blanks(c, getattr(wh, "source_collation", False)) for c in columns)
        for m in more:
            first = first | m
        return first
    return where


def _same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


def _raw_due_date(wh) -> Column:
    """Raw due dates that are not plausible YYYYMMDD values."""
    due = F.col("sls_due_dt")
    return (due <= 0) | (F.length(due.cast("string")) != 8) | (due > 20500101) | (due < 19000101)


def _sales_rule(wh) -> Column:
    sales, qty, price = F.col("sls_sales"), F.col("sls_quantity"), F.col("sls_price")
    return ((sales != qty * price) | sales.isNull() | (sales <= 0) | qty.isNull() | (qty <= 0)
            | price.isNull() | (price <= 0))


OLDEST_BIRTHDATE = "1924-01-01"


def _birthdate(wh) -> Column:
    return (F.col("bdate") < F.lit(OLDEST_BIRTHDATE).cast("date")) | (F.col("bdate") > as_of_date(wh.as_of))


def _bad_measure(wh) -> Column:
    bad = F.lit(False)
    for c in ("sales_amount", "quantity", "price"):
        bad = bad | F.col(c).isNull() | (F.col(c) <= 0)
    return bad


def _fact_without(dim: str, fact_key: str, dim_key: str, out: str, fan_out: str):
    """Fact lines whose dimension row is missing.  Fact keys are
    looked up from the stored dimension, so a line is orphaned exactly when
    its natural key has no dimension row (or is NULL): one anti join on the
    natural key, instead of a key lookup followed by an anti join."""
    def query(wh) -> DataFrame:
        lines = wh.lines(fan_out=(fan_out,)).withColumnRenamed(fact_key, dim_key)
        found = orphans(lines, wh.store.read("gold", dim), dim_key, wh.size(f"gold.{dim}"), wh.max_broadcast_bytes)
        return found.select("order_number", F.lit(None).cast("long").alias(out))
    return query


# The accepted value lists of the profile checks.
_GENDERS = frozenset({"Male", "Female", "n/a"})
_MARITAL = frozenset({"Married", "Single", "n/a"})
_LINES = frozenset({"Mountain", "Road", "Other Sales", "Touring", "n/a"})
_YES_NO = frozenset({"Yes", "No"})

RULES: dict[str, Rule] = {
    # CRM customers
    "qs1_customer_id_dupes": Rule("silver", "crm_cust_info", _same("cst_id"), repeats=True, null_key=True),
    "qs2_customer_key_blanks": Rule("silver", "crm_cust_info", _same("cst_key"), _blank("cst_key")),
    "qs3_name_blanks": Rule("silver", "crm_cust_info", _same("cst_firstname", "cst_lastname"), _blank("cst_firstname", "cst_lastname")),
    "qs4_gender_values": Rule("silver", "crm_cust_info", {"gender_values": "cst_gndr"}, accepted=_GENDERS),
    "qs5_marital_values": Rule("silver", "crm_cust_info", {"marital_status_values": "cst_marital_status"}, accepted=_MARITAL),
    # CRM products
    "qs6_product_id_dupes": Rule("silver", "crm_prd_info", _same("prd_id"), repeats=True, null_key=True),
    "qs7_product_name_blanks": Rule("silver", "crm_prd_info", _same("prd_nm"), _blank("prd_nm")),
    "qs8_product_cost": Rule("silver", "crm_prd_info", _same("prd_id", "prd_cost"), lambda wh: (F.col("prd_cost") < 0) | F.col("prd_cost").isNull()),
    "qs9_product_lines": Rule("silver", "crm_prd_info", {"product_line_values": "prd_line"}, accepted=_LINES),
    "qs10_product_dates": Rule("silver", "crm_prd_info", _same("prd_id", "prd_key", "prd_start_dt", "prd_end_dt"), lambda wh: F.col("prd_end_dt") < F.col("prd_start_dt")),
    # sales; the raw due date is that of bronze
    "qs11_raw_due_dates": Rule("bronze", "crm_sales_details", {"sls_due_dt": lambda: F.nullif(F.col("sls_due_dt"), F.lit(0))}, _raw_due_date),
    "qs12_sales_date_order": Rule("silver", "crm_sales_details", _same("sls_ord_num", "sls_order_dt", "sls_ship_dt", "sls_due_dt"),
                                  lambda wh: (F.col("sls_order_dt") > F.col("sls_ship_dt")) | (F.col("sls_order_dt") > F.col("sls_due_dt"))),
    "qs13_sales_rule": Rule("silver", "crm_sales_details", _same("sls_sales", "sls_quantity", "sls_price"), _sales_rule, values=True, order=("sls_sales", "sls_quantity", "sls_price")),
    # ERP
    "qs14_birthdates": Rule("silver", "erp_cust_az12", _same("bdate"), _birthdate, values=True),
    "qs15_erp_gender_values": Rule("silver", "erp_cust_az12", {"gender_values": "gen"}, accepted=_GENDERS),
    "qs16_country_values": Rule("silver", "erp_loc_a101", {"country_values": "cntry"}, order=("country_values",)),
    "qs17_category_blanks": Rule("silver", "erp_px_cat_g1v2", _same("id", "cat", "subcat", "maintenance"), _blank("cat", "subcat", "maintenance")),
    "qs18_maintenance_values": Rule("silver", "erp_px_cat_g1v2", {"maintenance_values": "maintenance"}, accepted=_YES_NO),
    # gold
    "qg1_fact_without_customer": Rule("gold", "fact_sales", _same("order_number", "customer_key"), lambda wh: F.col("customer_key").isNull(),
                                      query=_fact_without("dim_customers", "sls_cust_id", "customer_id", "customer_key", "product")),
    "qg2_fact_without_product": Rule("gold", "fact_sales", _same("order_number", "product_key"), lambda wh: F.col("product_key").isNull(),
                                     query=_fact_without("dim_products", "sls_prd_key", "product_number", "product_key", "customer")),
    "qg3_customer_key_dupes": Rule("gold", "dim_customers", _same("customer_key"), repeats=True),
    "qg4_gender_values": Rule("gold", "dim_customers", {"gender_values": "gender"}, accepted=_GENDERS),
    "qg5_country_values": Rule("gold", "dim_customers", {"country_values": "country"}),
    "qg6_product_key_dupes": Rule("gold", "dim_products", _same("product_key"), repeats=True),
    "qg7_missing_start_date": Rule("gold", "dim_products", _same("product_id", "product_number", "start_date"), lambda wh: F.col("start_date").isNull()),
    "qg8_missing_category": Rule("gold", "dim_products", _same("product_id", "product_number", "category_id", "category"), lambda wh: F.col("category").isNull()),
    "qg9_null_fact_keys": Rule("gold", "fact_sales", _same("order_number", "customer_key", "product_key"), lambda wh: F.col("customer_key").isNull() | F.col("product_key").isNull()),
    "qg10_bad_measures": Rule("gold", "fact_sales", _same("order_number", "sales_amount", "quantity", "price"), _bad_measure),
    "qg11_date_order": Rule("gold", "fact_sales", _same("order_number", "order_date", "shipping_date", "due_date"),
                            lambda wh: (F.col("shipping_date") < F.col("order_date")) | (F.col("due_date") < F.col("order_date"))),
    # added to the source's checks: natural keys the fact joins on must be unique, or fact lines multiply
    "qg12_customer_id_dupes": Rule("gold", "dim_customers", _same("customer_id"), repeats=True),
    "qg13_product_number_dupes": Rule("gold", "dim_products", _same("product_number"), repeats=True),
}

ACCEPTED = {name: set(r.accepted) for name, r in RULES.items() if r.accepted}
# Country profiles have no closed list; they are reported, not judged.
PROFILE_ONLY = {name for name, r in RULES.items() if r.is_profile and not r.accepted}


def _query(rule: Rule) -> Callable[..., DataFrame]:
    return lambda wh: offending(wh, rule)


CHECKS: dict[str, tuple[str, Callable]] = {name: ("silver" if name.startswith("qs") else "gold", _query(r)) for name, r in RULES.items()}


# --- the summary ----------------------------------------------------------------------
def _violation(wh, rule: Rule) -> Column:
    """What a row violates: TRUE for a row rule; the combination of values where those count; else NULL."""
    if rule.is_profile:
        (column,) = _shown(rule)
        value = F.struct(column)
        return value if rule.accepted is None else F.when(column.isNull() | ~column.isin(sorted(rule.accepted)), value)
    return F.when(rule.where(wh), F.struct(*_shown(rule)) if rule.values else F.lit(True))


def _table_counts(wh, layer: str, table: str, rules: dict[str, Rule]) -> DataFrame:
    """One row: the rows of a table and the violations of each of its rules, from one pass over it.

    Rows are first grouped by the combinations that violate a rule of values -- few, as conforming rows have none -- with
    the row rules added up; the distinct combinations of each rule are counted on the groups."""
    df = _source(wh, Rule(layer, table, {}), all_columns=True)
    by_value = {n: r for n, r in rules.items() if r.values or r.is_profile}
    by_row = {n: r for n, r in rules.items() if n not in by_value}
    sums = [F.count(F.lit(1)).alias("rows"), *(F.count(_violation(wh, r)).alias(n) for n, r in by_row.items())]
    if not by_value:
        return df.agg(*sums)
    groups = df.groupBy(*(_violation(wh, r).alias(n) for n, r in by_value.items())).agg(*sums)
    return groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in by_row),
                      *(F.countDistinct(n).alias(n) for n in by_value))


def _verdicts(counts: DataFrame, columns: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row of counts -> one row per check.  ``columns``: (layer, check, kind, count)."""
    stacked = ", ".join(f"'{layer}', '{check}', '{kind}', CAST(`{n}` AS BIGINT)" for layer, check, kind, n in columns)
    rows = counts.selectExpr(f"stack({len(columns)}, {stacked}) AS (layer, check, kind, violations)")
    status = F.when(F.col("check").isin(sorted(PROFILE_ONLY)), "info").when(F.col("violations") == 0, "ok").otherwise("failed")
    return rows.select("layer", "check", "kind", status.alias("status"), "violations")


def summary(wh) -> DataFrame:
    """One row per check: (layer, check, kind, status, violations).

    A single lazy plan -- one aggregate per table and one per unique key, unioned -- so Spark
    schedules all of it in one job graph.  Structure checks compare
    declared and actual schemas (metadata, no data is read).
    """
    out = wh.spark.createDataFrame(_structure(wh), "layer string, check string, kind string, status string, violations long")
    tables = [("bronze", n) for n in BRONZE] + [("silver", n) for n in SILVER] + [("gold", n) for n in ("dim_customers", "dim_products", "fact_sales")]
    for layer, table in tables:
        rules = {n: r for n, r in RULES.items() if (r.layer, r.table) == (layer, table)}
        plain = {n: r for n, r in rules.items() if not r.repeats}
        counts = _table_counts(wh, layer, table, plain).withColumn("empty", (F.col("rows") == 0).cast("int"))
        out = out.unionByName(_verdicts(counts, [(layer, f"row_count:{layer}.{table}", "rule", "empty"), *((CHECKS[n][0], n, r.kind, n) for n, r in plain.items())]))
        for n, r in rules.items():
            if r.repeats:
                out = out.unionByName(_verdicts(offending(wh, r).agg(F.count(F.lit(1)).alias(n)), [(CHECKS[n][0], n, r.kind, n)]))
    return out


def _structure(wh) -> list[tuple]:
    from strata.functions import SOURCE_COLLATION

    collation = SOURCE_COLLATION if wh.source_collation else None
    expected = [("bronze", BRONZE, wh.bronze, lambda s: s),
                ("silver", SILVER, lambda n: wh.store.read("silver", n), lambda s: with_audit(collated(s, collation))),
                ("gold", {n: GOLD[n] for n in ("dim_customers", "dim_products", "fact_sales")}, lambda n: wh.store.read("gold", n), lambda s: collated(s, collation))]
    rows = []
    for layer, schemas, frame, declared in expected:
        for n, schema in schemas.items():
            diffs = structure_differences(frame(n), declared(schema))
            rows.append((layer, f"structure:{layer}.{n}", "structure", "ok" if not diffs else "failed", len(diffs)))
    return rows
