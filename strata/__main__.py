"""Command line: run the warehouse the way the source's scripts are run.

    python -m strata build --source LANDING --root WAREHOUSE [--as-of YYYY-MM-DD] [--catalog-prefix P]
    python -m strata check --root WAREHOUSE [--as-of YYYY-MM-DD]
    python -m strata query NAME --root WAREHOUSE [--as-of YYYY-MM-DD] [--rows N]
    python -m strata list

``build`` lands the six extracts (bronze), loads silver, stores the gold
dimensions (with ``--catalog-prefix`` also as catalog tables, which lets the
sales and customer tables be bucketed alike when the skew check allows),
publishes ``bronze.* / silver.* / gold.*`` in the session
catalog and prints the load metrics and the quality summary.  ``WAREHOUSE``
must be a folder every executor can read (HDFS, object store, shared mount).
Under spark-submit the cluster's session is used as is.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from strata.session import ensure_conf

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("strata").getOrCreate()
    return ensure_conf(spark)


def _thresholds(settings: list[str]):
    """The rules with those given as RULE=NUMBER set."""
    from dataclasses import fields, replace

    from strata.plans.reports import Thresholds

    out = Thresholds()
    for setting in settings:
        name, _, number = setting.partition("=")
        for part in ("customer", "product"):
            rules = getattr(out, part)
            if name in {f.name for f in fields(rules) if isinstance(f.default, int)}:
                out = replace(out, **{part: replace(rules, **{name: int(number)})})
                break
        else:
            raise SystemExit(f"no rule {name!r}")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from strata.plans import quality
    from strata.plans.jobs import load_bronze
    from strata.plans.registry import QUERIES
    from strata.plans.warehouse import Warehouse
    from strata.sources import catalog
    from strata.sources.tables import LayerStore

    parser = argparse.ArgumentParser(prog="python -m strata")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="land, clean and shape the warehouse")
    b.add_argument("--source", required=True, help="folder with source_crm/ and source_erp/ extracts")
    b.add_argument("--on-bad-rows", choices=("fail", "null"), default="fail")
    c = sub.add_parser("check", help="run every quality check")
    q = sub.add_parser("query", help="show one registered query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("--rows", type=int, default=20, help="rows to print")
    for p in (b, c, q):
        p.add_argument("--root", required=True, help="warehouse folder")
        p.add_argument("--as-of", default=None, help="reference date (default: today)")
        p.add_argument("--catalog-prefix", default=None,
                       help="also keep the tables in the catalog as <prefix><layer>.<name> (needed for "
                            "bucketing; needs a persistent metastore to be reused by later runs)")
        p.add_argument("--threshold", action="append", default=[], metavar="RULE=NUMBER",
                       help="a rule of the reports, e.g. vip_spend=8000 (vip_lifespan_months, vip_spend, under_age, "
                            "high_revenue, mid_revenue)")
    sub.add_parser("list", help="list the registered queries")
    args = parser.parse_args(argv)

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = spark or _session()
    store = LayerStore(spark, args.root, catalog_prefix=args.catalog_prefix)
    if args.command == "build":
        load_bronze(spark, args.source, store, on_bad_rows=args.on_bad_rows).show(truncate=False)
        wh = Warehouse.build(spark, store=store, as_of=args.as_of, thresholds=_thresholds(args.threshold))
        wh.load_metrics.show(truncate=False)
        catalog.publish(wh)
        store.clean()
        summary = quality.summary(wh)
        summary.show(100, truncate=False)
        return 0
    wh = Warehouse.open(spark, store, as_of=args.as_of)
    wh.thresholds = _thresholds(args.threshold)
    if args.command == "check":
        summary = quality.summary(wh)
        summary.show(100, truncate=False)
        return 1 if summary.filter("status = 'failed'").count() else 0
    QUERIES[args.name](wh).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
