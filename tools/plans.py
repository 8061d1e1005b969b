"""Write PLANS.md: physical plans of the headline queries, with dimensions
small enough to broadcast and with dimensions treated as too large.

    python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.oracle import AS_OF  # noqa: E402
from strata.operators.joins import MAX_BROADCAST_BYTES  # noqa: E402
from strata.plans.registry import QUERIES  # noqa: E402
from strata.plans.warehouse import Warehouse  # noqa: E402
from strata.session import local_session  # noqa: E402

HEADLINE = ["e6_5_revenue_by_category", "n1a_sales_by_month", "n4b_customer_segments", "g4_report_customers",
            "e7_1b_top_products_ranked", "t2_silver_products"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = re.sub(r"#\d+L?", "", buf.getvalue())                       # expression ids
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    text = re.sub(r"InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "InMemoryFileIndex[...]", text)
    text = re.sub(r"strata_[0-9a-f]{8}_", "", text)                    # per-build schema prefix
    return text.strip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    wh = Warehouse.from_standin(spark, sf_dir, as_of=AS_OF)
    out = ["# Physical plans", "",
           f"Generated by `tools/plans.py` on `{os.path.basename(sf_dir)}` with 16 shuffle partitions. "
           "Expression ids and file paths are elided.", ""]
    for title, large in (("Dimensions small enough to broadcast", False),
                         ("Dimensions treated as too large to broadcast", True)):
        wh.max_broadcast_bytes = 0 if large else MAX_BROADCAST_BYTES
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if large else str(10 * 1024 * 1024))
        out += [f"## {title}", ""]
        for name in HEADLINE:
            out += [f"### {name}", "", "```", plan(QUERIES[name](wh)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
