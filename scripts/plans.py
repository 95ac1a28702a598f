"""Write PLANS.md: the physical plans of the key operators over a stored properties table.

usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from muniprop import fixtures as fx  # noqa: E402
from muniprop.operators import reports as R  # noqa: E402
from muniprop.operators.enrich import add_building_category, backfill_alt_addresses  # noqa: E402
from muniprop.operators.ownership import ownership_filter  # noqa: E402
from muniprop.operators.subunits import merge_subunits  # noqa: E402
from muniprop.plans import pipeline as PL  # noqa: E402
from muniprop.session import local_session  # noqa: E402

MARKERS = (
    "Scan parquet", "PartitionFilters", "PushedFilters", "ReadSchema", "Exchange", "WindowGroupLimit",
    "BroadcastHashJoin", "BroadcastExchange", "SortMergeJoin", "HashAggregate", "SortAggregate", "Sort ", "Expand", "Window ",
    "Union", "Generate", "WholeStageCodegen",
)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _short(ln: str) -> str:
    ln = re.sub(r"#\d+L?", "", ln.rstrip())
    if "FileScan" not in ln:
        return ln[:220]
    head = ln.split(" Batched:")[0][:200]
    parts = [m.group(0)[:160] for m in re.finditer(r"(PartitionFilters|PushedFilters): \[[^\]]*\]", ln)]
    return head + " | " + " | ".join(parts)


def excerpt(text: str) -> str:
    return "\n".join(_short(ln) for ln in text.splitlines() if any(m in ln for m in MARKERS))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan shape
    d = tempfile.mkdtemp(prefix="plans-")
    R.with_key(fx.fx_props(spark, sf_dir)).write.partitionBy("kommune_key").parquet(f"{d}/props")
    fx.fx_raw(spark, sf_dir).write.parquet(f"{d}/raw")
    props, raw = spark.read.parquet(f"{d}/props"), spark.read.parquet(f"{d}/raw")

    cases = [
        ("K07 top properties: map-side WindowGroupLimit (Partial) before the shuffle", R.top_properties(props)),
        ("K01 for one municipality: partition pruning on kommune_key", R.occupancy_distribution(R.for_kommune(props, "NATION 3"))),
        ("Grouped facts for K05/K09/K12/K13/K14: one Expand + one aggregation", R.grouped_facts(props)),
        ("Fused per-municipality scan (K04/K18/K20/K22/K23)", R.key_metrics(props)),
        ("P03 ownership filter: row-local, no exchange", ownership_filter(raw)),
        ("D01 backfill: lookup from narrow columns, one left join", backfill_alt_addresses(ownership_filter(raw))),
        ("D03 categories: broadcast joins of fixed code tables", add_building_category(raw).select("row_no", "forenklet_bygningskategori")),
        ("D05 sub-unit merge: hash aggregation of first entries", merge_subunits(raw)),
        ("S08 the loaded rows: the kept rows read in full once, twice for a few columns", PL.properties_rows(raw)),
        ("K07/K16/K17/K19/K21 in one scan, one ranking", R.detail_lists(props)),
        ("D07 statistics: one scan, conditional counts", PL.statistics(raw)),
    ]
    out = ["# PLANS — physical plans of the key operators (AQE off to show the static shape)\n",
           f"Generated by `scripts/plans.py {sf_dir}`; lines filtered to scans, exchanges, joins, aggregates and windows.\n"]
    for title, df in cases:
        out.append(f"## {title}\n\n```\n{excerpt(plan_text(df))}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
