"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registered.registry import QUERIES  # noqa: E402
from sitelens.session import build_session  # noqa: E402

# Cleaning pipelines first; the report queries then read the loaded tables.
HEADLINE = [
    "fuel_deliveries", "fuel_issues", "fuel_duplicate_invoices", "electricity_readings", "electricity_issues",
    "incidents", "incident_issues", "suppliers_resolved", "supplier_issues", "monthly_emissions_totals", "scope1_site_area_report",
    "financial_years", "incident_register", "dq_top_issues", "dq_rule_catalogue", "outage_summary",
    "grounding_gate", "classification_batches", "citation_gate", "fact_pack_emissions", "contract_violations",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus), spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    # The loads that report queries depend on are timed on their own.
    from registered import registry
    took = {}
    for name, load in [("load_fuel", registry.fuel_tables), ("load_electricity", registry.power_tables),
                       ("load_incidents", registry.incident_tables), ("load_suppliers", registry.supplier_tables)]:
        start = time.time()
        load(spark, sf_dir)
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
