"""The whole load over a small export: refusals, empty and oversized values, reload."""
import os

import pytest

from sitelens.plans import load
from sitelens.plans.load import remove_company, run_load
from sitelens.sinks.store import Store
from sitelens.sources.artefacts import FINDINGS_FILE

FUEL = "Invoice No,Delivery Date,Fuel Type,Quantity,Unit,Cost (AUD),Site Area\n"
POWER = "meter_id,meter_description,period,consumption,unit\n"
INCIDENTS = "incident_id,incident_date,location,type_code,severity,description\n"
SUPPLIERS = "supplier_name,abn,category,fy_spend_aud\n"
FACTORS = "activity,scope,unit,kg_co2e_per_unit,source\n"


def names():
    from sitelens.operators.rules import FACTOR_FILE, FUEL_FILE, INCIDENT_FILE, POWER_FILE, SUPPLIER_FILE
    from sitelens.sources.reference import FACTOR_KEY_BY_ACTIVITY
    return FUEL_FILE, POWER_FILE, INCIDENT_FILE, SUPPLIER_FILE, FACTOR_FILE, list(FACTOR_KEY_BY_ACTIVITY)


def write(root, tenant, **files):
    folder = os.path.join(root, f"company_id={tenant}")
    os.makedirs(folder, exist_ok=True)
    for role, text in files.items():
        with open(os.path.join(folder, role.replace("__", ".")), "w", encoding="utf-8") as f:
            f.write(text)


def batch(spend="100.00", second="500.00"):
    fuel, power, incident, supplier, factor, activities = names()
    rows = "".join(f"INV-{i},{d}/03/2025,Diesel,100,L,$150.00,Processing Plant\n" for i, d in enumerate((10, 11), 1))
    meters = "".join(f"MTR-{m},Feeder,2025-0{p},1000,kWh\n" for m in ("01", "2000") for p in (1, 2, 3))
    return {
        fuel.replace(".", "__"): FUEL + rows,
        power.replace(".", "__"): POWER + meters + "MTR-01,Feeder,2025-04,1" + "0" * 15 + ",kWh\n",
        incident.replace(".", "__"): INCIDENTS + "INC-1,2025-01-01,Processing Plant,DUS,2,text\n",
        supplier.replace(".", "__"): SUPPLIERS + f"Acme Mining Pty Ltd,51 824 753 556,Parts,{spend}\n"
                                     f"Acme Mining,51 824 753 556,Parts,{second}\n",
        factor.replace(".", "__"): FACTORS + "".join(f"{a},1,L,2.5,book\n" for a in activities[:1]),
    }


def test_whole_load(spark, tmp_path):
    root, out = str(tmp_path / "export"), str(tmp_path / "tables")
    supplier = names()[3]
    write(root, 1, **batch(spend=""))
    write(root, 2, **batch(spend="1" + "0" * 15))
    write(root, 3, **{k: v for k, v in batch().items() if k != supplier.replace(".", "__")})
    for _ in range(2):
        run_load(spark, root, out)
    store = Store(spark, out)
    loads = store.read("data_loads").collect()
    assert sorted((r.company_id, r.status) for r in loads) == [
        (1, "succeeded"), (1, "succeeded"), (2, "succeeded"), (2, "succeeded"), (3, "failed"), (3, "failed")]
    assert "missing-or-blank" in [r for r in loads if r.company_id == 3][0].failure_reason
    for table, n in (("fuel_deliveries", 2), ("electricity_readings", 6), ("suppliers", 2)):
        rows = store.read(table)
        assert {r.company_id: r["count"] for r in rows.groupBy("company_id").count().collect()} == {1: n, 2: n}
    issues = store.read("data_quality_issues")
    gaps = issues.where("rule_id = 'ELEC-METER-GAP-01'").collect()
    assert {r.record_key for r in gaps} == {"MTR-02 ... MTR-1999"}
    members = store.read("issue_members").where("rule_id = 'ELEC-METER-GAP-01'").collect()
    assert [(r.company_id, r.member_id) for r in sorted(members, key=lambda r: r.company_id)] == [
        (1, "MTR-02 ... MTR-1999"), (2, "MTR-02 ... MTR-1999")]
    assert issues.where("rule_id = 'ELEC-UNIT-SCALE-01' and action = 'rejected'").count() == 2
    runs = store.read("load_runs").orderBy("started_at").collect()
    assert [(r.status, r.tenants_loaded, r.tenants_failed) for r in runs] == [("succeeded", 2, 1)] * 2
    counted = {r.company_id: r for r in loads if r.status == "succeeded"}
    for table in ("fuel_deliveries", "suppliers", "data_quality_issues"):
        assert runs[1].rows_written[table] == sum(r.row_counts[table] for r in counted.values()) == store.read(table).count()
    assert counted[1].issue_count == issues.where("company_id = 1").count() and store.current().version == 2

    # A load that throws halfway changes no table and is audited for every tenant of the batch.
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("suppliers", "fuel_deliveries", "emission_factors")}
    write(root, 1, **batch(spend="7.00"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(load, "rule_catalogue", lambda spark: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_load(spark, root, out)
    assert {t: sorted(map(str, store.read(t).collect())) for t in before} == before
    last = [r for r in store.read("data_loads").collect() if "ZeroDivisionError" in (r.failure_reason or "")]
    assert sorted((r.company_id, r.status, len(r.row_counts)) for r in last) == [(1, "failed", 0), (2, "failed", 0), (3, "failed", 0)]
    run = store.read("load_runs").where("status = 'failed'").collect()
    assert [(r.tenants_loaded, r.tenants_failed) for r in run] == [(0, 3)] and run[0].rows_written["suppliers"] == 4
    assert {r.load_id for r in last} == {run[0].load_id}
    # Without even a file listing the run alone is recorded.
    with pytest.raises(Exception):
        run_load(spark, str(tmp_path / "nowhere"), out)
    assert store.read("load_runs").count() == 4 and store.read("data_loads").count() == len(loads) + 3

    # Removing a tenant takes it out of every table and deletes its files.
    remove_company(spark, out, 1)
    for table in store.current().schemas:
        rows = store.read(table)
        assert "company_id" not in rows.columns or rows.where("company_id = 1").isEmpty(), table
    assert store.read("suppliers").count() == 2
    assert not [d for d, _, _ in os.walk(out) if "company_id=1" in d]


def test_consolidated_spend_with_an_unknown_primary(spark):
    from sitelens.plans.reports import find_suppliers, supplier_list_totals
    rows = spark.createDataFrame(
        [(1, 2, "A", None, None), (1, 3, "A2", 500.0, 2), (1, 4, "B", None, None)],
        "company_id long, source_row_number long, supplier_name string, fy_spend_aud double, duplicate_of_row long") \
        .selectExpr("*", "supplier_name as name_canonical", "'' as abn_raw", "cast(null as string) as abn",
                    "false as abn_valid", "'' as category", "'' as category_canonical", "'' as duplicate_of_name",
                    "cast(fy_spend_aud as decimal(14,2)) as s").drop("fy_spend_aud").withColumnRenamed("s", "fy_spend_aud")
    got = {r.supplier_name: r.consolidated_spend_aud for r in find_suppliers(rows).collect()}
    assert float(got["A"]) == 500 and got["A2"] is None and got["B"] is None
    assert float(supplier_list_totals(rows).first().consolidated_total_aud) == 500


def test_artefact_schema_names():
    assert [f.name for f in FINDINGS_FILE.fields][-1] == "findings"
