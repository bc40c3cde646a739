"""Exact figures of a known export.

Set SITELENS_EXPORT_DIR to a folder with the five CSV files (and, optionally,
SITELENS_FINDINGS to a findings artefact) to run; skipped otherwise.
"""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sitelens.operators.contracts import validate, fuel_checks, reading_checks
from sitelens.operators.ledger import findings_report, findings_totals, unresolved_fixes, with_issue_counts
from sitelens.operators.citations import fact_digest
from sitelens.operators.grounding import load_findings
from sitelens.operators.rules import EXPORT_FILES, FUEL_FILE, rule_catalogue
from sitelens.plans import marts, reports
from sitelens.plans.factpack import build_fact_pack
from sitelens.plans.load import clean_export, run_load
from sitelens.plans.outage import explain
from sitelens.session import materialise
from sitelens.sinks.store import Store
from sitelens.sinks.tables import known_site_areas
from sitelens.sources.artefacts import read_findings
from sitelens.sources.reference import incident_types, site_areas

EXPORT = os.environ.get("SITELENS_EXPORT_DIR")
FINDINGS = os.environ.get("SITELENS_FINDINGS")
pytestmark = pytest.mark.skipif(not EXPORT, reason="SITELENS_EXPORT_DIR is not set")

RULE_COUNTS = {
    "FUEL-HEADER-01": 1, "FUEL-FORMAT-01": 1, "FUEL-DATE-PRECISION-01": 29, "FUEL-UNIT-KL-01": 11,
    "FUEL-DUP-01": 7, "FUEL-CREDIT-01": 1, "FUEL-SITE-FLEET-01": 3, "FUEL-VOLUME-SPIKE-01": 1,
    "FUEL-MONTH-GAP-01": 1, "ELEC-UNIT-SCALE-01": 9, "ELEC-METER-GAP-01": 1,
    "ELEC-CONSUMPTION-DROP-01": 1, "INC-DUP-ID-01": 1, "INC-SEV-SCALE-01": 1, "INC-SEV-MAPPED-01": 11,
    "INC-ID-SEQUENCE-01": 1, "SUP-DUP-01": 2, "SUP-ABN-FORM-01": 3, "SUP-ABN-CHECKSUM-01": 1,
    "SUP-CATEGORY-01": 1}

MONTHS = """
2025-01 1079589.03 1457844.07 2537433.10 42.5 None 13
2025-02 1148232.21 1377421.37 2525653.58 45.5 -0.5 13
2025-03 1200987.18 1456004.38 2656991.56 45.2 5.2 15
2025-08 1219184.94 1410801.03 2629985.97 46.4 -0.4 17
2025-11 0.00 1445513.57 1445513.57 0.0 -47.2 6
2025-12 1315373.64 1486033.83 2801407.47 47.0 93.8 13
2026-03 1893860.16 507100.96 2400961.12 78.9 -11.5 13
2026-06 1444512.93 1403447.49 2847960.42 50.7 -1.1 16
"""


@pytest.fixture(scope="module")
def export_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    # Two tenants with the same files: nothing may leak between them.
    for company in (1, 2):
        folder = root / f"company_id={company}"
        folder.mkdir()
        for name in EXPORT_FILES:
            shutil.copyfile(os.path.join(EXPORT, name), folder / name)
    # A third tenant without one of the files is refused.
    folder = root / "company_id=3"
    folder.mkdir()
    shutil.copyfile(os.path.join(EXPORT, FUEL_FILE), folder / FUEL_FILE)
    return str(root)


@pytest.fixture(scope="module")
def loaded(spark, export_root):
    clean = clean_export(spark, export_root)
    tables = {k: materialise(v) for k, v in clean.tables.items()}
    tables["factors"] = materialise(clean.factors)
    tables["refused"] = clean.refused
    return tables


def one(df):
    return df.where("company_id = 1")


def test_row_counts(loaded):
    got = {n: one(loaded[n]).count() for n in
           ("fuel_deliveries", "meters", "electricity_readings", "incidents", "suppliers")}
    assert got == {"fuel_deliveries": 143, "meters": 6, "electricity_readings": 108,
                   "incidents": 42, "suppliers": 15}
    assert [(r.company_id) for r in loaded["refused"].collect()] == [3]


def test_ledger(loaded):
    issues = loaded["data_quality_issues"]
    for company in (1, 2):
        mine = issues.where(F.col("company_id") == company)
        counts = {r.rule_id: r["count"] for r in mine.groupBy("rule_id").count().collect()}
        for rule, n in RULE_COUNTS.items():
            assert counts[rule] == n, rule
        assert sum(counts.values()) == 99 and len(counts) == 22
    totals = findings_totals(one(issues)).first().asDict()
    totals.pop("company_id")
    assert totals == {"findings": 99, "rules": 22, "fixed": 37, "flagged": 55, "rejected": 7,
                      "error": 31, "warning": 42, "info": 26}
    assert unresolved_fixes(issues).isEmpty()
    report = findings_report(one(issues))
    assert {r.rule_id for r in report.where("not fired").collect()} == {
        "FUEL-PRICE-01", "FUEL-SITE-UNKNOWN-01", "INC-TYPE-UNKNOWN-01"}


def test_keys(loaded):
    issues = one(loaded["data_quality_issues"])
    def keys(rule):
        return sorted(r.record_key for r in issues.where(F.col("rule_id") == rule).collect())
    assert keys("FUEL-DUP-01") == [f"INV-{n}" for n in (40266, 40292, 40349, 40357, 40497, 40715, 40962)]
    assert keys("FUEL-SITE-FLEET-01") == ["INV-40431", "INV-40800", "INV-40948"]
    assert keys("FUEL-MONTH-GAP-01") == ["2025-11"]
    assert keys("FUEL-VOLUME-SPIKE-01") == ["2026-03-01"]
    assert keys("ELEC-CONSUMPTION-DROP-01") == ["2026-03"]
    assert keys("ELEC-METER-GAP-01") == ["MTR-06"]
    # The key names the first and the last incident of a group, the member table all of them.
    late = [r.member_id for r in one(loaded["issue_members"]).where("rule_id = 'INC-ID-SEQUENCE-01'").orderBy("member_order").collect()]
    assert {"INC-2025-118", "INC-2025-141"} <= set(late) and keys("INC-ID-SEQUENCE-01") == [f"{late[0]} ... {late[-1]}"]
    fixed = issues.where("record_key = 'MTR-07 2025-10'").first()
    assert (fixed.original_value, fixed.resolved_value) == ("277 kWh", "277000 kWh")
    assert issues.where("resolved_value = 'INC-2025-011-2'").count() == 1
    fuel = one(loaded["fuel_deliveries"])
    assert fuel.where("date_precision = 'month'").count() == 26
    credit = fuel.where("is_credit_note").first()
    assert (credit.invoice_no, float(credit.quantity_l), float(credit.cost_aud)) == ("INV-41777", -12500, -23375)
    assert float(fuel.where("invoice_no = 'INV-40373'").first().quantity_l) == 84030


def test_emissions(spark, loaded):
    fuel, power = loaded["fuel_deliveries"], loaded["electricity_readings"]
    v1 = marts.monthly_emissions(fuel, power, loaded["factors"])
    v3 = materialise(marts.monthly_totals(v1))
    got = {r.month: r for r in reports.find_monthly_totals(v3, company=1).collect()}
    assert len(got) == 18
    for line in MONTHS.strip().splitlines():
        month, s1, s2, total, share, moved, n = line.split()
        r = got[month]
        assert [str(r.scope1_kg_co2e), str(r.scope2_kg_co2e), str(r.total_kg_co2e), str(r.scope1_share_pct),
                str(r.month_on_month_pct), str(r.contributing_records)] == [s1, s2, total, share, moved, n], month
    # Joining the ledger gives the same quality counts as those carried by the facts.
    issues = loaded["data_quality_issues"]
    again = marts.monthly_totals(marts.monthly_emissions(
        with_issue_counts(fuel, issues, FUEL_FILE),
        with_issue_counts(power, issues, "electricity_meter_readings.csv"), loaded["factors"]))
    assert again.exceptAll(v3).isEmpty()
    years = {r.financial_year: r for r in reports.find_financial_years(marts.financial_years(v3), 1).collect()}
    assert str(years[2025].total_kg_co2e) == "15614639.98" and not years[2025].is_complete_year
    assert str(years[2026].total_kg_co2e) == "31315194.77" and years[2026].is_complete_year
    period = reports.find_period_totals(v3, 1).first()
    assert str(period.total_kg_co2e) == "46929834.75" and period.quality_error_count == 20
    areas, _ = known_site_areas(site_areas(spark), fuel.select("company_id", "site_area"))
    by_area = {(r.site_area, r.fuel_type): str(r.kg_co2e) for r in reports.find_scope1_by_site_area(
        marts.scope1_by_site_area(fuel, loaded["factors"], areas), 1).collect()}
    assert by_area[("Light Vehicles", "Diesel")] == "427320.90"
    assert by_area[("Open Cut - North Pit", "Diesel")] == "6582586.50"


def test_outage_and_pack(spark, loaded):
    incidents = loaded["incidents"]
    findings = spark.createDataFrame(
        [], "company_id bigint, seq bigint, incident_id string, category string, is_psychosocial boolean, "
            "psychosocial_subtype string, severity_assessment int, confidence decimal(3,2), "
            "evidence_quote string, rationale string, model string, prompt_version string, "
            "created_at timestamp, severity_mismatch boolean")
    if FINDINGS:
        raw = read_findings(spark, FINDINGS).withColumn("company_id", F.lit(1).cast("bigint"))
        findings, counts = load_findings(raw, incidents)
        c = counts.first()
        assert (c.loaded, c.rejected, c.psychosocial, c.severity_mismatches) == (42, 0, 4, 14)
    findings = materialise(findings)
    fuel, power, meters = (loaded[n] for n in ("fuel_deliveries", "electricity_readings", "meters"))
    v3 = materialise(marts.monthly_totals(marts.monthly_emissions(fuel, power, loaded["factors"])))
    outage = explain(fuel, power, meters, v3, incidents, findings, loaded["factors"])
    s = outage.summary.where("company_id = 1").first()
    assert s.outage_month == dt.date(2026, 3, 1)
    assert (s.grid_change_pct, s.fuel_change_pct, s.scope1_change_pct, s.scope2_change_pct,
            s.total_change_pct) == (-64.5, 51.5, 51.6, -64.5, -10.3)
    assert abs(s.counterfactual_total - 2677007.995) < 0.011
    assert (s.meter_count, s.meters_below_baseline) == (6, 6)
    assert s.root_cause_id is not None
    assert sorted(m.change_pct for m in outage.meters.where("company_id = 1").collect()) == [
        -66.7, -66.7, -63.7, -63.4, -63.0, -62.7]
    assert outage.chain.where("company_id = 1").count() == 6
    pack = materialise(build_fact_pack(
        fuel, power, meters, incidents, loaded["suppliers"], findings, loaded["data_quality_issues"],
        loaded["factors"], incident_types(spark), rule_catalogue(spark), outage))
    mine = pack.where("company_id = 1")
    values = {r.id: r.value for r in mine.collect()}
    assert values["EMISSIONS-TOTAL-T"] == "46929.8" and values["PERIOD-RANGE"] == "January 2025 to June 2026"
    assert values["OUTAGE-GRID-CHANGE-PCT"] == "-64.5" and values["DQ-ISSUES-TOTAL"] == "99"
    assert mine.count() == mine.select("id").distinct().count()
    if FINDINGS:
        assert mine.count() == 108
    digests = {r.company_id: r.fact_digest for r in fact_digest(pack).collect()}
    assert len(digests[1]) == 16


def test_contracts(spark, loaded):
    areas, _ = known_site_areas(site_areas(spark), loaded["fuel_deliveries"].select("company_id", "site_area"))
    assert validate([*fuel_checks(loaded["fuel_deliveries"], loaded["factors"], areas),
                     *reading_checks(loaded["electricity_readings"], loaded["meters"])]).isEmpty()


def test_run_load(spark, export_root, tmp_path):
    out = str(tmp_path / "out")
    run_load(spark, export_root, out)
    run_load(spark, export_root, out)
    store = Store(spark, out)
    assert store.read("fuel_deliveries").count() == 286
    loads = store.read("data_loads")
    assert sorted((r.company_id, r.status, r.issue_count) for r in loads.collect()) == [
        (1, "succeeded", 99)] * 2 + [(2, "succeeded", 99)] * 2 + [(3, "failed", 0)] * 2
    assert store.read("emission_factors").count() == 3
