"""A small export of our own on which every rule of the catalogue fires, with exact figures and id lists."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.operators.ledger import findings_report, findings_totals, unresolved_fixes
from sitelens.operators.rules import EXPORT_FILES, FACTOR_FILE, FUEL_FILE, INCIDENT_FILE, POWER_FILE, RULES, SUPPLIER_FILE
from sitelens.plans.load import clean_export
from sitelens.session import materialise
from sitelens.sources.reference import FACTOR_KEY_BY_ACTIVITY


def fuel():
    rows = ["Invoice No, Delivery Date,Fuel Type ,Quantity, Unit,Cost (AUD),Site Area"]
    n = 100
    for month in (1, 2, 3, 5, 6, 7, 8):  # nothing in April, seven times as much in July
        for day in (5, 20):
            litres = (7000 if month == 7 else 1000) + 10 * month
            rows.append(f'INV-{n},{day:02d}/{month:02d}/2025,Diesel,{litres},L,"${2 * litres:,}.00",Processing Plant')
            n += 1
    return rows + [
        "INV-200,Feb-25,Diesel,100,L,200.00,Processing Plant",          # no day
        "INV-201,2025-03-02,Diesel,0.1,kL,200.00,Processing Plant",     # kilolitres
        "INV-101,20/01/2025,Diesel,1010,L,2020.00,Processing Plant",    # seen before
        "INV-202,2025-03-03,Diesel,-100,L,-200.00,Processing Plant",    # credit note
        "INV-203,2025-03-04,Diesel,100,L,1000.00,Processing Plant",     # 10 a litre
        "INV-204,2025-03-05,Diesel,10,L,20.00,Light Vehicles",
        "INV-205,2025-03-06,Diesel,10,L,20.00,Moon Base",
        "INV-206,31/02/2025,Diesel,10,L,20.00,Processing Plant"]        # no such day


def power():
    rows = ["meter_id,meter_description,period,consumption,unit"]
    for k, meter in enumerate(("MTR-01", "MTR-02", "MTR-05")):  # 03 and 04 are missing
        for month in range(1, 9):
            kwh = (k + 1) * 10_000 + 100 * month
            value = kwh // 5 if month == 6 else kwh
            rows.append(f"{meter},Feeder,2025-{month:02d},{value / 1000 if (k, month) == (2, 3) else value},kWh")
    return rows


def incidents():
    return ["incident_id,incident_date,location,type_code,severity,description",
            "INC-1,2025-01-01,Processing Plant,DUS,1,Dust over the pad.", "INC-2,2025-01-02,Processing Plant,DUS,2,Hose burst.",
            "INC-2,2025-01-03,Processing Plant,DUS,2,Another hose.", "INC-3,2025-01-04,Haul Fleet,DUS,Low,Rock jammed the Crusher again.",
            "INC-4,2025-01-05,Processing Plant,ZZZ,3,Unlisted kind.", "INC-5,2025-01-06,Site Services,DUS,1,Hose burst.",
            "INC-40,2025-02-01,Processing Plant,DUS,1,Late one.", "INC-41,2025-02-02,Processing Plant,DUS,1,Later one.",
            "INC-45,2025-02-03,Haul Fleet,DUS,1,Hose burst."]


def suppliers():
    return ["supplier_name,abn,category,fy_spend_aud", "Acme Mining Pty Ltd,11 111 111 111,Parts,100.00", "Acme Mining,11 111 111 111,Services,50.00",
            "Northern Haulage,22 222 222 222,Haulage,10.00", "Northern Haulege,,Haulage,5.00", "Solo Traders,1234567,Other,1.00"]


def factors():
    return ["activity,scope,unit,kg_co2e_per_unit,source"] + [f"{a},1,L,2.5,book" for a in FACTOR_KEY_BY_ACTIVITY]


# Issues per rule, as read off the files above.
WANT = {
    "FUEL-HEADER-01": 1, "FUEL-FORMAT-01": 2, "FUEL-DATE-PRECISION-01": 1, "FUEL-UNIT-KL-01": 1, "FUEL-DUP-01": 1, "FUEL-CREDIT-01": 1,
    "FUEL-PRICE-01": 1, "FUEL-SITE-FLEET-01": 1, "FUEL-SITE-UNKNOWN-01": 1, "FUEL-VOLUME-SPIKE-01": 1, "FUEL-MONTH-GAP-01": 1,
    "ELEC-UNIT-SCALE-01": 1, "ELEC-METER-GAP-01": 1, "ELEC-CONSUMPTION-DROP-01": 1,
    "INC-DUP-ID-01": 1, "INC-SEV-SCALE-01": 1, "INC-SEV-MAPPED-01": 1, "INC-ID-SEQUENCE-01": 1, "INC-DESC-REUSED-01": 1, "INC-LOCATION-01": 1,
    "INC-TYPE-UNKNOWN-01": 1, "SUP-DUP-01": 2, "SUP-ABN-FORM-01": 2, "SUP-ABN-CHECKSUM-01": 1, "SUP-CATEGORY-01": 1}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    files = {FUEL_FILE: fuel(), POWER_FILE: power(), INCIDENT_FILE: incidents(), SUPPLIER_FILE: suppliers(), FACTOR_FILE: factors()}
    for company in (1, 2):  # nothing may leak between two tenants with equal files
        (root / f"company_id={company}").mkdir()
        for name in EXPORT_FILES:
            (root / f"company_id={company}" / name).write_text("\n".join(files[name]) + "\n")
    clean = clean_export(spark, str(root))
    assert clean.refused.isEmpty()
    return {k: materialise(v) for k, v in clean.tables.items()}


def test_every_rule_fires(loaded):
    issues = loaded["data_quality_issues"]
    assert set(WANT) == set(RULES) and len(WANT) == 25
    for company in (1, 2):
        assert Counter(r.rule_id for r in issues.where(F.col("company_id") == company).collect()) == WANT
    assert unresolved_fixes(issues).isEmpty()
    totals = findings_totals(issues).where("company_id = 1").first()
    assert totals.findings == sum(WANT.values()) and totals.rules == 25
    assert totals.fixed + totals.flagged + totals.rejected == totals.findings and totals.rejected == 2
    assert findings_report(issues).where("not fired").isEmpty()


def test_keys_and_id_lists(loaded):
    issues, members = (loaded[n].where("company_id = 1") for n in ("data_quality_issues", "issue_members"))
    key = {r.rule_id: r.record_key for r in issues.collect() if WANT[r.rule_id] == 1}
    assert {r: key[r] for r in key if r.startswith("FUEL-") and r not in ("FUEL-HEADER-01",)} == {
        "FUEL-DATE-PRECISION-01": "INV-200", "FUEL-UNIT-KL-01": "INV-201", "FUEL-DUP-01": "INV-101", "FUEL-CREDIT-01": "INV-202",
        "FUEL-PRICE-01": "INV-203", "FUEL-SITE-FLEET-01": "INV-204", "FUEL-SITE-UNKNOWN-01": "INV-205",
        "FUEL-VOLUME-SPIKE-01": "2025-07-01", "FUEL-MONTH-GAP-01": "2025-04"}
    assert key["ELEC-CONSUMPTION-DROP-01"] == "2025-06" and key["ELEC-UNIT-SCALE-01"] == "MTR-05 2025-03"
    # A group's key names its first and last record; the whole list is in the member table.
    assert key["INC-ID-SEQUENCE-01"] == "INC-40 ... INC-45" and key["INC-DESC-REUSED-01"] == "INC-2 ... INC-45"
    assert key["ELEC-METER-GAP-01"] == "MTR-03 ... MTR-04"
    lists = {}
    for r in members.orderBy("rule_id", "member_order").collect():
        lists.setdefault(r.rule_id, []).append(r.member_id)
    assert lists == {"INC-ID-SEQUENCE-01": ["INC-40", "INC-41", "INC-45"], "INC-DESC-REUSED-01": ["INC-2", "INC-5", "INC-45"],
                     "ELEC-METER-GAP-01": ["MTR-03 ... MTR-04"]}


def test_facts(loaded):
    one = {n: loaded[n].where("company_id = 1") for n in loaded}
    assert {n: one[n].count() for n in ("fuel_deliveries", "electricity_readings", "meters", "incidents", "suppliers")} == {
        "fuel_deliveries": 20, "electricity_readings": 24, "meters": 3, "incidents": 9, "suppliers": 5}
    fixed = one["electricity_readings"].where("unit_correction_factor = 1000").first()
    assert (fixed.meter_id, float(fixed.consumption_kwh), float(fixed.original_consumption)) == ("MTR-05", 30300.0, 30.3)
    assert sorted(r.id for r in one["incidents"].where("source_incident_id = 'INC-2'").collect()) == ["INC-2", "INC-2-2"]
    assert {r.supplier_name: r.duplicate_of_name for r in one["suppliers"].where("duplicate_of_row is not null").collect()} == {
        "Acme Mining": "Acme Mining Pty Ltd", "Northern Haulege": "Northern Haulage"}
    assert [r.name for r in one["site_areas"].collect()] == ["Moon Base"]
    assert float(one["fuel_deliveries"].where("invoice_no = 'INV-201'").first().quantity_l) == 100.0
