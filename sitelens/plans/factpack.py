"""The fact pack: every figure a sentence may state, with a fixed id, for all tenants.

Ids, units and sources are fixed values. Labels and details are our own wording,
but they carry the figures (scope numbers, scale points) a sentence may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.functions.numbers import plain
from sitelens.plans import marts, reports
from sitelens.plans.outage import Outage, explain

FACT_COLUMNS = ["company_id", "block", "sort_key", "id", "kind", "label", "value", "value_num",
                "unit", "source", "detail"]
TOTALS = "v_monthly_emissions_totals"
REGISTER = "incident_register.csv"
READ_REGISTER = "incident_register.csv + ai_incident_findings"
ACTION_NOTES = {
    "fixed": "Corrected on the way in; the written value stays on the record.",
    "flagged": "Loaded as written for a person to judge.",
    "rejected": "Left out of the tables and recorded with its reason.",
}


def _text(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def _tenths(c) -> Column:
    """Decimal rounded to one place, ties up, without trailing zero."""
    ticks = F.floor(c.cast("decimal(30,6)") * 10 + F.expr("0.5BD")).cast("decimal(30,0)")
    return (ticks * F.expr("0.1BD")).cast("decimal(30,1)")


def _tonnes(kg: Column) -> Column:
    return _tenths(kg.cast("decimal(30,6)") / 1000)


def _cents(c) -> Column:
    ticks = F.floor(c.cast("decimal(30,6)") * 100 + F.expr("0.5BD")).cast("decimal(30,0)")
    return (ticks * F.expr("0.01BD")).cast("decimal(30,2)")


def _month_name(ym: Column) -> Column:
    return F.date_format(F.concat(ym, F.lit("-01")).cast("date"), "MMMM yyyy")


def _fact(fact_id, kind, label, value, unit, source, detail=None, number=True, sort_key="") -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        _text(sort_key).alias("sort_key"), _text(fact_id).alias("id"), F.lit(kind).alias("kind"),
        _text(label).alias("label"), (plain(value) if number else _text(value)).alias("value"),
        (value.cast("double") if number else F.lit(None).cast("double")).alias("value_num"),
        _text(unit).alias("unit"), _text(source).alias("source"), _text(detail).alias("detail"))


def metric(fact_id, label, value, unit, source, detail=None, number=True, sort_key="") -> Column:
    return _fact(fact_id, "metric", label, value, unit, source, detail, number, sort_key)


def record(fact_id, label, value, source, detail, number=False, sort_key="") -> Column:
    return _fact(fact_id, "record", label, value, None, source, detail, number, sort_key)


def _block(df: DataFrame, n: int, *facts: Column) -> DataFrame:
    """Facts of one block; several facts per input row keep their given order."""
    return df.select("company_id", F.posexplode(F.array(*facts)).alias("pos", "f")).select(
        "company_id", (F.lit(n * 100) + F.col("pos")).alias("block"), "f.*").select(*FACT_COLUMNS)


def _severity_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("not recorded"))


def emission_facts(v1, v3, v5, fuel_sum, power_sum) -> list[DataFrame]:
    totals = reports.find_period_totals(v3)
    share = F.when(F.col("total_kg_co2e") == 0, F.expr("0BD")).otherwise(
        (F.col("scope1_kg_co2e") * 100).cast("decimal(30,2)") / F.col("total_kg_co2e"))
    out = [_block(
        totals, 1,
        metric("PERIOD-RANGE", "Period covered by the data", F.concat(
            _month_name(F.col("first_month")), F.lit(" to "), _month_name(F.col("last_month"))), None, TOTALS, number=False),
        metric("PERIOD-MONTHS", "Months with data", F.col("months"), "months", TOTALS),
        metric("EMISSIONS-TOTAL-KG", "Total emissions of the period, Scope 1 plus Scope 2",
               _cents(F.col("total_kg_co2e")), "kg CO2e", TOTALS),
        metric("EMISSIONS-TOTAL-T", "Total emissions of the period, Scope 1 plus Scope 2",
               _tonnes(F.col("total_kg_co2e")), "t CO2e", TOTALS),
        metric("EMISSIONS-SCOPE1-T", "Scope 1 emissions of the period, from fuel",
               _tonnes(F.col("scope1_kg_co2e")), "t CO2e", TOTALS),
        metric("EMISSIONS-SCOPE2-T", "Scope 2 emissions of the period, from grid electricity",
               _tonnes(F.col("scope2_kg_co2e")), "t CO2e", TOTALS),
        metric("EMISSIONS-SCOPE1-SHARE-PCT", "Scope 1 share of the period total", _tenths(share), "%", TOTALS),
        metric("EMISSIONS-CORRECTED-RECORDS", "Records behind the totals that carry a data-quality error",
               F.col("quality_error_count"), "records", TOTALS, "Their written values stay beside the corrected ones."))]
    years = reports.find_financial_years(v5)
    year = F.col("financial_year").cast("string")
    out.append(_block(years, 2, metric(
        F.concat(F.lit("FY"), year, F.lit("-TOTAL-T")),
        F.concat(F.lit("FY"), year, F.lit(" total emissions, July to June")),
        _tonnes(F.col("total_kg_co2e")), "t CO2e", "v_financial_year_emissions",
        F.concat(F.lit("Scope 1 "), plain(_tonnes(F.col("scope1_kg_co2e"))), F.lit(" t, Scope 2 "),
                 plain(_tonnes(F.col("scope2_kg_co2e"))), F.lit(" t, "), F.col("months_with_data").cast("string"),
                 F.lit(" months of data, "),
                 F.when(F.col("is_complete_year"), F.lit("a complete year")).otherwise(
                     F.lit("an incomplete year that must not be compared with a full one"))),
        sort_key=year)))
    extremes = reports.find_extreme_months(v3)
    high = F.col("kind") == "highest"
    out.append(_block(extremes, 3, metric(
        F.when(high, F.lit("EMISSIONS-PEAK-MONTH")).otherwise(F.lit("EMISSIONS-LOWEST-MONTH")),
        F.when(high, F.lit("Month with the highest emissions")).otherwise(F.lit("Month with the lowest emissions")),
        _month_name(F.col("month")), None, TOTALS,
        F.concat(plain(_tonnes(F.col("total_kg_co2e"))), F.lit(" t CO2e")), number=False, sort_key=F.col("kind"))))
    months = v3.withColumn("ym", F.date_format("month", "yyyy-MM"))
    out.append(_block(months, 4, metric(
        F.concat(F.lit("MONTH-"), "ym"), F.concat(_month_name(F.col("ym")), F.lit(" total emissions")),
        _tonnes(F.col("total_kg_co2e")), "t CO2e", TOTALS,
        F.concat(F.lit("Scope 1 "), plain(_tonnes(F.col("scope1_kg_co2e"))), F.lit(" t, Scope 2 "),
                 plain(_tonnes(F.col("scope2_kg_co2e"))), F.lit(" t, Scope 1 share "),
                 plain(F.col("scope1_share_pct")), F.lit("%, "), F.col("contributing_records").cast("string"),
                 F.lit(" records, "), F.col("quality_error_count").cast("string"), F.lit(" of them corrected")),
        sort_key=F.col("ym"))))
    key = F.col("factor_key")
    out.append(_block(fuel_sum, 5, metric(
        F.concat(F.lit("ACTIVITY-"), F.translate(F.upper(key), "_", "-"), F.lit("-L")),
        F.concat("activity", F.lit(" delivered in the period")), _cents(F.col("quantity")), F.col("unit"),
        "fuel_deliveries",
        F.concat(F.lit("From "), F.col("deliveries").cast("string"), F.lit(" invoices at "),
                 plain(F.col("kg_co2e_per_unit")), F.lit(" kg CO2e per "), "unit",
                 F.lit("; credit notes netted, duplicates left out.")), sort_key=key)))
    out.append(_block(
        power_sum, 6,
        metric("ACTIVITY-GRID-KWH", "Grid electricity used in the period", _cents(F.col("grid_kwh")), "kWh",
               "electricity_readings", F.concat(F.lit("Converted at "), F.coalesce(
                   plain(F.col("kg_co2e_per_unit")), F.lit("the supplied factor")), F.lit(" kg CO2e per kWh."))),
        metric("ACTIVITY-METERS", "Electricity meters with readings", F.col("meters"), "meters", "meters",
               F.concat(F.col("meter_readings").cast("string"), F.lit(" monthly readings")))))
    return out


def incident_facts(v6, findings, incidents) -> list[DataFrame]:
    severities = reports.count_incidents_by_severity(v6)
    total = severities.groupBy("company_id").agg(F.sum("incident_count").alias("n"))
    out = [_block(total, 10, metric("INCIDENTS-TOTAL", "Incidents in the register", F.col("n"), "incidents", REGISTER))]
    name = F.coalesce(F.col("severity").cast("string"), F.lit("UNRECORDED"))
    out.append(_block(severities, 11, metric(
        F.concat(F.lit("INCIDENTS-SEVERITY-"), name),
        F.when(F.col("severity").isNull(), F.lit("Incidents without a usable severity")).otherwise(
            F.concat(F.lit("Incidents at severity "), name, F.lit(" (1 minor, 2 moderate, 3 serious)"))),
        F.col("incident_count"), "incidents", REGISTER,
        sort_key=F.coalesce(F.col("severity"), F.lit(0)).cast("string"))))
    types = reports.count_incidents_by_type(v6)
    out.append(_block(types, 12, metric(
        F.concat(F.lit("INCIDENTS-TYPE-"), "type_code"),
        F.concat(F.lit("Incidents coded "), "type_code", F.lit(" ("), "type_label", F.lit(")")),
        F.col("incident_count"), "incidents", REGISTER, sort_key=F.col("type_code"))))
    summary = reports.finding_summary(findings).where("findings > 0")
    out.append(_block(
        summary, 13,
        metric("AI-FINDINGS-TOTAL", "Incident descriptions with a machine-written finding", F.col("findings"),
               "incidents", "ai_incident_findings",
               F.concat(F.lit("Model "), F.coalesce("model", F.lit("unknown")), F.lit(", prompt "),
                        F.coalesce("prompt_version", F.lit("unknown")),
                        F.lit("; every finding quotes its incident verbatim."))),
        metric("AI-PSYCHOSOCIAL-COUNT", "Incidents read as psychosocial hazards", F.col("psychosocial"),
               "incidents", "ai_incident_findings"),
        metric("AI-SEVERITY-MISMATCH-COUNT", "Incidents whose text does not support the recorded severity",
               F.col("severity_mismatches"), "incidents", "ai_incident_findings")))
    order = F.concat_ws(" ", F.col("incident_date").cast("string"), F.col("incident_id"))
    hazards = reports.flagged_incidents(findings, incidents, "psychosocial")
    out.append(_block(hazards, 50, record(
        F.col("incident_id"), F.concat(F.lit("Incident "), "incident_id", F.lit(", read as a psychosocial hazard")),
        F.col("incident_date"), READ_REGISTER,
        F.concat(F.lit("coded "), "type_code", F.lit(", recorded severity "), _severity_text("severity"),
                 F.lit(", location "), "location", F.lit(". Description: \""), "description",
                 F.lit("\". Category "), "category", F.lit("; quote: \""), "evidence_quote", F.lit("\"")),
        sort_key=order)))
    mismatches = reports.flagged_incidents(findings, incidents, "mismatch")
    out.append(_block(mismatches, 51, record(
        F.col("incident_id"), F.concat(F.lit("Incident "), "incident_id", F.lit(", severity contradicted by its text")),
        F.col("incident_date"), READ_REGISTER,
        F.concat(F.lit("recorded severity "), _severity_text("severity"), F.lit(", assessed as "),
                 F.coalesce(F.col("severity_assessment").cast("string"), F.lit("unknown")),
                 F.lit(". Description: \""), "description", F.lit("\". Quote: \""), "evidence_quote", F.lit("\"")),
        sort_key=order)))
    return out


def quality_facts(issues, rules) -> list[DataFrame]:
    source = "data_quality_issues"
    out = [_block(reports.issue_totals(issues), 20,
                  metric("DQ-ISSUES-TOTAL", "Data-quality findings on the source files", F.col("total_issues"),
                         "findings", source),
                  metric("DQ-RULES-TRIGGERED", "Data-quality rules that fired", F.col("rules_triggered"), "rules", source))]
    for n, column in [(21, "severity"), (22, "action")]:
        key = F.col("key")
        note = None
        if column == "action":
            note = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_NOTES.items() for x in kv]), key)
        out.append(_block(reports.issues_by(issues, column), n, metric(
            F.concat(F.lit(f"DQ-{column.upper()}-"), F.upper(key)),
            F.concat(F.lit(f"Data-quality findings with {column} '"), key, F.lit("'")),
            F.col("issue_count"), "findings", source, note, sort_key=key)))
    out.append(_block(reports.issues_by_rule(issues, rules), 52, record(
        F.col("rule_id"), F.col("title"), F.col("issue_count"), F.col("source_file"),
        F.concat(F.col("issue_count").cast("string"), F.lit(" finding(s), severity "), "severity",
                 F.lit(", action "), "action", F.lit(". "), "rationale"),
        number=True, sort_key=F.col("rule_id"))))
    return out


def supplier_facts(suppliers) -> DataFrame:
    totals = reports.supplier_totals(suppliers).where("supplier_count > 0")
    return _block(
        totals, 30,
        metric("SUPPLIERS-COUNT", "Suppliers after linking duplicates", F.col("supplier_count"), "suppliers", "suppliers"),
        metric("SUPPLIERS-DUPLICATES-MERGED", "Supplier rows linked as duplicates", F.col("duplicate_count"), "rows", "suppliers"),
        metric("SUPPLIERS-INVALID-ABN", "Supplier rows without a valid business number", F.col("invalid_abn_count"),
               "rows", "suppliers"),
        metric("SUPPLIERS-SPEND-AUD", "Supplier spend of the financial year",
               _cents(F.col("consolidated_spend_aud")), "AUD", "suppliers"))


def constant_facts(tenants: DataFrame) -> DataFrame:
    return _block(
        tenants.select("company_id"), 31,
        metric("SCOPE3-STATUS", "Scope 3 position", "Not calculable from this export", None, "derived",
               "Spend and category are known, but there is no spend-based factor.", number=False),
        metric("INTENSITY-STATUS", "Emissions intensity position", "Not calculable from this export", None, "derived",
               "There is no production figure to divide by.", number=False))


def outage_facts(outage: Outage) -> list[DataFrame]:
    source = "outage analysis (detected)"
    found = outage.summary.where("detected")

    def change(fact_id, what, column, detail=None):
        return metric(fact_id, f"Change in {what} in that month against the median month",
                      _tenths(F.col(column)), "%", source, detail)

    out = [_block(
        found, 40,
        metric("OUTAGE-MONTH", "Month whose grid draw falls far below the others",
               F.date_format("outage_month", "MMMM yyyy"), None, source,
               "Found by the outlier test of the data-quality rules.", number=False),
        change("OUTAGE-GRID-CHANGE-PCT", "grid draw", "grid_change_pct",
               F.concat(F.col("meters_below_baseline").cast("string"), F.lit(" of "),
                        F.col("meter_count").cast("string"), F.lit(" meters fell against their own history."))),
        change("OUTAGE-FUEL-CHANGE-PCT", "fuel volume", "fuel_change_pct",
               F.concat(plain(_cents(F.col("excess_litres"))), F.lit(" litres above a normal month, in "),
                        F.col("delivery_count").cast("string"), F.lit(" deliveries."))),
        change("OUTAGE-SCOPE1-CHANGE-PCT", "Scope 1", "scope1_change_pct"),
        change("OUTAGE-SCOPE2-CHANGE-PCT", "Scope 2", "scope2_change_pct"),
        change("OUTAGE-TOTAL-CHANGE-PCT", "total emissions", "total_change_pct",
               "A single total hides that one scope rose while the other fell."),
        metric("OUTAGE-SCOPE1-SHARE-PCT", "Scope 1 share in that month", _tenths(F.col("actual_share")), "%", source,
               F.concat(F.lit("Against "), plain(_tenths(F.col("baseline_share"))), F.lit("% in a median month."))),
        metric("OUTAGE-COUNTERFACTUAL-T", "Emissions of that month on normal supply",
               _tonnes(F.col("counterfactual_total")), "t CO2e", source,
               F.concat(F.lit("Reported total "), plain(_tonnes(F.col("actual_total"))),
                        F.lit(" t. A comparison with the median month, not a forecast."))))]
    order = F.concat_ws(" ", F.col("incident_date").cast("string"), F.col("id"))
    text = F.concat(F.lit("coded "), "type_code", F.lit(", severity "), _severity_text("severity"))
    described = F.concat(F.lit(". Description: \""), "description", F.lit("\""))
    out.append(_block(outage.incidents.where("is_root_cause"), 53, record(
        F.col("id"), F.concat(F.lit("Incident "), "id", F.lit(", the register's cause of the outage month")),
        F.col("incident_date"), REGISTER, F.concat(text, described), sort_key=order)))
    out.append(_block(outage.incidents.where("is_psychosocial"), 54, record(
        F.col("id"), F.concat(F.lit("Incident "), "id", F.lit(", inside the outage window")),
        F.col("incident_date"), READ_REGISTER,
        F.concat(text, F.lit(", category "), F.coalesce("ai_category", F.lit("unclassified")), described), sort_key=order)))
    return out


def merge_records(facts: DataFrame) -> DataFrame:
    """One fact per id: first value kept, labels and details joined in arrival order.

    Metric ids are unique and pass by. A record is reached from a handful of blocks.
    """
    order = F.struct("block", "sort_key", "label", "value", "value_num", "unit", "source", "detail")
    records = facts.where("kind = 'record'").groupBy("company_id", "id", "kind") \
        .agg(F.array_sort(F.collect_list(order)).alias("r"))
    first = F.get("r", F.lit(0))
    merged = records.select(
        "company_id", first["block"].alias("block"), first["sort_key"].alias("sort_key"), "id", "kind",
        F.array_join(F.transform("r", lambda x: x["label"]), "; ").alias("label"),
        first["value"].alias("value"), first["value_num"].alias("value_num"), first["unit"].alias("unit"),
        first["source"].alias("source"), F.array_join(F.transform("r", lambda x: x["detail"]), "; ").alias("detail"))
    return facts.where("kind = 'metric'").unionByName(merged)


def build_fact_pack(fuel, readings, meters, incidents, suppliers, findings, issues, factors, types, rules,
                    outage: Outage | None = None) -> DataFrame:
    """Facts of all tenants; pack order is ``(kind, block, sort_key, id)``.

    A tenant without any month of emissions has an empty pack.
    """
    v1 = marts.monthly_emissions(fuel, readings, factors)
    v3 = marts.monthly_totals(v1)
    v6 = marts.incident_monthly(incidents, types)
    if outage is None:
        outage = explain(fuel, readings, meters, v3, incidents, findings, factors)
    tenants = v3.select("company_id").distinct()
    blocks = [
        *emission_facts(v1, v3, marts.financial_years(v3), reports.fuel_totals(fuel, factors),
                        reports.electricity_totals(readings, meters, factors)),
        *incident_facts(v6, findings, incidents), *quality_facts(issues, rules), supplier_facts(suppliers),
        constant_facts(tenants), *outage_facts(outage)]
    facts = blocks[0]
    for block in blocks[1:]:
        facts = facts.unionByName(block)
    return merge_records(facts).join(tenants, "company_id", "left_semi")
