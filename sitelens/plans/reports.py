"""Report queries over marts and tables. Each serves all tenants, or one when asked.

``company`` and the other optional arguments become predicates only when given, so
partition pruning and pushdown see exactly what the caller asked for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.normalise import month_start
from sitelens.operators.ledger import newest_first
from sitelens.operators.rules import CATALOGUE, INCIDENT_FILE
from sitelens.sources.reference import GRID_FACTOR_KEY


def for_company(df: DataFrame, company: int | None) -> DataFrame:
    return df if company is None else df.where(F.col("company_id") == company)


def in_months(df: DataFrame, first: dt.date | None, last: dt.date | None, column: str = "month") -> DataFrame:
    """Inclusive month range; an absent bound adds no predicate."""
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first))
    if last is not None:
        df = df.where(F.col(column) <= F.lit(last))
    return df


def _ym(column: str):
    return F.date_format(column, "yyyy-MM").alias(column)


def _keep(df: DataFrame, *columns):
    return df.select("company_id", *columns)


# -------------------------------------------------------------------- emissions

def find_monthly_totals(v3, company=None, first=None, last=None):
    """Q1. The movement is computed over all months, then the range is applied."""
    return _keep(in_months(for_company(v3, company), first, last), _ym("month"),
                 *[c for c in v3.columns if c not in ("company_id", "month", "previous_month_kg_co2e")]) \
        .orderBy("company_id", "month")


def find_activity_breakdown(v1, company=None, first=None, last=None):
    """Q2."""
    return _keep(in_months(for_company(v1, company), first, last), _ym("month"), "scope", "activity",
                 "factor_key", "activity_amount", "activity_unit", "kg_co2e", "contributing_records",
                 "has_imprecise_dates").orderBy("company_id", "month", "scope", "activity")


def find_scope1_by_site_area(v4, company=None, first=None, last=None):
    """Q3."""
    return in_months(for_company(v4, company), first, last) \
        .groupBy("company_id", "site_area", "site_area_category", "fuel_type").agg(
        F.sum("litres").alias("litres"), F.sum("kg_co2e").alias("kg_co2e"),
        F.sum("delivery_count").alias("delivery_count")) \
        .orderBy("company_id", F.desc("kg_co2e"), "site_area", "fuel_type")


def find_period_totals(v3, company=None):
    """Q4, never limited to a range."""
    return for_company(v3, company).groupBy("company_id").agg(
        F.sum("scope1_kg_co2e").alias("scope1_kg_co2e"), F.sum("scope2_kg_co2e").alias("scope2_kg_co2e"),
        F.sum("total_kg_co2e").alias("total_kg_co2e"), F.count(F.lit(1)).alias("months"),
        F.date_format(F.min("month"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("month"), "yyyy-MM").alias("last_month"),
        F.sum("quality_error_count").alias("quality_error_count"))


def find_financial_years(v5, company=None):
    """Q5."""
    return _keep(for_company(v5, company), "financial_year", "scope1_kg_co2e", "scope2_kg_co2e",
                 "total_kg_co2e", "months_with_data", "is_complete_year", _ym("first_month"),
                 _ym("last_month")).orderBy("company_id", "financial_year")


def find_extreme_months(v3, company=None):
    """Q6. Equal totals go to the earlier month."""
    base = for_company(v3, company)
    month = F.date_format("month", "yyyy-MM")
    best = base.groupBy("company_id").agg(
        F.min(F.struct((-F.col("total_kg_co2e")).alias("k"), month.alias("month"), "total_kg_co2e")).alias("highest"),
        F.min(F.struct(F.col("total_kg_co2e").alias("k"), month.alias("month"), "total_kg_co2e")).alias("lowest"))
    return best.select("company_id", F.explode(F.array(
        F.struct(F.lit("highest").alias("kind"), F.col("highest.month").alias("month"),
                 F.col("highest.total_kg_co2e").alias("total_kg_co2e")),
        F.struct(F.lit("lowest").alias("kind"), F.col("lowest.month").alias("month"),
                 F.col("lowest.total_kg_co2e").alias("total_kg_co2e")))).alias("e")) \
        .select("company_id", "e.month", "e.total_kg_co2e", "e.kind")


def site_area_tonnes(v4, company=None):
    """Q28: Scope 1 tonnes per area over all fuels."""
    return for_company(v4, company).groupBy("company_id", "site_area").agg(F.sum("kg_co2e").alias("kg")) \
        .select("company_id", "site_area", F.floor(F.col("kg") / 1000 + F.expr("0.5BD")).alias("tonnes"), "kg") \
        .orderBy("company_id", F.desc("kg"), "site_area").drop("kg")


# -------------------------------------------------------------------- incidents

def latest_findings(findings: DataFrame) -> DataFrame:
    """Newest finding per incident; ties go to the larger model and prompt name."""
    newest = F.max(F.struct("created_at", "model", "prompt_version", "category", "is_psychosocial",
                            "severity_mismatch", "severity_assessment", "evidence_quote"))
    return findings.groupBy("company_id", "incident_id").agg(newest.alias("f")).select(
        "company_id", F.col("incident_id").alias("id"), "f.*")


def find_incidents(incidents, types, findings, issues, company=None, month=None, first=None, last=None,
                   type_code=None, severity=None, psychosocial=None, search=None):
    """Q7: the register with newest finding and issue count. All filters are AND-ed.

    ``search`` is a case-insensitive contains on description, location and id in
    which ``%`` and ``_`` act as wildcards.
    """
    rows = for_company(incidents, company)
    if month is not None:
        rows = rows.where(month_start(F.col("incident_date")) == F.lit(month))
    if first is not None:
        rows = rows.where(F.col("incident_date") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("incident_date") < F.add_months(F.lit(last), 1))
    if type_code is not None:
        rows = rows.where(F.col("type_code") == type_code)
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if search is not None and search.strip():
        needle = f"%{search.strip()}%"
        rows = rows.where(F.col("description").ilike(needle) | F.col("location_raw").ilike(needle)
                          | F.col("id").ilike(needle))
    labels = F.broadcast(types.select(F.col("code").alias("type_code"), F.col("label").alias("type_label")))
    counts = for_company(issues, company).where(F.col("source_file") == INCIDENT_FILE) \
        .groupBy("company_id", "source_row_number").agg(F.count(F.lit(1)).alias("quality_issue_count"))
    read = latest_findings(for_company(findings, company)).select(
        "company_id", "id", "is_psychosocial", "severity_mismatch", "category")
    joined = rows.join(labels, "type_code", "left").join(read, ["company_id", "id"], "left") \
        .join(counts, ["company_id", "source_row_number"], "left")
    hazard = F.coalesce("is_psychosocial", F.lit(False))
    if psychosocial is not None:
        joined = joined.where(hazard == F.lit(psychosocial))
    return joined.select(
        "company_id", "id", "source_incident_id", F.date_format("incident_date", "yyyy-MM-dd").alias("incident_date"),
        F.col("location_raw").alias("location"), "type_code", "type_label", "severity", "severity_raw",
        "description", "source_row_number", hazard.alias("ai_is_psychosocial"),
        F.coalesce("severity_mismatch", F.lit(False)).alias("ai_severity_mismatch"),
        F.col("category").alias("ai_category"),
        F.coalesce("quality_issue_count", F.lit(0)).alias("quality_issue_count")) \
        .orderBy("company_id", "incident_date", "id")


def incident_audit_trail(incidents, issues, rules, findings, company=None):
    """Q8 for all incidents: one row per issue or finding of an incident.

    Kept long instead of nested, so an incident with many entries is many rows. The
    quote of every finding is checked again against the description.
    """
    base = for_company(incidents, company)
    titles = F.broadcast(rules.select("rule_id", "title", "rationale"))
    ledger = for_company(issues, company).where(F.col("source_file") == INCIDENT_FILE) \
        .where("source_row_number is not null").join(titles, "rule_id")
    none = F.lit(None).cast("string")
    problems = base.select("company_id", "id", "source_row_number").join(
        ledger, ["company_id", "source_row_number"]).select(
        "company_id", "id", F.lit("issue").alias("entry"), F.col("rule_id").alias("name"), "title",
        "severity", "action", F.col("description").alias("text"), "original_value", "resolved_value",
        F.lit(None).cast("boolean").alias("evidence_verified"),
        F.lit(None).cast("timestamp").alias("created_at"))
    read = for_company(findings, company).withColumnRenamed("incident_id", "id").join(
        base.select("company_id", "id", F.col("description").alias("source_text")), ["company_id", "id"]).select(
        "company_id", "id", F.lit("finding").alias("entry"), F.col("category").alias("name"),
        F.concat_ws(" ", "model", "prompt_version").alias("title"),
        F.col("severity_assessment").cast("string").alias("severity"), none.alias("action"),
        F.col("evidence_quote").alias("text"), none.alias("original_value"), none.alias("resolved_value"),
        F.contains("source_text", "evidence_quote").alias("evidence_verified"), "created_at")
    return problems.unionByName(read).orderBy(
        "company_id", "id", F.desc("entry"), F.desc_nulls_last("created_at"), "severity", "name")


def count_incidents_by_month(v6, company=None, first=None, last=None):
    """Q9. A severity that does not occur in a month is null, not 0."""
    def sev(n):
        return F.sum(F.when(F.col("severity") == n, F.col("incident_count"))).alias(f"severity_{n}")
    return in_months(for_company(v6, company), first, last).groupBy("company_id", _ym("month")).agg(
        F.sum("incident_count").alias("incident_count"), sev(3), sev(2), sev(1)).orderBy("company_id", "month")


def count_incidents_by_type(v6, company=None, first=None, last=None):
    """Q10."""
    return in_months(for_company(v6, company), first, last) \
        .groupBy("company_id", "type_code", F.coalesce("type_label", F.lit("Unknown code")).alias("type_label")) \
        .agg(F.sum("incident_count").alias("incident_count")) \
        .orderBy("company_id", F.desc("incident_count"), "type_code")


def count_incidents_by_severity(v6, company=None, first=None, last=None):
    """Q11. Unknown severity comes last."""
    return in_months(for_company(v6, company), first, last).groupBy("company_id", "severity") \
        .agg(F.sum("incident_count").alias("incident_count")) \
        .orderBy("company_id", F.asc_nulls_last("severity"))


# ----------------------------------------------------------------- data quality

def issue_totals(issues, company=None):
    """Q12."""
    return for_company(issues, company).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_distinct("rule_id").alias("rules_triggered"))


def issues_by_file(issues, company=None):
    """Q13."""
    def n(severity, name):
        return F.count_if(F.col("severity") == severity).alias(name)
    return for_company(issues, company).groupBy("company_id", "source_file").agg(
        F.count(F.lit(1)).alias("issue_count"), n("error", "errors"), n("warning", "warnings"), n("info", "infos")) \
        .orderBy("company_id", F.desc("issue_count"), "source_file")


def issues_by(issues, column, company=None):
    """Q14, ``column`` is ``severity`` or ``action``."""
    if column not in ("severity", "action"):
        raise ValueError(column)
    return for_company(issues, company).groupBy("company_id", F.col(column).alias("key")) \
        .agg(F.count(F.lit(1)).alias("issue_count")).orderBy("company_id", F.desc("issue_count"), "key")


def issues_by_rule(issues, rules, company=None):
    """Q15: fired rules with title and reason. Counted before the catalogue is joined."""
    counted = for_company(issues, company).groupBy("company_id", "rule_id") \
        .agg(F.count(F.lit(1)).alias("issue_count"))
    return counted.join(F.broadcast(rules), "rule_id").select(
        "company_id", "rule_id", "title", "source_file", "category",
        F.col("default_severity").alias("severity"), F.col("default_action").alias("action"),
        "rationale", "issue_count").orderBy("company_id", F.desc("issue_count"), "rule_id")


def find_issues(issues, rules, company=None, source_file=None, severity=None, action=None, rule_id=None,
                search=None, limit=200):
    """Q16: worst first, at most ``limit`` rows per tenant (1 to 500)."""
    rows = for_company(issues, company)
    for column, value in [("source_file", source_file), ("severity", severity), ("action", action),
                          ("rule_id", rule_id)]:
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if search is not None and search.strip():
        needle = f"%{search.strip()}%"
        rows = rows.where(F.col("description").ilike(needle) | F.col("record_key").ilike(needle)
                          | F.col("rule_id").ilike(needle))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    order = [rank, F.col("source_file"), F.asc_nulls_first("source_row_number"), F.col("rule_id"),
             F.asc_nulls_first("record_key"), F.asc_nulls_first("field")]
    # Spark keeps ``limit`` rows per tenant in every task before the shuffle.
    top = rows.withColumn("position", F.row_number().over(Window.partitionBy("company_id").orderBy(*order))) \
        .where(F.col("position") <= limit)
    return top.join(F.broadcast(rules.select("rule_id", F.col("title").alias("rule_title"), "rationale")), "rule_id") \
        .orderBy("company_id", "position")


def find_all_rules(issues, company=None, tenants=None):
    """Q17: the whole catalogue per tenant; a silent rule counts 0.

    ``tenants`` names them all (company_id); without it, those with issues.
    """
    rows = for_company(issues, company)
    hits = rows.groupBy("company_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    catalogue = F.array(*[F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.source_file).alias("source_file"),
        F.lit(r.category).alias("category"), F.lit(r.default_severity).alias("severity"),
        F.lit(r.default_action).alias("action"), F.lit(r.rationale).alias("rationale")) for r in CATALOGUE])
    named = hits if tenants is None else for_company(tenants, company)
    return named.select("company_id").distinct().select("company_id", F.explode(catalogue).alias("r")) \
        .select("company_id", "r.*").join(hits, ["company_id", "rule_id"], "left") \
        .withColumn("issue_count", F.coalesce("n", F.lit(0))).drop("n") \
        .orderBy("company_id", F.desc("issue_count"), "rule_id")


def rule_activity(issues, company=None, tenants=None):
    """Q17: how many rules fired and how many stayed silent."""
    return find_all_rules(issues, company, tenants).groupBy("company_id").agg(
        F.count_if(F.col("issue_count") > 0).alias("triggered"),
        F.count_if(F.col("issue_count") == 0).alias("silent"))


# -------------------------------------------------------------------- suppliers

def find_suppliers(suppliers, company=None):
    """Q18: consolidated spend stands on primary rows only."""
    rows = for_company(suppliers, company)
    linked = rows.where("duplicate_of_row is not null") \
        .groupBy("company_id", F.col("duplicate_of_row").alias("source_row_number")) \
        .agg(F.sum("fy_spend_aud").alias("linked_spend"))
    # Primary rows are unique, so the join is one-to-one; it is merged, because a broadcast of the
    # linked sums would pass the driver and grow with the register. Unknown only if both parts are.
    spend = F.when(F.col("fy_spend_aud").isNotNull() | F.col("linked_spend").isNotNull(),
                   F.coalesce("fy_spend_aud", F.expr("0BD")) + F.coalesce("linked_spend", F.expr("0BD")))
    return rows.join(linked.hint("merge"), ["company_id", "source_row_number"], "left").select(
        "company_id", "source_row_number", "supplier_name", "name_canonical", "abn_raw", "abn", "abn_valid",
        "category", "category_canonical", "fy_spend_aud", "duplicate_of_row", "duplicate_of_name",
        F.when(F.col("duplicate_of_row").isNull(), spend).alias("consolidated_spend_aud")) \
        .orderBy("company_id", F.desc_nulls_last("fy_spend_aud"), "source_row_number")


def supplier_list_totals(suppliers, company=None):
    """Q18 footer; here an ABN is invalid when it does not have 11 digits."""
    rows = find_suppliers(suppliers, company)
    return rows.groupBy("company_id").agg(
        F.coalesce(F.sum("consolidated_spend_aud"), F.expr("0BD")).alias("consolidated_total_aud"),
        F.coalesce(F.sum("fy_spend_aud"), F.expr("0BD")).alias("raw_total_aud"),
        F.count_if(F.col("duplicate_of_row").isNotNull()).alias("duplicate_count"),
        F.count_if(F.col("abn").isNull() | (F.length("abn") != 11)).alias("malformed_abn_count"))


def supplier_totals(suppliers, company=None):
    """Q25; here an ABN is invalid when its checksum fails or it is absent."""
    return for_company(suppliers, company).groupBy("company_id").agg(
        F.count_if(F.col("duplicate_of_row").isNull()).alias("supplier_count"),
        F.count_if(F.col("duplicate_of_row").isNotNull()).alias("duplicate_count"),
        F.count_if(~F.col("abn_valid")).alias("invalid_abn_count"),
        F.coalesce(F.sum("fy_spend_aud"), F.expr("0BD")).alias("consolidated_spend_aud"))


# ------------------------------------------------------------- activity and load

def monthly_electricity(readings, company=None):
    """Q19. Meters are counted after one row per meter is left, so nothing is expanded."""
    return for_company(readings, company).groupBy("company_id", F.col("period").alias("month"), "meter_id") \
        .agg(F.sum("consumption_kwh").alias("kwh")) \
        .groupBy("company_id", "month").agg(F.sum("kwh").alias("consumption_kwh"),
                                            F.count(F.lit(1)).cast("int").alias("meter_count"))


def meter_history(readings, company=None):
    """Q20."""
    return for_company(readings, company).select("company_id", "meter_id", _ym("period"), "consumption_kwh") \
        .orderBy("company_id", "meter_id", "period")


def meters_for_month(readings, meters, month, company=None):
    """Q20: the meters of one month with their descriptions (meters are unique)."""
    return for_company(readings, company).where(F.col("period") == F.lit(month)) \
        .join(meters.select("company_id", "meter_id", "description"), ["company_id", "meter_id"], "left") \
        .select("company_id", "meter_id", "description", "consumption_kwh").orderBy("company_id", "meter_id")


def monthly_fuel(fuel, company=None):
    """Q21, credit notes netted."""
    return for_company(fuel, company).groupBy("company_id", month_start(F.col("delivery_date")).alias("month")) \
        .agg(F.sum("quantity_l").alias("litres"), F.count(F.lit(1)).cast("int").alias("delivery_count"))


def incidents_between(incidents, findings, first, last, company=None):
    """Q22 with the newest finding only, so an incident is never repeated."""
    read = latest_findings(for_company(findings, company)).select(
        "company_id", "id", "category", "is_psychosocial", "evidence_quote")
    return for_company(incidents, company).where(F.col("incident_date").between(F.lit(first), F.lit(last))) \
        .join(read, ["company_id", "id"], "left").select(
        "company_id", "id", "incident_date", "location_raw", "type_code", "severity", "description",
        F.col("category").alias("ai_category"), F.col("is_psychosocial").alias("ai_is_psychosocial"),
        F.col("evidence_quote").alias("ai_evidence_quote")).orderBy("company_id", "incident_date", "id")


def monthly_scopes(v3, company=None):
    """Q23."""
    return _keep(for_company(v3, company), _ym("month"), "scope1_kg_co2e", "scope2_kg_co2e",
                 "total_kg_co2e", "scope1_share_pct").orderBy("company_id", "month")


def grid_factor(factors):
    """Q23."""
    return factors.where(F.col("factor_key") == GRID_FACTOR_KEY).select("kg_co2e_per_unit")


def finding_summary(findings, company=None):
    """Q24."""
    return for_company(findings, company).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("is_psychosocial").alias("psychosocial"),
        F.count_if("severity_mismatch").alias("severity_mismatches"),
        F.max("model").alias("model"), F.max("prompt_version").alias("prompt_version"))


def flagged_incidents(findings, incidents, kind, company=None):
    """Q24, ``kind`` is ``psychosocial`` or ``mismatch``."""
    flag = {"psychosocial": "is_psychosocial", "mismatch": "severity_mismatch"}[kind]
    base = for_company(incidents, company).select(
        "company_id", F.col("id").alias("incident_id"), "incident_date", "type_code",
        F.col("location_raw").alias("location"), "severity", "description")
    return for_company(findings, company).where(flag).join(base, ["company_id", "incident_id"]).select(
        "company_id", "incident_id", "incident_date", "type_code", "location", "severity", "description",
        "category", "severity_assessment", "confidence", "evidence_quote") \
        .orderBy("company_id", "incident_date", "incident_id")


def fuel_totals(fuel, factors, company=None):
    """Q26: summed per factor first, then priced."""
    summed = for_company(fuel, company).groupBy("company_id", "factor_key").agg(
        F.sum("quantity_l").alias("quantity"), F.count(F.lit(1)).alias("deliveries"))
    return summed.join(F.broadcast(factors), "factor_key").select(
        "company_id", "factor_key", "activity", "unit", "kg_co2e_per_unit", "quantity", "deliveries") \
        .orderBy("company_id", "factor_key")


def electricity_totals(readings, meters, factors, company=None):
    """Q26."""
    drawn = for_company(readings, company).groupBy("company_id").agg(
        F.sum("consumption_kwh").alias("grid_kwh"), F.count(F.lit(1)).alias("meter_readings"))
    counted = for_company(meters, company).groupBy("company_id").agg(F.count(F.lit(1)).alias("meters"))
    rate = F.broadcast(grid_factor(factors).agg(F.max("kg_co2e_per_unit").alias("kg_co2e_per_unit"))
                       .withColumn("factor_key", F.lit(GRID_FACTOR_KEY)))
    return drawn.join(counted, "company_id", "left").withColumn("factor_key", F.lit(GRID_FACTOR_KEY)) \
        .join(rate, "factor_key", "left").select(
        "company_id", F.coalesce("grid_kwh", F.expr("0BD")).alias("grid_kwh"), "kg_co2e_per_unit",
        "meter_readings", F.coalesce("meters", F.lit(0)).alias("meters"))


def load_history(loads, company=None, n=20):
    """Q27: the newest loads per tenant."""
    return newest_first(for_company(loads, company), "started_at", n) \
        .orderBy("company_id", F.desc("started_at"))


def latest_report(reports, company=None):
    """Q29."""
    return newest_first(for_company(reports, company), "generated_at", 1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A12: rows of several tables."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out
