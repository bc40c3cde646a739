"""Table contracts as validation jobs: keys, ranges, vocabularies, references.

A contract is declared, not run. ``validate`` compiles all contracts of one table into a
single scan and a single aggregate: every row offers the keys it must not share, the
references it makes and the ranges it breaks, and these are counted together, map-side
first, so a rule broken by a third of a table still gives one row per key. Violations are
``(check_id, company_id, key, rows)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.operators.citations import CLAIM_KEY
from sitelens.operators.grounding import CATEGORIES, verify_findings


class Contract(NamedTuple):
    table: DataFrame
    check_id: str
    kind: str                          # unique, holds or refers
    keys: list[str]                    # columns that make the key
    applies: Column | None             # rows that are looked at; for a range, those that break it
    target: DataFrame | None = None    # where references must be found
    target_keys: list[str] | None = None


def unique(df: DataFrame, check_id: str, keys: list[str], where: Column | str | None = None) -> Contract:
    """No two rows have equal keys (nulls are equal)."""
    return Contract(df, check_id, "unique", keys, F.expr(where) if isinstance(where, str) else where)


def holds(df: DataFrame, check_id: str, condition: Column | str) -> Contract:
    """No row for which the condition is false (null passes, as in a SQL check), counted per tenant."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return Contract(df, check_id, "holds", [], ~F.coalesce(cond, F.lit(True)))


def refers(df: DataFrame, check_id: str, on: dict[str, str], target: DataFrame, where: Column | str | None = None) -> Contract:
    """Non-null references have a target. Distinct values are compared, not rows."""
    given = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    for c in on:
        given = given & F.col(c).isNotNull()
    return Contract(df, check_id, "refers", list(on), given, target, list(on.values()))


def _values(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns]) if columns else F.array().cast("array<string>")


def _compiled(table: DataFrame, contracts: list[Contract]) -> DataFrame:
    """All contracts of one table: one scan, one aggregate, and one anti-join if any refer."""
    offers = []
    for c in contracts:
        # A key without the tenant in it is unique over all tenants.
        owned = "company_id" in table.columns and (c.kind != "unique" or "company_id" in c.keys)
        offer = F.struct(F.lit(c.check_id).alias("check_id"),
                         (F.col("company_id").cast("bigint") if owned else F.lit(None).cast("bigint")).alias("company_id"),
                         _values(c.keys).alias("values"))
        offers.append(offer if c.applies is None else F.when(c.applies, offer))
    counted = table.select(F.explode(F.filter(F.array(*offers), lambda o: o.isNotNull())).alias("o")) \
        .groupBy("o.check_id", "o.company_id", "o.values").agg(F.count(F.lit(1)).alias("rows"))
    keyed = [c.check_id for c in contracts if c.kind == "unique"]
    found = counted.where((F.col("rows") > 1) | ~F.col("check_id").isin(keyed)) if keyed else counted
    targets = None
    for c in contracts:
        if c.kind == "refers":
            part = c.target.select(F.lit(c.check_id).alias("check_id"), _values(c.target_keys).alias("values")).distinct()
            targets = part if targets is None else targets.unionByName(part)
    if targets is not None:
        # Merged: a table's keys are as many as its rows, and a broadcast of them would pass the driver.
        found = found.join(targets.hint("merge"), ["check_id", "values"], "left_anti")
    with_tenant = [c.check_id for c in contracts if "company_id" in c.keys]
    shown = F.when(F.col("check_id").isin(with_tenant), F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0)))) \
        .otherwise(F.col("values")) if with_tenant else F.col("values")
    return found.select("check_id", "company_id", F.concat_ws("|", shown).alias("key"), "rows")


def validate(contracts: list[Contract]) -> DataFrame:
    """Violations of all contracts; tables are told apart as DataFrame objects."""
    tables: dict[int, list[Contract]] = {}
    for c in contracts:
        if "company_id" in c.keys[1:]:
            raise ValueError(f"{c.check_id}: the tenant comes first in a key")
        tables.setdefault(id(c.table), []).append(c)
    out = None
    for group in tables.values():
        part = _compiled(group[0].table, group)
        out = part if out is None else out.unionByName(part)
    return out


def fuel_checks(fuel, factors, areas) -> list[Contract]:
    return [
        unique(fuel, "fuel-invoice-unique", ["company_id", "invoice_no"]),
        holds(fuel, "fuel-credit-sign", "is_credit_note = (quantity_l < 0)"),
        holds(fuel, "fuel-precision", F.col("date_precision").isin("day", "month")),
        refers(fuel, "fuel-factor", {"factor_key": "factor_key"}, factors),
        refers(fuel, "fuel-site-area", {"company_id": "company_id", "site_area": "site_area"}, areas, "site_area <> ''"),
    ]


def reading_checks(readings, meters) -> list[Contract]:
    return [
        unique(readings, "reading-unique", ["company_id", "meter_id", "period"]),
        unique(meters, "meter-unique", ["company_id", "meter_id"]),
        holds(readings, "reading-not-negative", "consumption_kwh >= 0"),
        holds(readings, "reading-month-start", "period = trunc(period, 'MM')"),
        refers(readings, "reading-meter", {"company_id": "company_id", "meter_id": "meter_id"}, meters),
    ]


def incident_checks(incidents, types, areas) -> list[Contract]:
    return [
        unique(incidents, "incident-unique", ["company_id", "id"]),
        holds(incidents, "incident-severity", "severity between 1 and 3"),
        refers(incidents, "incident-type", {"type_code": "code"}, types),
        refers(incidents, "incident-site-area", {"company_id": "company_id", "site_area": "site_area"}, areas),
    ]


def supplier_checks(suppliers) -> list[Contract]:
    return [
        holds(suppliers, "supplier-not-own-duplicate", "duplicate_of_row <> source_row_number"),
        refers(suppliers, "supplier-primary", {"company_id": "company_id", "duplicate_of_row": "source_row_number"},
               suppliers),
    ]


def dimension_checks(factors, areas, companies=None) -> list[Contract]:
    """``areas``: name, category, company_id as stored (null company = global)."""
    out = [
        unique(factors, "factor-unique", ["factor_key"]),
        holds(factors, "factor-positive", "kg_co2e_per_unit > 0"),
        holds(factors, "factor-scope", "scope in (1, 2)"),
        holds(areas, "area-category", F.col("category").isin("pit", "fixed_plant", "fleet", "services", "unknown")),
        unique(areas, "area-global-unique", ["name"], "company_id is null"),
        unique(areas, "area-tenant-unique", ["company_id", "name"], "company_id is not null"),
    ]
    if companies is not None:
        out += [holds(companies, "company-slug", F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")),
                unique(companies, "company-slug-unique", ["slug"]),
                holds(companies, "company-abn", F.col("abn").rlike(r"^\d{11}$"))]
    return out


def email_check(users: DataFrame) -> Contract:
    return holds(users, "email-format", "email = lower(email) and email like '%@%'")


def ledger_checks(issues, rules) -> list[Contract]:
    return [
        holds(issues, "issue-fixed-has-value", "action <> 'fixed' or resolved_value is not null"),
        holds(issues, "issue-severity", F.col("severity").isin("error", "warning", "info")),
        holds(issues, "issue-action", F.col("action").isin("fixed", "flagged", "rejected")),
        refers(issues, "issue-rule", {"rule_id": "rule_id"}, rules),
        holds(rules, "rule-severity", F.col("default_severity").isin("error", "warning", "info")),
        holds(rules, "rule-action", F.col("default_action").isin("fixed", "flagged", "rejected")),
        unique(rules, "rule-unique", ["rule_id"]),
    ]


def load_checks(loads) -> list[Contract]:
    return [
        holds(loads, "load-failed-has-reason", "status <> 'failed' or failure_reason is not null"),
        holds(loads, "load-status", F.col("status").isin("succeeded", "failed")),
        holds(loads, "load-source", F.col("source").isin("upload", "cli")),
    ]


def finding_checks(findings, incidents) -> list[Contract]:
    """Among them the grounding contract: every stored quote is verbatim in its incident."""
    run = ["company_id", "incident_id", "model", "prompt_version"]
    bad = verify_findings(findings.drop("severity_mismatch", "recorded_severity"), incidents,
                          ["model", "prompt_version"])
    return [
        unique(findings, "finding-run-unique", run),
        holds(findings, "finding-assessment", "severity_assessment between 1 and 3"),
        holds(findings, "finding-confidence", "confidence between 0 and 1"),
        holds(findings, "finding-category", F.col("category").isin(CATEGORIES)),
        refers(findings, "finding-incident", {"company_id": "company_id", "incident_id": "id"}, incidents),
        holds(bad, "finding-grounded", "reason is null or reason = 'duplicate-finding'"),
    ]


def report_checks(reports, claims, facts) -> list[Contract]:
    """Every claim cited, every citation stored as a fact, no report without facts."""
    cited = claims.select(*CLAIM_KEY, F.explode_outer("citations").alias("id"))
    out = [
        unique(reports, "report-run-unique", ["company_id", "model", "prompt_version", "fact_digest"]),
        holds(reports, "report-period", F.col("period_from").rlike(r"^\d{4}-\d{2}$")
              & F.col("period_to").rlike(r"^\d{4}-\d{2}$")),
        holds(claims, "claim-cited", F.size(F.coalesce("citations", F.array())) > 0),
        refers(cited, "claim-citation-known", {"company_id": "company_id", "id": "id"}, facts),
        refers(reports, "report-has-facts", {"company_id": "company_id"}, facts),
    ]
    return out
