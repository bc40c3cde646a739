"""The whole load: five CSV roles of many tenants to clean tables, ledger and audit."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.operators import contracts
from sitelens.operators.electricity import clean_electricity, gap_members
from sitelens.operators.factors import factor_table, global_factors, unmapped_activities
from sitelens.operators.fuel import clean_fuel
from sitelens.operators.grounding import load_findings
from sitelens.operators.incidents import clean_incidents
from sitelens.operators.ledger import unresolved_fixes
from sitelens.operators.rules import (
    EXPORT_FILES, FACTOR_FILE, FUEL_FILE, INCIDENT_FILE, POWER_FILE, SUPPLIER_FILE, rule_catalogue)
from sitelens.operators.suppliers import clean_suppliers
from sitelens.session import materialise
from sitelens.sinks import audit, tables
from sitelens.sinks.store import Load, Store
from sitelens.sources.artefacts import read_findings
from sitelens.sources.csv_export import intake, intake_problems, no_export, read_export
from sitelens.sources.reference import site_areas

TENANT_TABLES = ["data_quality_issues", "issue_members", "fuel_deliveries", "electricity_readings",
                 "incidents", "suppliers", "meters", "site_areas", "ai_incident_findings"]


class Clean(NamedTuple):
    tables: dict[str, DataFrame]
    factors: DataFrame
    refused: DataFrame       # company_id, reason: tenants whose batch is not loaded
    finding_counts: DataFrame | None


def clean_export(spark: SparkSession, root: str, findings_path: str | None = None,
                 files: DataFrame | None = None) -> Clean:
    """Read and clean every complete batch under ``root``; refuse the others whole.

    A tenant is refused for a missing, blank, doubled, unknown or binary file, for a
    broken CSV row, or for an emission activity without a factor key.
    """
    files = materialise(intake(spark, root)) if files is None else files
    problems = intake_problems(files)
    reasons = [problems.select("company_id", F.concat_ws(" ", "role", "problem").alias("reason"))]
    sent = {r.role for r in files.where(F.col("role").isin(EXPORT_FILES)).select("role").distinct().collect()}
    exports = {name: read_export(spark, root, name) if name in sent else no_export(spark, name)
               for name in EXPORT_FILES}
    for name, export in exports.items():
        worst = export.broken.groupBy("company_id").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("source_row_number", "problem")).alias("f"))
        reasons.append(worst.select("company_id", F.concat(
            F.lit(f"{name}: "), F.col("n").cast("string"), F.lit(" unreadable row(s), first at line "),
            F.col("f.source_row_number").cast("string"), F.lit(": "), "f.problem").alias("reason")))
    all_factors = factor_table(exports[FACTOR_FILE].rows)
    reasons.append(unmapped_activities(all_factors).select("company_id", F.concat(
        F.lit("no factor key for activity '"), "activity", F.lit("'")).alias("reason")))
    refused = reasons[0]
    for more in reasons[1:]:
        refused = refused.unionByName(more)
    # One reason per tenant: its smallest text, an aggregate of fixed size.
    refused = materialise(refused.groupBy("company_id").agg(F.min("reason").alias("reason")))

    def admitted(df: DataFrame) -> DataFrame:
        # Anti-join against the few refused tenants; Spark broadcasts them when small.
        return df.join(refused.select("company_id"), "company_id", "left_anti")

    fuel = clean_fuel(admitted(exports[FUEL_FILE].rows), admitted(exports[FUEL_FILE].headers), stage=materialise)
    power = clean_electricity(admitted(exports[POWER_FILE].rows), stage=materialise)
    register = clean_incidents(admitted(exports[INCIDENT_FILE].rows), stage=materialise)
    partners = clean_suppliers(admitted(exports[SUPPLIER_FILE].rows), stage=materialise)
    issues = fuel.issues.unionByName(power.issues).unionByName(register.issues).unionByName(partners.issues)
    places = fuel.facts.select("company_id", "site_area").unionByName(
        register.facts.select("company_id", "site_area"))
    _, fresh = tables.known_site_areas(site_areas(spark), places)
    clean = {
        "data_quality_issues": issues, "issue_members": register.members.unionByName(gap_members(power.meters)), "fuel_deliveries": fuel.facts,
        "electricity_readings": power.facts, "incidents": register.facts, "suppliers": partners.facts,
        "meters": power.meters, "site_areas": fresh}
    counts = None
    if findings_path is not None:
        found = read_findings(spark, findings_path)
        clean["ai_incident_findings"], counts = load_findings(found, register.facts)
    return Clean(clean, global_factors(admitted(all_factors)), refused, counts)


def run_load(spark: SparkSession, root: str, out: str, source: str = "cli",
             findings_path: str | None = None) -> int:
    """Clean, check and publish every complete batch under ``root``; the version's number.

    All tables, the global ones and the audit become visible with one pointer, or none does
    (see ``sinks.store``). Whatever is thrown on the way is audited for every tenant of the
    batch, and thrown on.
    """
    return attempt_load(Store(spark, out), lambda: materialise(intake(spark, root)),
                        lambda files: clean_export(spark, root, findings_path, files), source)


def attempt_load(store: Store, list_files: Callable[[], DataFrame], clean: Callable[[DataFrame], Clean],
                 source: str = "cli") -> int:
    """One audited attempt: list the files, clean them, publish; see ``run_load``."""
    load = store.begin()
    files = None
    try:
        files = list_files()
        return publish_clean(store, load, files, clean(files), source)
    except Exception as error:
        audit.record_failure(store, load, files, f"{type(error).__name__}: {error}", source)
        raise


def publish_clean(store: Store, load: Load, files: DataFrame, clean: Clean, source: str = "cli") -> int:
    """Write cleaned tables as a load, check them, and publish them with their audit.

    A tenant whose rows break a contract keeps its former rows and is audited as failed.
    """
    spark = store.spark
    loaded = files.select("company_id").distinct().join(clean.refused, "company_id", "left_anti")
    load.tenants = loaded.count()
    severe = {"errors": F.count_if(F.col("severity") == "error")}
    stored = {name: load.write(name, df, **(severe if name == "data_quality_issues" else {}))
              for name, df in clean.tables.items()}
    if not unresolved_fixes(stored["data_quality_issues"]).isEmpty():
        raise ValueError("a ledger row claims a fix without a resolved value")
    # Keys that an earlier load stored count as well.
    known_factors = load.write("emission_factors", tables.upserted(
        store.read("emission_factors", load.base), clean.factors, ["factor_key"]), per_tenant=False)
    load.write("data_quality_rules", tables.upserted(
        store.read("data_quality_rules", load.base), rule_catalogue(spark), ["rule_id"]), per_tenant=False)
    broken = contracts.validate([
        *contracts.fuel_checks(stored["fuel_deliveries"], known_factors,
                               _areas(spark, stored)), *contracts.supplier_checks(stored["suppliers"]),
        contracts.unique(stored["incidents"], "incident-unique", ["company_id", "id"]),
        *contracts.reading_checks(stored["electricity_readings"], stored["meters"])])
    violated = materialise(broken.groupBy("company_id").agg(
        F.min(F.concat_ws(" ", "check_id", "key")).alias("reason")).where("company_id is not null"))
    passed = materialise(loaded.join(violated, "company_id", "left_anti").select("company_id"))
    lost = clean.refused.select("company_id", "reason").unionByName(violated)
    audit.record(load, files, passed, lost, stored["data_quality_issues"], list(clean.tables), source)
    # Findings speak about incidents that this load replaces, so the tenants' old ones go with them.
    number = load.publish(passed, TENANT_TABLES, ["emission_factors", "data_quality_rules"], audit.TABLES)
    load.drop_unpublished(TENANT_TABLES, violated)
    return number


def _areas(spark: SparkSession, stored: dict[str, DataFrame]) -> DataFrame:
    known = site_areas(spark).unionByName(stored["site_areas"])
    places = stored["fuel_deliveries"].select("company_id", "site_area").unionByName(
        stored["incidents"].select("company_id", "site_area"))
    return tables.known_site_areas(known, places)[0]


def save_reports(spark: SparkSession, out: str, reports: DataFrame) -> int:
    """Upsert reports by tenant, model, prompt version and fact digest; the newest of a key stays.

    Only the tenants that have new reports are written; the others' rows are not read.
    """
    store = Store(spark, out)
    load = store.begin()
    touched = materialise(reports.select("company_id").distinct())
    current = store.read("reports", load.base)
    if current is not None:
        current = current.join(touched, "company_id", "left_semi")
    load.write("reports", tables.upserted(current, reports, ["company_id", "model", "prompt_version", "fact_digest"], "created_at"))
    return load.publish(touched, ["reports"])


def remove_company(spark: SparkSession, out: str, company_id: int) -> None:
    """Cascade delete of one tenant: every table it has rows in, reports and load audit included."""
    Store(spark, out).remove_tenant(company_id)
