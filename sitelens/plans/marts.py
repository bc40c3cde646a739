"""Emission and incident marts (V1-V6). All keep the two-step rounding of money."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.normalise import month_start
from sitelens.sources.reference import GRID_FACTOR_KEY


def _branch(facts: DataFrame, month, amount: str, imprecise) -> DataFrame:
    return facts.groupBy(
        "company_id", month.alias("month"), "scope", "activity", "factor_key").agg(
        F.sum(amount).alias("activity_amount"),
        F.min("factor_unit").alias("activity_unit"),
        F.round(F.sum(F.col(amount) * F.col("kg_co2e_per_unit")), 2).alias("kg_co2e"),
        F.count(F.lit(1)).cast("int").alias("contributing_records"),
        F.sum("issue_count").cast("int").alias("quality_issue_count"),
        F.sum("error_count").cast("int").alias("quality_error_count"),
        F.bool_or(F.col("error_count") > 0).alias("has_quality_flags"),
        F.coalesce(F.bool_or(imprecise), F.lit(False)).alias("has_imprecise_dates"))


def monthly_emissions(fuel: DataFrame, readings: DataFrame, factors: DataFrame) -> DataFrame:
    """V1: per tenant, month, scope and activity.

    Facts carry their own issue counts (``operators.ledger.with_issue_counts`` adds
    them to tables that do not), so no join with the ledger is needed here. Factors
    are a handful of global rows and are broadcast.
    """
    rates = F.broadcast(factors.select(
        "factor_key", "scope", "activity", F.col("unit").alias("factor_unit"), "kg_co2e_per_unit"))
    burnt = _branch(fuel.join(rates, "factor_key"), month_start(F.col("delivery_date")),
                    "quantity_l", F.col("date_precision") == "month")
    drawn = _branch(readings.withColumn("factor_key", F.lit(GRID_FACTOR_KEY)).join(rates, "factor_key"),
                    F.col("period"), "consumption_kwh", F.lit(False))
    return burnt.unionByName(drawn)


def _quality():
    return [F.sum("contributing_records").cast("int").alias("contributing_records"),
            F.sum("quality_issue_count").cast("int").alias("quality_issue_count"),
            F.sum("quality_error_count").cast("int").alias("quality_error_count"),
            F.bool_or("has_quality_flags").alias("has_quality_flags"),
            F.bool_or("has_imprecise_dates").alias("has_imprecise_dates")]


def emissions_by_scope(v1: DataFrame) -> DataFrame:
    """V2."""
    return v1.groupBy("company_id", "month", "scope").agg(
        F.round(F.sum("kg_co2e"), 2).alias("kg_co2e"), *_quality())


def monthly_totals(v1: DataFrame) -> DataFrame:
    """V3: scopes side by side; movement against the previous month that has data.

    The window orders one tenant's months, at most 12 rows a year.
    """
    def scope(n: int):
        return F.round(F.coalesce(F.sum(F.when(F.col("scope") == n, F.col("kg_co2e"))),
                                  F.expr("0BD")), 2).cast("decimal(20,2)")
    by_month = v1.groupBy("company_id", "month").agg(
        scope(1).alias("scope1_kg_co2e"), scope(2).alias("scope2_kg_co2e"),
        F.round(F.sum("kg_co2e"), 2).cast("decimal(20,2)").alias("total_kg_co2e"), *_quality())
    previous = F.lag("total_kg_co2e").over(Window.partitionBy("company_id").orderBy("month"))
    total, before = F.col("total_kg_co2e"), F.col("previous_month_kg_co2e")
    share = F.when(total == 0, F.expr("0BD")).otherwise(
        (F.col("scope1_kg_co2e") * 100).cast("decimal(24,2)") / total)
    moved = F.when(before.isNotNull() & (before != 0),
                   ((total - before) * 100).cast("decimal(24,2)") / before)
    return by_month.withColumn("previous_month_kg_co2e", previous).select(
        "company_id", "month", "scope1_kg_co2e", "scope2_kg_co2e", "total_kg_co2e",
        F.round(share, 1).alias("scope1_share_pct"), "previous_month_kg_co2e",
        F.round(moved, 1).alias("month_on_month_pct"),
        "contributing_records", "quality_issue_count", "quality_error_count",
        "has_quality_flags", "has_imprecise_dates")


def scope1_by_site_area(fuel: DataFrame, factors: DataFrame, areas: DataFrame) -> DataFrame:
    """V4. ``areas``: resolved ``(company_id, site_area, category)`` of each tenant.

    Litres are summed per area first, so the area join sees one row per group and
    not one per delivery.
    """
    rates = F.broadcast(factors.select("factor_key", "kg_co2e_per_unit"))
    summed = fuel.join(rates, "factor_key").groupBy(
        "company_id", month_start(F.col("delivery_date")).alias("month"), "site_area", "fuel_type").agg(
        F.sum("quantity_l").alias("litres"),
        F.round(F.sum(F.col("quantity_l") * F.col("kg_co2e_per_unit")), 2).alias("kg_co2e"),
        F.count(F.lit(1)).cast("int").alias("delivery_count"))
    blank = F.coalesce(F.col("site_area"), F.lit("")) == ""
    return summed.join(areas, ["company_id", "site_area"], "left").select(
        "company_id", "month",
        F.when(blank, F.lit("(unrecorded)")).otherwise(F.col("site_area")).alias("site_area"),
        F.coalesce("category", F.lit("unknown")).alias("site_area_category"),
        "fuel_type", "litres", "kg_co2e", "delivery_count")


def financial_years(v3: DataFrame) -> DataFrame:
    """V5: July to June, named by the closing year; complete with exactly 12 months."""
    fy = F.year("month") + F.when(F.month("month") >= 7, 1).otherwise(0)
    return v3.groupBy("company_id", fy.alias("financial_year")).agg(
        F.round(F.coalesce(F.sum("scope1_kg_co2e"), F.expr("0BD")), 2).alias("scope1_kg_co2e"),
        F.round(F.coalesce(F.sum("scope2_kg_co2e"), F.expr("0BD")), 2).alias("scope2_kg_co2e"),
        F.round(F.sum("total_kg_co2e"), 2).alias("total_kg_co2e"),
        F.count(F.lit(1)).cast("int").alias("months_with_data"),
        (F.count(F.lit(1)) == 12).alias("is_complete_year"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.sum("quality_error_count").cast("int").alias("quality_error_count"))


def incident_monthly(incidents: DataFrame, types: DataFrame) -> DataFrame:
    """V6: counted first, labelled after."""
    counted = incidents.groupBy("company_id", month_start(F.col("incident_date")).alias("month"),
                                "type_code", "severity").agg(F.count(F.lit(1)).cast("int").alias("incident_count"))
    labels = F.broadcast(types.select(F.col("code").alias("type_code"), F.col("label").alias("type_label")))
    return counted.join(labels, "type_code", "left").select(
        "company_id", "month", "type_code", "type_label", "severity", "incident_count")
