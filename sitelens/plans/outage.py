"""Cross-dataset explanation of the month with an anomalous fall in grid draw."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sitelens.functions.normalise import month_start
from sitelens.functions.numbers import percent_change, round_half_up
from sitelens.functions.robust import median, robust_outliers
from sitelens.operators.skew import HOT_ROWS, attach, exact_median
from sitelens.plans.reports import latest_findings, monthly_electricity, monthly_fuel

MIN_MONTHS = 6
CAUSE_TYPE = "ELE"


class Outage(NamedTuple):
    summary: DataFrame    # one row per tenant with electricity
    meters: DataFrame     # each meter of the month against its own history
    incidents: DataFrame  # incidents of the window with their part in the story
    chain: DataFrame      # six evidence steps per detected tenant


def anomalous_month(electricity: DataFrame) -> DataFrame:
    """Lowest downward outlier per tenant (null when none); needs six months."""
    marked = robust_outliers(electricity, ["company_id"], "consumption_kwh")
    down = F.col("is_outlier") & (F.col("consumption_kwh") < F.col("median_value"))
    return marked.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("months_analysed"),
        F.min(F.when(down, F.struct("consumption_kwh", "month"))).alias("lowest")) \
        .select("company_id", "months_analysed",
                F.when(F.col("months_analysed") >= MIN_MONTHS, F.col("lowest.month")).alias("outage_month"))


def baselines(target: DataFrame, electricity: DataFrame, fuel: DataFrame, v3: DataFrame) -> DataFrame:
    """Actual value of the month, and median of the other months, for every series.

    Months without fuel stay out of the fuel, Scope 1 and share baselines: a
    paperwork gap is not a normal month. Everything here is monthly.
    """
    def series(df, name, value, keep=None):
        part = df.where(keep) if keep is not None else df
        return part.select("company_id", "month", F.lit(name).alias("series"), value.cast("double").alias("v"))
    fuelled = F.col("scope1_kg_co2e") > 0
    long = series(electricity, "kwh", F.col("consumption_kwh")) \
        .unionByName(series(fuel, "litres", F.col("litres"), F.col("litres") > 0)) \
        .unionByName(series(fuel, "deliveries", F.col("delivery_count"))) \
        .unionByName(series(v3, "scope1", F.col("scope1_kg_co2e"))) \
        .unionByName(series(v3, "scope1_fuelled", F.col("scope1_kg_co2e"), fuelled)) \
        .unionByName(series(v3, "scope2", F.col("scope2_kg_co2e"))) \
        .unionByName(series(v3, "total", F.col("total_kg_co2e"))) \
        .unionByName(series(v3, "share", F.col("scope1_share_pct"))) \
        .unionByName(series(v3, "share_fuelled", F.col("scope1_share_pct"), fuelled))
    same = F.col("month") == F.col("outage_month")

    def actual(name):
        return F.coalesce(F.max(F.when(same & (F.col("series") == name), F.col("v"))), F.lit(0.0))

    def normal(name):
        return median(F.when(~same & (F.col("series") == name), F.col("v")))

    return long.join(target.where("outage_month is not null"), "company_id").groupBy("company_id").agg(
        actual("kwh").alias("actual_kwh"), normal("kwh").alias("baseline_kwh"),
        actual("litres").alias("actual_litres"), normal("litres").alias("baseline_litres"),
        actual("deliveries").cast("int").alias("delivery_count"),
        actual("scope1").alias("actual_scope1"), normal("scope1_fuelled").alias("baseline_scope1"),
        actual("scope2").alias("actual_scope2"), normal("scope2").alias("baseline_scope2"),
        actual("total").alias("actual_total"),
        actual("share").alias("actual_share"), normal("share_fuelled").alias("baseline_share"))


def meter_changes(readings: DataFrame, meters: DataFrame, target: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every meter of the month against the median of its own other months."""
    sizes = readings.groupBy("company_id").agg(F.count(F.lit(1)).alias("key_rows"))
    narrow = readings.select("company_id", "meter_id", "period", "consumption_kwh", "source_row_number")
    dated = attach(narrow, sizes.join(target.select("company_id", "outage_month"), "company_id", "left"),
                   ["company_id"], "key_rows", F.col("source_row_number"), hot_rows).where("outage_month is not null")
    history = exact_median(dated.where("period <> outage_month"), ["company_id", "meter_id"],
                           "consumption_kwh", 2, "own_baseline")
    names = meters.select("company_id", "meter_id", "description")
    value = F.col("consumption_kwh").cast("double")
    own = F.coalesce("own_baseline", F.lit(0.0))
    # One tenant-month of readings; a meter has one reading there.
    return dated.where("period = outage_month").join(history, ["company_id", "meter_id"], "left") \
        .join(names, ["company_id", "meter_id"], "left").select(
        "company_id", "meter_id", "description", "consumption_kwh",
        round_half_up(own, 2).alias("baseline_kwh"), percent_change(value, own).alias("change_pct"),
        ((own > 0) & (value < own)).alias("below_baseline"))


def window_incidents(incidents: DataFrame, findings: DataFrame, target: DataFrame,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Incidents from the first of the month to the 28th of the next one.

    ``part``: root-cause (the most severe electrical one inside the month),
    consequence (psychosocial), or other. The long text joins only the few that stay.
    """
    narrow = incidents.select("company_id", "id", "incident_date", "type_code", "severity", "source_row_number")
    sizes = narrow.groupBy("company_id").agg(F.count(F.lit(1)).alias("key_rows"))
    dated = attach(narrow, sizes.join(target.select("company_id", "outage_month"), "company_id", "left"),
                   ["company_id"], "key_rows", F.col("source_row_number"), hot_rows)
    inside = dated.where("outage_month is not null").where(F.col("incident_date").between(
        F.col("outage_month"), F.date_add(F.add_months("outage_month", 1), 27)))
    read = latest_findings(findings).select("company_id", "id", F.col("category").alias("ai_category"),
                                            "is_psychosocial", "evidence_quote")
    inside = inside.join(read, ["company_id", "id"], "left") \
        .join(incidents.select("company_id", "id", "description"), ["company_id", "id"])
    cause = (F.col("type_code") == CAUSE_TYPE) & (month_start(F.col("incident_date")) == F.col("outage_month"))
    roots = inside.where(cause).groupBy("company_id").agg(F.min(F.struct(
        (-F.coalesce("severity", F.lit(0))).alias("s"), "incident_date", "id")).alias("r")) \
        .select("company_id", F.col("r.id").alias("root_id"))
    return inside.join(roots, "company_id", "left").select(
        "company_id", "id", "incident_date", "type_code", "severity", "description", "ai_category",
        "evidence_quote", F.coalesce("is_psychosocial", F.lit(False)).alias("is_psychosocial"),
        F.coalesce(F.col("id") == F.col("root_id"), F.lit(False)).alias("is_root_cause"))


def explain(fuel: DataFrame, readings: DataFrame, meters: DataFrame, v3: DataFrame,
            incidents: DataFrame, findings: DataFrame, factors: DataFrame, hot_rows: int = HOT_ROWS) -> Outage:
    """Detect and explain for all tenants at once."""
    electricity = monthly_electricity(readings)
    target = anomalous_month(electricity)
    figures = baselines(target, electricity, monthly_fuel(fuel), v3)
    per_meter = meter_changes(readings, meters, target, hot_rows)
    window = window_incidents(incidents, findings, target, hot_rows)
    counted = per_meter.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("meter_count"), F.count_if("below_baseline").alias("meters_below_baseline"))
    story = window.groupBy("company_id").agg(
        F.max(F.when(F.col("is_root_cause"), F.col("id"))).alias("root_cause_id"),
        F.min(F.when(F.col("is_psychosocial"), F.struct("incident_date", "id"))).alias("first"),
        F.count_if("is_psychosocial").alias("consequences"), F.count(F.lit(1)).alias("incidents_in_window")) \
        .withColumn("consequence_id", F.col("first.id")).drop("first")
    rate = factors.where("factor_key = 'grid_electricity_qld'").agg(
        F.max("kg_co2e_per_unit").alias("grid_factor")).withColumn("detected", F.lit(True))
    joined = target.withColumn("detected", F.col("outage_month").isNotNull()) \
        .join(figures, "company_id", "left").join(counted, "company_id", "left") \
        .join(story, "company_id", "left").join(F.broadcast(rate), "detected", "left")
    normal_total = F.col("baseline_scope1") + F.col("baseline_scope2")
    counterfactual = round_half_up(normal_total, 2)
    reason = F.when(F.col("months_analysed") < MIN_MONTHS, "too few months of readings for a baseline") \
        .when(~F.col("detected"), "no month falls far enough below the others")
    found = F.col("detected")
    summary = joined.select(
        "company_id", "detected", reason.alias("reason"), "months_analysed", "outage_month",
        F.when(found, F.date_add(F.add_months("outage_month", 1), 27)).alias("window_end"),
        round_half_up(F.col("actual_kwh"), 2).alias("actual_kwh"),
        round_half_up(F.col("baseline_kwh"), 2).alias("baseline_kwh"),
        percent_change(F.col("actual_kwh"), F.col("baseline_kwh")).alias("grid_change_pct"),
        F.when(found, F.coalesce("meter_count", F.lit(0))).alias("meter_count"),
        F.when(found, F.coalesce("meters_below_baseline", F.lit(0))).alias("meters_below_baseline"),
        round_half_up(F.col("actual_litres"), 2).alias("actual_litres"),
        round_half_up(F.col("baseline_litres"), 2).alias("baseline_litres"),
        round_half_up(F.col("actual_litres") - F.col("baseline_litres"), 2).alias("excess_litres"),
        percent_change(F.col("actual_litres"), F.col("baseline_litres")).alias("fuel_change_pct"),
        "delivery_count", "actual_scope1", "actual_scope2", "actual_total", "actual_share",
        round_half_up(F.col("baseline_scope1"), 2).alias("baseline_scope1"),
        round_half_up(F.col("baseline_scope2"), 2).alias("baseline_scope2"),
        round_half_up(F.col("baseline_share"), 1).alias("baseline_share"),
        percent_change(F.col("actual_scope1"), F.col("baseline_scope1")).alias("scope1_change_pct"),
        percent_change(F.col("actual_scope2"), F.col("baseline_scope2")).alias("scope2_change_pct"),
        percent_change(F.col("actual_total"), normal_total).alias("total_change_pct"),
        counterfactual.alias("counterfactual_total"),
        round_half_up(F.col("actual_total") - counterfactual, 2).alias("reported_minus_counterfactual"),
        "grid_factor", "root_cause_id", "consequence_id",
        F.when(found, F.coalesce("consequences", F.lit(0))).alias("consequences"),
        F.when(found, F.coalesce("incidents_in_window", F.lit(0))).alias("incidents_in_window"))
    return Outage(summary, per_meter, window, evidence_chain(summary))


def evidence_chain(summary: DataFrame) -> DataFrame:
    """Six steps, each naming the dataset it rests on."""
    def pct(c):
        number = F.col(c).cast("decimal(20,1)").cast("string")
        trimmed = F.regexp_replace(number, r"\.0$", "")
        return F.concat(F.when(F.col(c) > 0, F.lit("+")).otherwise(F.lit("")), trimmed, F.lit("%"))

    def step(n, source, title, detail, record=None):
        return F.struct(F.lit(n).alias("step"), F.lit(source).alias("source"), F.lit(title).alias("title"),
                        detail.alias("detail"), (F.lit(None).cast("string") if record is None else F.col(record)).alias("record_id"))

    root = F.coalesce(F.concat("root_cause_id", F.lit(" records the loss of supply.")),
                      F.lit("No incident in the register explains the fall."))
    tail = F.coalesce(F.concat("consequence_id", F.lit(" reports strain on people in the window.")),
                      F.lit("No psychosocial hazard was found in the window."))
    steps = F.array(
        step(1, "incident_register.csv", "Supply is lost", root, "root_cause_id"),
        step(2, "electricity_meter_readings.csv", "Every meter falls together",
             F.concat(F.lit("Grid draw "), pct("grid_change_pct"), F.lit(" against the median month; "),
                      F.col("meters_below_baseline").cast("string"), F.lit(" of "),
                      F.col("meter_count").cast("string"), F.lit(" meters below their own baseline."))),
        step(3, "fuel_deliveries.csv", "Fuel replaces the grid",
             F.concat(F.lit("Fuel volume "), pct("fuel_change_pct"), F.lit(" against the median month."))),
        step(4, "derived", "Scope 2 falls and Scope 1 rises",
             F.concat(F.lit("Scope 2 "), pct("scope2_change_pct"), F.lit(", Scope 1 "), pct("scope1_change_pct"),
                      F.lit("; the Scope 1 share reaches "),
                      F.col("actual_share").cast("decimal(20,1)").cast("string"), F.lit("%."))),
        step(5, "derived", "The total moves and hides the cause",
             F.concat(F.lit("Total "), pct("total_change_pct"), F.lit("."))),
        step(6, "incident_register.csv + findings", "The burden falls on people", tail, "consequence_id"))
    return summary.where("detected").select("company_id", F.explode(steps).alias("s")) \
        .select("company_id", "s.*").orderBy("company_id", "step")
