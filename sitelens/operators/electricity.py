"""Cleaning of meter readings: unit repair, meter gaps, site-wide drops."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.normalise import meter_number, normalise_date
from sitelens.functions.numbers import money_half_up, parse_decimal, plain, strip
from sitelens.functions.robust import robust_outliers
from sitelens.operators.ledger import (
    Check, check, explode_issues, file_issue, issue, mark, span_key)
from sitelens.operators.rules import POWER_FILE
from sitelens.operators.skew import HOT_ROWS, attach, exact_median
from sitelens.session import materialise

RAW_COLUMNS = ["meter_id", "meter_description", "period", "consumption", "unit"]

# Orders of magnitude below the meter's maximum, the MWh factor, and
# the range around the meter's median that a repaired reading must land in.
MAGNITUDE_GAP = 2.5
MWH_TO_KWH = 1000
PLAUSIBLE_RANGE = (0.2, 5.0)


class ElectricityResult(NamedTuple):
    rows: DataFrame
    meters: DataFrame
    facts: DataFrame
    issues: DataFrame


def parse_readings(raw: DataFrame) -> DataFrame:
    """Parse period and value; ``reject`` marks rows that cannot be read.

    A blank consumption is unreadable here rather than a zero reading, and so is one
    that no table could hold.
    """
    text = raw.select("company_id", F.col("source_row_number").cast("bigint").alias("source_row_number"),
                      *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RAW_COLUMNS])
    return text.withColumn("d", normalise_date(F.concat("period", F.lit("-01")))).select(
        "company_id", "source_row_number", "meter_id", "meter_description", "unit",
        F.col("period").alias("raw_period"), F.col("consumption").alias("raw_consumption"),
        F.col("d.value").alias("period"), parse_decimal(F.col("consumption")).alias("value"),
    ).withColumn("value", F.when(_stored(F.col("value")), F.col("value"))) \
        .withColumn("reject", F.col("period").isNull() | F.col("value").isNull())


def _stored(value):
    """Whether the tables' DECIMAL(14,2) hold a reading, as written and rounded."""
    return value.try_cast("decimal(14,2)").isNotNull() & money_half_up(value.cast("decimal(26,6)")).isNotNull()


def repair_units(parsed: DataFrame, hot_rows: int = HOT_ROWS,
                 stage: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """Find readings in MWh labelled kWh by each meter's own scale and repair them.

    A positive reading is suspect at 10^2.5 or more below the meter's maximum. The
    reference is the median of the meter's other readings. x1000 is accepted only
    near the reference; otherwise the reading is kept and flagged. A reading whose
    repaired value no table could hold is rejected. A meter without a positive reading keeps its rows. The marked rows are staged once, because the
    median, the suspects and the rest all read them.
    """
    keys = ["company_id", "meter_id"]
    usable = F.when(~F.col("reject"), F.col("value"))
    tops = parsed.groupBy(*keys).agg(
        F.max(F.when(usable > 0, usable)).alias("top"), F.count(F.lit(1)).alias("key_rows"))
    topped = attach(parsed, tops, keys, "key_rows", F.col("source_row_number"), hot_rows)
    value = F.col("value").cast("double")
    suspect = F.coalesce(
        ~F.col("reject") & (F.col("value") > 0)
        & (F.log10(value) <= F.log10(F.col("top").cast("double")) - MAGNITUDE_GAP), F.lit(False))
    marked = stage(topped.withColumn("suspect", suspect))
    normal = exact_median(marked.where(~F.col("reject") & ~F.col("suspect")), keys, "value", 6,
                          "reference")
    # Only suspect rows need the reference, and only meters that have any.
    wanted = marked.where("suspect").groupBy(*keys).agg(F.count(F.lit(1)).alias("suspects"))
    judged = attach(marked.where("suspect"), wanted.join(normal, keys, "left"), keys, "suspects",
                    F.col("source_row_number"), hot_rows).drop("suspects")
    raised = F.col("value") * F.lit(MWH_TO_KWH)
    low, high = PLAUSIBLE_RANGE
    judgeable = F.coalesce(F.col("reference") > 0, F.lit(False))
    fits = raised.cast("double").between(F.col("reference") * low, F.col("reference") * high)
    judged = judged.withColumn(
        "repair", F.when(judgeable & fits, "fixed").when(judgeable, "flagged"))
    rest = marked.where("not suspect").withColumn("reference", F.lit(None).cast("double")) \
        .withColumn("repair", F.lit(None).cast("string"))
    both = rest.unionByName(judged).drop("top", "key_rows")
    lost = F.coalesce((F.col("repair") == "fixed") & ~_stored(raised), F.lit(False))
    both = both.withColumn("reject", F.col("reject") | lost).withColumn("repair", F.when(~lost, F.col("repair")))
    factor = F.when(F.col("repair") == "fixed", F.lit(MWH_TO_KWH)).otherwise(F.lit(1))
    return both.select(
        "*", factor.cast("decimal(10,4)").alias("unit_correction_factor"),
        money_half_up((F.col("value") * factor).cast("decimal(26,6)")).alias("consumption_kwh"))


def row_checks() -> list[Check]:
    """The rules on single rows, in checking order."""
    line = F.col("source_row_number")
    key = F.concat_ws(" ", F.col("meter_id"), F.date_format("period", "yyyy-MM"))
    written = F.concat_ws(" ", plain(F.col("value")), F.col("unit"))
    norm = F.format_number("reference", 0)
    return [
        check(
            F.col("reject"), "ELEC-UNIT-SCALE-01", F.lit("Period or consumption cannot be read; the row is left out."),
            line, F.col("meter_id"), None, F.concat_ws(" ", "raw_period", "raw_consumption"),
            severity="error", action="rejected"),
        check(
            F.col("repair") == "fixed", "ELEC-UNIT-SCALE-01",
            F.concat(written, F.lit(" is about a thousandth of the meter's median of "), norm,
                     F.lit(" kWh; taken as MWh and multiplied by 1000.")),
            line, key, "consumption", written,
            F.concat(plain(F.col("value") * F.lit(MWH_TO_KWH)), F.lit(" kWh"))),
        check(
            F.col("repair") == "flagged", "ELEC-UNIT-SCALE-01",
            F.concat(written, F.lit(" is far below the meter's median of "), norm,
                     F.lit(" kWh, and 1000 times as much does not fit either; kept as written.")),
            line, key, "consumption", written, action="flagged"),
    ]


def reading_facts(rows: DataFrame) -> DataFrame:
    return rows.where("not reject").select(
        "company_id", "meter_id", "period", "consumption_kwh",
        F.col("value").try_cast("decimal(14,2)").alias("original_consumption"),
        F.col("unit").alias("original_unit"), "unit_correction_factor",
        F.lit(POWER_FILE).alias("source_file"), "source_row_number",
        "issue_count", "error_count")


def meter_table(rows: DataFrame) -> DataFrame:
    """One row per meter: last description in file order, first and last period."""
    return rows.where("not reject").groupBy("company_id", "meter_id").agg(
        F.max_by("meter_description", "source_row_number").alias("description"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def meter_gaps(meters: DataFrame) -> DataFrame:
    """Missing runs ``(first_missing, last_missing)`` in each tenant's MTR numbering."""
    numbers = meters.select("company_id", meter_number(F.col("meter_id")).alias("n")) \
        .where("n is not null").distinct()
    nxt = F.lead("n").over(Window.partitionBy("company_id").orderBy("n"))
    return numbers.withColumn("next_n", nxt).where("next_n > n + 1").select(
        "company_id", (F.col("n") + 1).alias("first_missing"), (F.col("next_n") - 1).alias("last_missing"))


def _meter_label(n):
    return F.concat(F.lit("MTR-"), F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))


def meter_gap_issues(rows: DataFrame) -> DataFrame:
    meters = rows.where("not reject").select("company_id", "meter_id").distinct()
    gaps = meter_gaps(meters)
    sizes = gaps.groupBy("company_id").agg(
        F.sum(F.col("last_missing") - F.col("first_missing") + 1).alias("missing"),
        F.min("first_missing").alias("lowest_missing"), F.max("last_missing").alias("highest_missing"))
    context = meters.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("meters"), F.min(meter_number(F.col("meter_id"))).alias("lowest"),
        F.max(meter_number(F.col("meter_id"))).alias("highest"))
    periods = rows.where("not reject").groupBy("company_id").agg(
        F.count_distinct("period").alias("periods"))
    joined = sizes.join(context, "company_id").join(periods, "company_id")
    key = span_key(_meter_label(F.col("lowest_missing")), _meter_label(F.col("highest_missing")))
    return file_issue(joined, issue(
        "ELEC-METER-GAP-01",
        F.concat(F.col("missing").cast("string"), F.lit(" number(s) between "), _meter_label(F.col("lowest")),
                 F.lit(" and "), _meter_label(F.col("highest")), F.lit(" never appear in "),
                 F.col("periods").cast("string"), F.lit(" months of readings.")),
        key=key, field="meter_id",
        original=F.concat(F.col("meters").cast("string"), F.lit(" meters present"))))


def gap_members(meters: DataFrame) -> DataFrame:
    """Member rows of the meter gaps: one per missing run, however long, never per number."""
    return meter_gaps(meters).select(
        "company_id", F.lit("ELEC-METER-GAP-01").alias("rule_id"), F.col("first_missing").alias("group_key"),
        F.col("first_missing").alias("member_order"), F.lit(None).cast("bigint").alias("source_row_number"),
        span_key(_meter_label(F.col("first_missing")), _meter_label(F.col("last_missing"))).alias("member_id"))


def monthly_consumption(rows: DataFrame) -> DataFrame:
    return rows.where("not reject").groupBy("company_id", F.col("period").alias("month")) \
        .agg(F.sum("consumption_kwh").alias("kwh"))


def consumption_drops(monthly: DataFrame) -> DataFrame:
    return robust_outliers(monthly, ["company_id"], "kwh") \
        .where(F.col("is_outlier") & (F.col("kwh") < F.col("median_value")))


def drop_issues(rows: DataFrame) -> DataFrame:
    ym = F.date_format("month", "yyyy-MM")
    kwh = F.round("kwh", 0).cast("bigint").cast("string")
    return file_issue(consumption_drops(monthly_consumption(rows)), issue(
        "ELEC-CONSUMPTION-DROP-01",
        F.concat(ym, F.lit(" shows "), kwh, F.lit(" kWh over all meters, "),
                 F.format_number(F.col("kwh") / F.col("median_value") * 100, 0),
                 F.lit("% of the median month (modified z "), F.format_number("modified_z", 1),
                 F.lit("). Kept as read.")),
        key=ym, field="consumption", original=F.concat(kwh, F.lit(" kWh"))))


def clean_electricity(raw: DataFrame, hot_rows: int = HOT_ROWS,
                      stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> ElectricityResult:
    rows = stage(mark(repair_units(parse_readings(raw), hot_rows), row_checks()))
    issues = explode_issues(rows, row_checks()).unionByName(meter_gap_issues(rows)).unionByName(drop_issues(rows))
    return ElectricityResult(rows, meter_table(rows), reading_facts(rows), issues)
