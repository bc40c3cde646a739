"""Cleaning of fuel deliveries: raw text rows to facts and issues."""

from __future__ import annotations

from functools import reduce
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.normalise import (
    LITRES_PER_UNIT, apart, implied_price, month_start, price_is_plausible, with_amount, with_date, with_quantity)
from sitelens.functions.numbers import plain, strip
from sitelens.functions.robust import robust_outliers
from sitelens.operators.ledger import Check, check, explode_issues, file_issue, issue, mark
from sitelens.operators.rules import FUEL_FILE
from sitelens.operators.skew import HOT_ROWS, attach
from sitelens.session import discard, materialise, staged_bytes
from sitelens.sources.reference import FACTOR_KEY_BY_FUEL, SITE_AREAS, lookup

RAW_COLUMNS = ["invoice_no", "delivery_date", "fuel_type", "quantity", "unit", "cost", "site_area"]
LIGHT_VEHICLE_AREA = "Light Vehicles"
# Parsed rows that are classified at a time, as written, and the most slices of a load.
SLICE_BYTES = 1_000_000_000
MOST_SLICES = 8


class FuelResult(NamedTuple):
    rows: DataFrame      # every raw row with its parsed values and its fate
    facts: DataFrame     # loaded deliveries
    issues: DataFrame    # row-level and file-level issues


def parse_rows(raw: DataFrame) -> DataFrame:
    """Every row with its texts parsed, in few and flat columns.

    What the texts alone decide anew (factor, emission factor key, precision) is left to
    ``decide``: rows travel to the owner of their invoice number, and each column with them.
    ``date_read`` is the date's layout, or its error where there is no date.
    """
    text = raw.select("company_id", apart(F.col("source_row_number").cast("bigint")).alias("source_row_number"),
                      *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RAW_COLUMNS])
    parsed = with_amount(with_quantity(with_date(text, "delivery_date", "d"), "quantity", "unit", "q"), "cost", "c")
    return parsed.select(
        *text.columns, F.col("d.value").alias("date"), F.coalesce("d.format", "d.error").alias("date_read"),
        F.col("q.litres").alias("litres"), F.col("q.error").alias("quantity_error"), F.col("c.value").alias("cost_aud"),
        ((F.col("cost") != "") & F.col("c.error").isNotNull()).alias("cost_bad"),
        (F.col("c.error").isNull() & F.col("c.formatted")).alias("cost_formatted"))


def decide(parsed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The fate of parsed rows (see ``classify_rows``). Rows of one invoice number must come together."""
    dated, measured = F.col("date").isNotNull(), F.col("quantity_error").isNull()
    factor_key = lookup(FACTOR_KEY_BY_FUEL, F.col("fuel_type"))
    early = F.when(~dated, "date").when(~measured, "quantity").when(factor_key.isNull(), "fuel_type")

    # Which line claims each invoice number. Signatures travel as two hashes so the
    # aggregate keeps fixed-width buffers. The number comes first, so that sorts compare it first.
    keys = ["invoice_no", "company_id"]
    signature = F.concat_ws("|", "delivery_date", "fuel_type", "quantity", "unit", "cost", "site_area")
    s1, s2 = F.xxhash64(signature), F.xxhash64(F.lit(1), signature)
    candidate = F.when(early.isNull(), F.col("source_row_number"))
    owners = parsed.withColumns({"s1": s1, "s2": s2}).groupBy(*keys).agg(
        F.min(candidate).alias("first_line"),
        F.min_by("s1", candidate).alias("first_s1"),
        F.min_by("s2", candidate).alias("first_s2"),
        F.count(candidate).alias("candidates"),
        F.count(F.lit(1)).alias("key_rows"))
    # A number without two candidates has no duplicate, so its owner need not travel.
    owners = owners.where((F.col("candidates") > 1) | (F.col("key_rows") > hot_rows)).drop("candidates")
    owned = attach(parsed, owners, keys, "key_rows", F.col("source_row_number"), hot_rows, merge=True)
    duplicate = early.isNull() & (F.col("source_row_number") > F.col("first_line"))
    return owned.select(
        "company_id", "source_row_number", *RAW_COLUMNS, "date",
        F.when(dated, F.when(F.col("date_read") == "month-year", "month").otherwise("day")).alias("date_precision"),
        F.when(dated, F.col("date_read")).alias("date_format"), F.when(~dated, F.col("date_read")).alias("date_error"),
        "litres", F.when(measured, lookup(LITRES_PER_UNIT, F.lower("unit"))).alias("factor"),
        "quantity_error", "cost_aud", "cost_bad", "cost_formatted", factor_key.alias("factor_key"),
        F.when(early.isNotNull(), early).when(duplicate, "duplicate").alias("reject"),
        F.when(duplicate, F.col("first_line")).alias("first_line"),
        F.when(duplicate, (s1 == F.col("first_s1")) & (s2 == F.col("first_s2"))).alias("same_row"),
    )


def classify_rows(raw: DataFrame, hot_rows: int = HOT_ROWS,
                  stage: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """Parse every row and decide its fate: ``reject`` is null for loaded rows.

    ``raw`` has ``company_id``, ``source_row_number`` (unique per tenant) and the
    text columns of ``RAW_COLUMNS``. The first failing step in the order date,
    quantity, fuel type, duplicate wins, and hides the issues of later steps. Parsed rows
    are staged once, because the owners of invoice numbers and the rows both read them.
    """
    return decide(stage(parse_rows(raw)), hot_rows)


def row_checks() -> list[Check]:
    """The rules on single rows, in checking order."""
    line, key = F.col("source_row_number"), F.col("invoice_no")
    reject = F.col("reject")
    dated = F.coalesce(reject != "date", F.lit(True))
    measured = dated & F.coalesce(reject != "quantity", F.lit(True))
    loaded = reject.isNull()
    litres = plain(F.col("litres"))
    written = F.concat_ws(" ", "quantity", "unit")
    price = implied_price(F.col("cost_aud"), F.col("litres"))
    known = [name for name, _ in SITE_AREAS]

    def rejected(when, field, description, original):
        return check(when, "FUEL-FORMAT-01", description, line, key, field, original, severity="error", action="rejected")

    return [
        rejected(
            reject == "date", "Delivery Date",
            F.concat(F.lit("No usable delivery date ("), "date_error", F.lit("); the row belongs to no month and is left out.")),
            F.col("delivery_date")),
        check(
            dated & (F.col("date_precision") == "month"), "FUEL-DATE-PRECISION-01",
            F.concat(F.lit("Only the month is given; placed on "), F.col("date").cast("string"), F.lit(".")),
            line, key, "Delivery Date", F.col("delivery_date")),
        rejected(
            reject == "quantity", "Quantity",
            F.concat(F.lit("No usable quantity ("), "quantity_error", F.lit("); the row is left out.")), written),
        check(
            measured & (F.col("factor") != 1), "FUEL-UNIT-KL-01",
            F.concat(F.lit("Written in "), "unit", F.lit(", converted to litres by "),
                     F.col("factor").cast("string"), F.lit(".")),
            line, key, "Quantity", written, F.concat(litres, F.lit(" L"))),
        check(
            measured & F.col("cost_bad"), "FUEL-FORMAT-01", F.lit("Cost cannot be read; loaded without it."), line, key,
            "Cost (AUD)", F.col("cost"), severity="warning", action="flagged"),
        check(
            measured & (F.col("litres") < 0), "FUEL-CREDIT-01",
            F.concat(F.lit("Delivery of "), litres, F.lit(" L nets off the totals as a credit note.")),
            line, key, "Quantity", written),
        check(
            measured & F.col("cost_aud").isNotNull() & ~price_is_plausible(price), "FUEL-PRICE-01",
            F.concat(F.lit("Works out at "), F.format_number(price, 2), F.lit(" per litre.")),
            line, key, "Quantity", F.concat(written, F.lit(" for "), "cost")),
        rejected(
            reject == "fuel_type", "Fuel Type", F.concat(F.lit("No emission factor for fuel '"), "fuel_type", F.lit("'.")),
            F.col("fuel_type")),
        check(
            reject == "duplicate", "FUEL-DUP-01",
            F.concat(F.when(F.col("same_row"), F.lit("Same row as line "))
                     .otherwise(F.lit("Other values under the invoice number of line ")),
                     F.col("first_line").cast("string"), F.lit("; the first one counts.")),
            line, key, "Invoice No", key),
        check(
            loaded & ~F.col("site_area").isin(known), "FUEL-SITE-UNKNOWN-01",
            F.concat(F.lit("Area '"), "site_area", F.lit("' is not in the list; loaded as unknown.")),
            line, key, "Site Area", F.col("site_area")),
        check(
            loaded & (F.col("site_area") == LIGHT_VEHICLE_AREA) & (F.col("fuel_type") == "Diesel"), "FUEL-SITE-FLEET-01",
            F.concat(litres, F.lit(" L of diesel booked to light vehicles.")),
            line, key, "Site Area", F.col("site_area")),
    ]


def fuel_facts(rows: DataFrame) -> DataFrame:
    """Loaded deliveries, raw text beside clean values, with their own issue counts."""
    return rows.where("reject is null").select(
        "company_id", "invoice_no", F.col("date").alias("delivery_date"), "date_precision",
        "fuel_type", "factor_key", F.col("litres").alias("quantity_l"), "cost_aud", "site_area",
        (F.col("litres") < 0).alias("is_credit_note"),
        F.col("delivery_date").alias("original_date"), F.col("quantity").alias("original_quantity"),
        F.col("unit").alias("original_unit"),
        F.when(F.col("cost") != "", F.col("cost")).alias("original_cost"),
        F.lit(FUEL_FILE).alias("source_file"), "source_row_number",
        "issue_count", "error_count")


def monthly_volume(rows: DataFrame) -> DataFrame:
    """Litres per month over loaded rows, credit notes counted as zero."""
    return rows.where("reject is null").groupBy("company_id", month_start(F.col("date")).alias("month")) \
        .agg(F.sum(F.greatest(F.col("litres"), F.lit(0).cast("decimal(14,2)"))).alias("litres"))


def format_summary(rows: DataFrame) -> DataFrame:
    """Date layouts and formatted amounts per tenant (rows dropped later are counted too)."""
    dated = F.coalesce(F.col("reject") != "date", F.lit(True))
    measured = dated & F.coalesce(F.col("reject") != "quantity", F.lit(True))
    layouts = ["iso", "day-first-slash", "month-year"]
    return rows.groupBy("company_id").agg(
        *[F.count_if(dated & (F.col("date_format") == f)).alias(f.replace("-", "_")) for f in layouts],
        F.count_if(measured & F.col("cost_formatted")).alias("formatted_costs"),
        F.count_if(F.col("reject").isNull()).alias("loaded_rows"),
    ).withColumn("date_formats", sum((F.col(f.replace("-", "_")) > 0).cast("int") for f in layouts))


def volume_spikes(volume: DataFrame) -> DataFrame:
    return robust_outliers(volume, ["company_id"], "litres") \
        .where(F.col("is_outlier") & (F.col("litres") > F.col("median_value")))


def month_gaps(months: DataFrame) -> DataFrame:
    """Calendar months strictly inside a tenant's first..last month that have no row.

    A present month knows the next present one, so the holes between them are a
    sequence of their own and no calendar is joined.
    """
    w = Window.partitionBy("company_id").orderBy("month")
    following = F.lead("month").over(w)
    return (
        months.select("company_id", "month", following.alias("following"),
                      F.min("month").over(Window.partitionBy("company_id")).alias("first_month"),
                      F.max("month").over(Window.partitionBy("company_id")).alias("last_month"))
        .where(F.col("following") > F.add_months("month", 1))
        .select("company_id", "first_month", "last_month", F.explode(F.sequence(
            F.add_months("month", 1), F.add_months("following", -1),
            F.expr("interval 1 month"))).alias("month"))
    )


def file_level_issues(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Mixed formats, volume spikes, month gaps, and padded headers when given."""
    ym = F.date_format("month", "yyyy-MM")
    summary = format_summary(rows).where("date_formats > 1 or formatted_costs > 0")
    volume = monthly_volume(rows)
    spikes, gaps = volume_spikes(volume), month_gaps(volume)
    litres = F.round("litres", 0).cast("bigint").cast("string")
    found = file_issue(summary, issue(
        "FUEL-FORMAT-01",
        F.concat_ws(" ", F.lit("Date layouts: iso"), "iso", F.lit("slash"), "day_first_slash",
                    F.lit("month"), "month_year", F.lit("; formatted costs"), "formatted_costs",
                    F.lit("of"), "loaded_rows", F.lit("loaded rows.")),
        original=F.concat("date_formats", F.lit(" date formats, "), "formatted_costs",
                          F.lit(" formatted costs")),
        resolved="ISO dates, numeric costs"))
    found = found.unionByName(file_issue(spikes, issue(
        "FUEL-VOLUME-SPIKE-01",
        F.concat(ym, F.lit(" took "), litres, F.lit(" L, "),
                 F.format_number(F.col("litres") / F.col("median_value"), 2),
                 F.lit(" times the median month (modified z "),
                 F.format_number("modified_z", 1), F.lit(").")),
        key=F.col("month").cast("string"), field="Quantity",
        original=F.concat(litres, F.lit(" L")))))
    found = found.unionByName(file_issue(gaps, issue(
        "FUEL-MONTH-GAP-01",
        F.concat(F.lit("No delivery in "), ym, F.lit(" although deliveries run from "),
                 F.date_format("first_month", "yyyy-MM"), F.lit(" to "),
                 F.date_format("last_month", "yyyy-MM"), F.lit(".")),
        key=ym, field="Delivery Date", original="0 deliveries")))
    if headers is not None:
        found = found.unionByName(header_issues(headers))
    return found


def header_issues(headers: DataFrame) -> DataFrame:
    """``headers``: company_id, raw_headers, headers (arrays) of each fuel file."""
    padded = F.filter(F.arrays_zip("raw_headers", "headers"),
                      lambda h: h["raw_headers"] != h["headers"])
    return file_issue(headers.where(F.size(padded) > 0), issue(
        "FUEL-HEADER-01",
        F.concat(F.size(padded).cast("string"), F.lit(" of "), F.size("headers").cast("string"),
                 F.lit(" header names are padded.")),
        field="header", original=F.to_json("raw_headers"), resolved=F.to_json("headers")))


def _marked(raw: DataFrame, hot_rows: int, stage: Callable[[DataFrame], DataFrame], slice_bytes: int) -> DataFrame:
    """Classified and marked rows, staged slice by slice of the invoice numbers.

    All rows travel once. In slices, only one slice's shuffle is on disk at a time, for a
    further scan of the parsed rows each.
    """
    parsed = stage(parse_rows(raw))
    n = min(MOST_SLICES, 1 + staged_bytes(parsed) // slice_bytes)
    own = F.pmod(F.xxhash64("invoice_no", "company_id"), F.lit(n))
    rows = reduce(DataFrame.unionByName, [
        stage(mark(decide(parsed if n == 1 else parsed.where(own == k), hot_rows), row_checks())) for k in range(n)])
    discard(parsed)
    return rows


def clean_fuel(raw: DataFrame, headers: DataFrame | None = None, hot_rows: int = HOT_ROWS,
               stage: Callable[[DataFrame], DataFrame] = lambda df: df, slice_bytes: int = SLICE_BYTES) -> FuelResult:
    """Clean all tenants' fuel rows. ``stage`` may write parsed and classified rows once."""
    rows = _marked(raw, hot_rows, stage, slice_bytes)
    issues = explode_issues(rows, row_checks()).unionByName(stage(file_level_issues(rows, headers)))
    return FuelResult(rows, fuel_facts(rows), issues)
