"""The rule catalogue. Ids, files, categories, severities and actions are fixed values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

FUEL_FILE = "fuel_deliveries.csv"
POWER_FILE = "electricity_meter_readings.csv"
INCIDENT_FILE = "incident_register.csv"
SUPPLIER_FILE = "suppliers.csv"
FACTOR_FILE = "emission_factors.csv"
EXPORT_FILES = [FACTOR_FILE, FUEL_FILE, POWER_FILE, INCIDENT_FILE, SUPPLIER_FILE]


class Rule(NamedTuple):
    rule_id: str
    title: str
    source_file: str
    category: str
    default_severity: str
    default_action: str
    rationale: str


CATALOGUE = [
    Rule("FUEL-HEADER-01", "Header names padded with spaces", FUEL_FILE,
         "structure", "info", "fixed",
         "Padded headers hint at a hand-made file. Names are trimmed before matching columns."),
    Rule("FUEL-FORMAT-01", "More than one way of writing dates or amounts", FUEL_FILE,
         "formatting", "info", "fixed",
         "A column that mixes date layouts or currency styles is parsed value by value. "
         "It is reported once per file because it is systematic; values that cannot be parsed "
         "are reported per row."),
    Rule("FUEL-DATE-PRECISION-01", "Delivery date has no day", FUEL_FILE,
         "completeness", "warning", "flagged",
         "A month-only date is put on the first of the month and marked imprecise. "
         "Monthly figures hold; day-level work must leave these rows out."),
    Rule("FUEL-UNIT-KL-01", "Quantity given in kilolitres", FUEL_FILE,
         "units", "error", "fixed",
         "Quantities are kept in litres, so kilolitres are multiplied by 1000 and the written "
         "value stays beside the result. Left alone, the row would count for a thousandth."),
    Rule("FUEL-DUP-01", "Invoice number seen before", FUEL_FILE,
         "duplication", "error", "rejected",
         "The first delivery of an invoice counts. A later row with the same number is left out "
         "and recorded with a pointer to the first, so nothing is counted twice."),
    Rule("FUEL-CREDIT-01", "Negative quantity read as a credit note", FUEL_FILE,
         "plausibility", "warning", "flagged",
         "A negative delivery is loaded with its sign so that it nets off the totals. "
         "The client should confirm what it reverses."),
    Rule("FUEL-PRICE-01", "Price per litre is not believable", FUEL_FILE,
         "plausibility", "error", "flagged",
         "Cost divided by litres should lie between 1.00 and 3.00. Outside that one of the two "
         "is wrong, and the check cannot say which, so neither is changed."),
    Rule("FUEL-SITE-FLEET-01", "Diesel booked to the light-vehicle fleet", FUEL_FILE,
         "consistency", "warning", "flagged",
         "Light vehicles run on petrol, so diesel booked to them is probably miscoded. "
         "It is not moved, since the right area is unknown."),
    Rule("FUEL-SITE-UNKNOWN-01", "Site area outside the list", FUEL_FILE,
         "structure", "error", "flagged",
         "A new area name is loaded under category unknown instead of widening the list silently."),
    Rule("FUEL-VOLUME-SPIKE-01", "Month far above the usual fuel volume", FUEL_FILE,
         "anomaly", "info", "flagged",
         "Monthly volume is compared with the median and the median absolute deviation. "
         "A spike is a question for other datasets, not an error."),
    Rule("FUEL-MONTH-GAP-01", "Month without any delivery", FUEL_FILE,
         "completeness", "error", "flagged",
         "A month inside the period with no delivery understates Scope 1. "
         "It is reported and never filled with an estimate."),
    Rule("ELEC-UNIT-SCALE-01", "Reading about a thousand times too small", POWER_FILE,
         "units", "error", "fixed",
         "A reading far below the meter's own largest value is multiplied by 1000 when that puts "
         "it near the meter's median, as a reading in MWh would be. Otherwise it is left and flagged."),
    Rule("ELEC-METER-GAP-01", "Missing number in the meter sequence", POWER_FILE,
         "completeness", "warning", "flagged",
         "A number missing between the lowest and the highest meter is either a removed meter or "
         "an unreported load. The export cannot tell which."),
    Rule("ELEC-CONSUMPTION-DROP-01", "Month far below the usual consumption", POWER_FILE,
         "anomaly", "warning", "flagged",
         "The same outlier test as for fuel, on corrected site totals. A real outage must stay "
         "visible, so the value is kept."),
    Rule("INC-DUP-ID-01", "Incident id used again", INCIDENT_FILE,
         "duplication", "error", "fixed",
         "Two incidents under one id are two events. The later one gets a numbered suffix and "
         "keeps its register id beside it."),
    Rule("INC-SEV-SCALE-01", "Severity written on two scales", INCIDENT_FILE,
         "consistency", "warning", "flagged",
         "Words and numbers are read as one three-point scale with 3 as the worst. "
         "If the register counts the other way round, numeric rows are inverted."),
    Rule("INC-SEV-MAPPED-01", "Severity word turned into a number", INCIDENT_FILE,
         "consistency", "info", "fixed",
         "Keeps the mapping visible on each record."),
    Rule("INC-ID-SEQUENCE-01", "Ids far beyond the main run", INCIDENT_FILE,
         "structure", "info", "flagged",
         "After a jump of more than 20 the ids probably come from another register."),
    Rule("INC-DESC-REUSED-01", "Same description on several incidents", INCIDENT_FILE,
         "duplication", "info", "flagged",
         "Either text was copied or a hazard keeps coming back. All records are kept."),
    Rule("INC-LOCATION-01", "Description and location disagree", INCIDENT_FILE,
         "consistency", "warning", "flagged",
         "The text names fixed plant while the location is a mobile fleet. Neither is changed."),
    Rule("INC-TYPE-UNKNOWN-01", "Incident type outside the list", INCIDENT_FILE,
         "structure", "error", "flagged",
         "An unlisted code is loaded as written and surfaced."),
    Rule("SUP-DUP-01", "Supplier listed more than once", SUPPLIER_FILE,
         "duplication", "error", "fixed",
         "Rows of one entity are linked to a primary row and kept, so spend can be read per entity "
         "and still be reconciled row by row."),
    Rule("SUP-ABN-FORM-01", "Business number missing or not 11 digits", SUPPLIER_FILE,
         "completeness", "warning", "flagged",
         "Loaded as written. A guessed number would be worse than none."),
    Rule("SUP-ABN-CHECKSUM-01", "Every business number fails its checksum", SUPPLIER_FILE,
         "plausibility", "info", "flagged",
         "When all well-formed numbers fail, the source is masked or invented. "
         "It is reported once and invalidates no supplier."),
    Rule("SUP-CATEGORY-01", "Category differs from the primary row", SUPPLIER_FILE,
         "consistency", "info", "fixed",
         "A duplicate takes the category of its primary row so that spend groups correctly."),
]
RULES = {rule.rule_id: rule for rule in CATALOGUE}

RULE_SCHEMA = ", ".join(f"{name} string" for name in Rule._fields)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """The 25 rules as a DataFrame (fixed size, safe to broadcast)."""
    return spark.createDataFrame([tuple(r) for r in CATALOGUE], RULE_SCHEMA)
