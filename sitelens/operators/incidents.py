"""Cleaning of the incident register."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, functions as F

from sitelens.functions.normalise import normalise_date, normalise_severity, trailing_number
from sitelens.functions.numbers import strip
from sitelens.operators.ledger import (
    Check, check, explode_issues, file_issue, issue, mark, span_key)
from sitelens.operators.rules import INCIDENT_FILE
from sitelens.operators.skew import HOT_ROWS, attach, number_within
from sitelens.sources.reference import INCIDENT_TYPES

RAW_COLUMNS = ["incident_id", "incident_date", "location", "type_code", "severity", "description"]

# Fixed values.
FIXED_PLANT = ["crusher", "wash plant", "CHPP", "ROM pad", "thickener"]
FLEETS = ["Haul Fleet", "Light Vehicles"]
SEQUENCE_GAP = 20


class IncidentResult(NamedTuple):
    rows: DataFrame
    facts: DataFrame
    issues: DataFrame
    members: DataFrame   # every record behind a group issue, one row each


def classify_rows(raw: DataFrame, width: int = 65_536) -> DataFrame:
    """Parse every row; number repeated ids in file order among datable rows.

    The n-th use of an id becomes ``id-n``. Rows without a usable date are rejected
    and use up no number.
    """
    text = raw.select("company_id", F.col("source_row_number").cast("bigint").alias("source_row_number"),
                      *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RAW_COLUMNS])
    parsed = text.withColumn("d", normalise_date(F.col("incident_date"))) \
        .withColumn("s", normalise_severity(F.col("severity"))).select(
            "company_id", "source_row_number", F.col("incident_id").alias("source_incident_id"),
            F.col("incident_date").alias("raw_date"), F.col("location"), "type_code",
            F.col("severity").alias("severity_raw"), "description",
            F.col("d.value").alias("incident_date"), F.col("d.error").alias("date_error"),
            F.col("s.severity").alias("severity"), F.col("s.scale").alias("scale"),
            F.col("s.error").alias("severity_error"))
    # The long text stays out of the numbering shuffle.
    ids = number_within(
        parsed.where("date_error is null").select("company_id", "source_incident_id", "source_row_number"),
        ["company_id", "source_incident_id"], "source_row_number", "use", width)
    again = ids.where("use > 1").drop("source_incident_id")
    return parsed.join(again, ["company_id", "source_row_number"], "left") \
        .withColumn("id", F.when(F.col("date_error").isNull(), F.concat_ws(
            "-", "source_incident_id", F.col("use").cast("string"))))


def row_checks() -> list[Check]:
    """The rules on single rows, in checking order."""
    line, key = F.col("source_row_number"), F.col("source_incident_id")
    loaded = F.col("date_error").isNull()
    lowered = F.lower("description")
    plant = F.get(F.filter(F.array(*[F.lit(k) for k in FIXED_PLANT]),
                           lambda k: lowered.contains(F.lower(k))), F.lit(0))
    codes = [code for code, _ in INCIDENT_TYPES]
    return [
        check(
            ~loaded, "INC-DUP-ID-01",
            F.concat(F.lit("No usable incident date ("), "date_error", F.lit("); the row is left out.")),
            line, key, "incident_date", F.col("raw_date"), severity="error", action="rejected"),
        check(
            loaded & (F.col("scale") == "ordinal-text"), "INC-SEV-MAPPED-01",
            F.concat(F.lit("'"), "severity_raw", F.lit("' read as "), F.col("severity").cast("string"), F.lit(".")),
            line, key, "severity", F.col("severity_raw"), F.col("severity").cast("string")),
        check(
            loaded & F.col("severity_error").isNotNull(), "INC-SEV-SCALE-01",
            F.concat(F.lit("'"), "severity_raw", F.lit("' is on neither scale; loaded without a severity.")),
            line, key, "severity", F.col("severity_raw"), severity="error", action="flagged"),
        check(
            loaded & ~F.col("type_code").isin(codes), "INC-TYPE-UNKNOWN-01",
            F.concat(F.lit("Code '"), "type_code", F.lit("' is not one of " + ", ".join(codes) + ".")),
            line, key, "type_code", F.col("type_code")),
        check(
            loaded & (F.col("use") > 1), "INC-DUP-ID-01",
            F.concat(F.lit("Use number "), F.col("use").cast("string"), F.lit(" of this id; kept as "), "id", F.lit(".")),
            line, key, "incident_id", key, F.col("id")),
        check(
            loaded & plant.isNotNull() & F.col("location").isin(FLEETS), "INC-LOCATION-01",
            F.concat(F.lit("The text names the "), plant, F.lit(", the location says '"), "location", F.lit("'.")),
            line, key, "location", F.col("location")),
    ]


def incident_facts(rows: DataFrame) -> DataFrame:
    return rows.where("date_error is null").select(
        "company_id", "id", "source_incident_id", "incident_date",
        F.when(F.col("location") != "", F.col("location")).alias("site_area"),
        F.col("location").alias("location_raw"), "type_code",
        F.col("severity").cast("smallint").alias("severity"), "severity_raw", "description",
        F.lit(INCIDENT_FILE).alias("source_file"), "source_row_number")


def severity_scales(rows: DataFrame) -> DataFrame:
    loaded = F.col("date_error").isNull()
    return rows.groupBy("company_id").agg(
        F.count_if(loaded & (F.col("scale") == "numeric")).alias("numeric"),
        F.count_if(loaded & (F.col("scale") == "ordinal-text")).alias("ordinal_text"))


def scale_issues(rows: DataFrame) -> DataFrame:
    mixed = severity_scales(rows).where("numeric > 0 and ordinal_text > 0")
    summary = F.concat(F.lit("numeric: "), F.col("numeric").cast("string"),
                       F.lit(", ordinal-text: "), F.col("ordinal_text").cast("string"))
    return file_issue(mixed, issue(
        "INC-SEV-SCALE-01",
        F.concat(F.lit("Two severity scales in one column ("), summary,
                 F.lit("). Read as Low=1, Medium=2, High=3; confirm that 3 is the worst.")),
        field="severity", original=summary))


def reused_texts(rows: DataFrame) -> DataFrame:
    """Texts on two or more incidents. Grouped by SHA-256, so whole texts do not shuffle."""
    keyed = rows.where("date_error is null").select(
        "company_id", "source_row_number", "location", "incident_date",
        F.unhex(F.sha2("description", 256)).alias("text_key"),
        F.substring("description", 1, 80).alias("head"),
        (F.length("description") > 80).alias("longer"))
    by_place = keyed.groupBy("company_id", "text_key", "location").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("source_row_number", "incident_date", "head", "longer")).alias("first"),
        F.max(F.struct("source_row_number", "incident_date")).alias("last"))
    return by_place.groupBy("company_id", "text_key").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("locations"),
        F.min("first").alias("first"), F.max("last").alias("last")).where("occurrences > 1") \
        .select("company_id", "text_key", "occurrences", "locations",
                F.col("first.source_row_number").alias("first_line"),
                F.col("first.incident_date").alias("first_date"),
                F.col("last.incident_date").alias("last_date"),
                F.concat("first.head", F.when(F.col("first.longer"), F.lit("...")).otherwise(F.lit("")))
                .alias("excerpt"))


def reuse_members(rows: DataFrame, reused: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every incident of every reused text, one row each."""
    keyed = rows.where("date_error is null").select(
        "company_id", "source_row_number", "id", F.unhex(F.sha2("description", 256)).alias("text_key"))
    return attach(keyed, reused.select("company_id", "text_key", "occurrences", "first_line"),
                  ["company_id", "text_key"], "occurrences", F.col("source_row_number"), hot_rows) \
        .where("occurrences is not null") \
        .select("company_id", F.lit("INC-DESC-REUSED-01").alias("rule_id"),
                F.col("first_line").alias("group_key"), "occurrences",
                F.col("source_row_number").alias("member_order"), "source_row_number",
                F.col("id").alias("member_id"))


def sequence_breaks(rows: DataFrame) -> DataFrame:
    """First jump of more than 20 in each tenant's sorted trailing id numbers.

    Numbers are folded into blocks of 20: no jump fits inside a block, and a jump
    before a block shows from the block before it, found by an equi-join. Nothing
    sorts a whole tenant.
    """
    n = trailing_number(F.col("source_incident_id"))
    blocks = rows.where("date_error is null").select("company_id", n.alias("n")).where("n is not null") \
        .groupBy("company_id", F.floor(F.col("n") / SEQUENCE_GAP).alias("block")) \
        .agg(F.min("n").alias("low"), F.max("n").alias("high"))
    before = blocks.select("company_id", (F.col("block") + 1).alias("block"), F.col("high").alias("before"))
    starts = blocks.join(before, ["company_id", "block"], "left") \
        .where(F.col("before").isNull() | (F.col("low") - F.col("before") > SEQUENCE_GAP))
    firsts = blocks.groupBy("company_id").agg(F.min("low").alias("lowest"))
    first_jump = starts.join(firsts, "company_id").where("low > lowest") \
        .groupBy("company_id").agg(F.min("low").alias("resumes_at"))
    ends = blocks.join(first_jump, "company_id").where("high < resumes_at") \
        .groupBy("company_id").agg(F.max("high").alias("stops_at"))
    return first_jump.join(ends, "company_id")


def sequence_members(rows: DataFrame, breaks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every incident numbered at or after its tenant's jump, one row each."""
    numbered = rows.where("date_error is null").select(
        "company_id", "source_row_number", "source_incident_id",
        trailing_number(F.col("source_incident_id")).alias("n")).where("n is not null")
    sizes = numbered.groupBy("company_id").agg(F.count(F.lit(1)).alias("key_rows"))
    return attach(numbered, sizes.join(breaks, "company_id", "left"), ["company_id"], "key_rows",
                  F.col("source_row_number"), hot_rows) \
        .where("n >= resumes_at") \
        .select("company_id", F.lit("INC-ID-SEQUENCE-01").alias("rule_id"),
                F.col("resumes_at").alias("group_key"), F.lit(None).cast("bigint").alias("occurrences"),
                F.col("n").alias("member_order"), "source_row_number",
                F.col("source_incident_id").alias("member_id"))


def _group_spans(members: DataFrame) -> DataFrame:
    """Record key and size of every group, from map-side combined extremes."""
    place = F.struct("member_order", "source_row_number", "member_id")
    return members.groupBy("company_id", "group_key").agg(
        F.count(F.lit(1)).alias("members"), F.min(place).alias("lo"), F.max(place).alias("hi")).select(
        "company_id", "group_key", "members", span_key(F.col("lo.member_id"), F.col("hi.member_id")).alias("span"))


def group_issues(rows: DataFrame, reused: DataFrame, breaks: DataFrame, members: DataFrame) -> DataFrame:
    reuse = members.where("rule_id = 'INC-DESC-REUSED-01'")
    texts = reused.withColumnRenamed("first_line", "group_key").join(_group_spans(reuse), ["company_id", "group_key"])
    copies = file_issue(texts, issue(
        "INC-DESC-REUSED-01",
        F.concat(F.lit("Same text on "), F.col("occurrences").cast("string"), F.lit(" incidents in "),
                 F.col("locations").cast("string"), F.lit(" location(s), "),
                 F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string"),
                 F.lit(": \""), "excerpt", F.lit("\"")),
        key=F.col("span"),
        field="description",
        original=F.concat(F.col("occurrences").cast("string"), F.lit(" occurrences"))))
    late = members.where("rule_id = 'INC-ID-SEQUENCE-01'")
    jumps = _group_spans(late).join(breaks.withColumnRenamed("resumes_at", "group_key"), ["company_id", "group_key"])
    ids = F.col("span")
    return copies.unionByName(file_issue(jumps, issue(
        "INC-ID-SEQUENCE-01",
        F.concat(F.col("members").cast("string"), F.lit(" incident(s) after a jump from "),
                 F.col("stops_at").cast("string"), F.lit(" to "), F.col("group_key").cast("string"), F.lit(".")),
        key=ids, field="incident_id", original=ids)))


def clean_incidents(raw: DataFrame, hot_rows: int = HOT_ROWS,
                    stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> IncidentResult:
    """An unlisted type code is loaded and flagged, not refused."""
    rows = stage(mark(classify_rows(raw), row_checks()))
    reused, breaks = reused_texts(rows), sequence_breaks(rows)
    members = reuse_members(rows, reused, hot_rows).unionByName(sequence_members(rows, breaks, hot_rows))
    issues = explode_issues(rows, row_checks()).unionByName(scale_issues(rows)) \
        .unionByName(group_issues(rows, reused, breaks, members))
    return IncidentResult(rows, incident_facts(rows), issues, members.drop("occurrences"))
