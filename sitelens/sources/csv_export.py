"""CSV exports of many tenants: ``<root>/company_id=<n>/<file name>``.

Every file is read as text so that each record keeps its physical line number.
Columns are found by trimmed header name, per file, so tenants may order them
differently. Nothing is inferred: all values are strings.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sitelens.functions.numbers import strip
from sitelens.operators.rules import EXPORT_FILES, FACTOR_FILE, FUEL_FILE, INCIDENT_FILE, POWER_FILE, SUPPLIER_FILE
from sitelens.session import materialise

# Header name of every column the operators read (fixed values).
HEADERS = {
    FUEL_FILE: {"invoice_no": "Invoice No", "delivery_date": "Delivery Date", "fuel_type": "Fuel Type",
                "quantity": "Quantity", "unit": "Unit", "cost": "Cost (AUD)", "site_area": "Site Area"},
    POWER_FILE: {c: c for c in ["meter_id", "meter_description", "period", "consumption", "unit"]},
    INCIDENT_FILE: {c: c for c in ["incident_id", "incident_date", "location", "type_code",
                                   "severity", "description"]},
    SUPPLIER_FILE: {c: c for c in ["supplier_name", "abn", "category", "fy_spend_aud"]},
    FACTOR_FILE: {c: c for c in ["activity", "scope", "unit", "kg_co2e_per_unit", "source"]},
}

# How Spark's own CSV parser reads one record of an export.
CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1",
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "unescapedQuoteHandling": "STOP_AT_DELIMITER"}
# A last field of its own behind every record: its place tells how many fields the record has.
_END = "\x1e"


class Export(NamedTuple):
    rows: DataFrame     # company_id, source_row_number and the columns of HEADERS
    headers: DataFrame  # company_id, raw_headers, headers
    broken: DataFrame   # company_id, source_row_number, problem: must be empty


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, source_row_number, value`` of every physical line, blank ones included.

    The text is scanned once and staged with its line ids. Inside a file block these are
    consecutive, so a line is its distance from the block's first id plus the lines of
    earlier blocks. No global sort, and a key of the join has one file split's lines.
    """
    meta = F.col("_metadata")
    lines = materialise(spark.read.text(path).select(
        "value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("uid")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("uid").alias("first_uid"), F.count(F.lit(1)).alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(blocks, ["file", "block"]).select(
        "file", (F.col("uid") - F.col("first_uid") + F.col("before") + 1).alias("source_row_number"),
        "value")


def record_fields(line: Column, most: int) -> Column:
    """Array of the first ``most`` + 1 fields of one CSV record, ``_END`` behind its last one."""
    names = [f"c{i}" for i in range(most + 1)]
    record = F.from_csv(F.concat(line, F.lit("," + _END)), ", ".join(f"{n} string" for n in names), CSV)
    # One evaluation: reading fields off the parser's own struct would parse once for each.
    return F.get(F.transform(F.array(record), lambda r: F.array(*[F.coalesce(r[n], F.lit("")) for n in names])), F.lit(0))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _misquoted(line: Column, fields: Column) -> Column:
    """Whether ``line`` is not its fields, each bare or quoted whole with inner quotes doubled.

    With s quotes inside the fields and k quoted fields a record has 2k + 2s quotes and
    2k + s characters more than its fields and commas, and k is at least the number of
    fields that hold a quote.
    """
    inner = F.aggregate(fields, F.lit(0), lambda n, f: n + _quotes(f))
    wrapping = _quotes(line) - 2 * inner
    least = 2 * F.size(F.filter(fields, lambda f: f.contains('"')))
    written = F.aggregate(fields, F.lit(0), lambda n, f: n + F.length(f) + 1) - 1 + wrapping + inner
    return (wrapping % 2 != 0) | (wrapping < least) | (wrapping > 2 * F.size(fields)) | (F.length(line) != written)


def no_export(spark: SparkSession, file_name: str) -> Export:
    """A role that no tenant has sent."""
    key = "company_id bigint"
    cells = ", ".join(f"{c} string" for c in HEADERS[file_name])
    return Export(spark.createDataFrame([], f"{key}, source_row_number bigint, {cells}"),
                  spark.createDataFrame([], f"{key}, raw_headers array<string>, headers array<string>"),
                  spark.createDataFrame([], f"{key}, source_row_number bigint, problem string"))


def read_export(spark: SparkSession, root: str, file_name: str, pattern: str | None = None) -> Export:
    """Read one role of all tenants. Blank lines are skipped but keep their number.

    The text is scanned once, and every record parsed once by Spark's CSV parser; the
    result is staged and split into rows and ``broken``: ragged rows, and rows with an
    unbalanced or misplaced quote (a field would run over the line end, which would
    falsify line numbers). ``pattern``: which files of a tenant's folder hold the role,
    each with its own header; by default the one with the role's name.
    """
    path = f"{root.rstrip('/')}/company_id=*/{pattern or file_name}"
    lines = numbered_lines(spark, path).select(
        "file", F.regexp_extract("file", r"company_id=(\d+)", 1).cast("bigint").alias("company_id"),
        "source_row_number", F.when(F.col("source_row_number") == 1, F.regexp_replace("value", r"^\x{FEFF}", ""))
        .otherwise(F.col("value")).alias("value"))
    titles = materialise(lines.where("source_row_number = 1"))  # one row a file
    # Headers decide how many fields a record is read with; a longer one is ragged anyway.
    most = titles.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0] or 0
    fields = record_fields(F.col("value"), most + 1)
    width = F.array_position("fields", _END).cast("int") - 1
    headers = titles.withColumn("fields", fields).withColumn("raw_headers", F.slice("fields", F.lit(1), F.greatest(width, F.lit(0)))) \
        .select("file", "company_id", "raw_headers", F.transform("raw_headers", strip).alias("headers"))
    records = lines.where("source_row_number > 1").where(strip(F.col("value")) != "").withColumn("fields", fields) \
        .withColumn("width", width).join(headers.select("file", "headers"), "file")
    problem = F.when(_quotes(F.col("value")) % 2 == 1, "unbalanced-quote") \
        .when(F.col("value").contains(_END), "control-character") \
        .when((F.col("width") >= 0) & _misquoted(F.col("value"), F.slice("fields", F.lit(1), F.greatest("width", F.lit(0)))), "misplaced-quote") \
        .when(F.coalesce(F.col("width") != F.size("headers"), F.lit(True)) | (F.col("width") < 0), "ragged-row")
    cell = {name: F.coalesce(F.get("fields", F.array_position("headers", header).cast("int") - 1), F.lit(""))
            for name, header in HEADERS[file_name].items()}
    parsed = materialise(records.select("company_id", "source_row_number", problem.alias("problem"),
                                        *[c.alias(n) for n, c in cell.items()]))
    return Export(parsed.where("problem is null").drop("problem"), headers.drop("file").distinct(),
                  parsed.where("problem is not null").select("company_id", "source_row_number", "problem"))


# ------------------------------------------------------------------ file intake

NUL_DEPTH = 1024


def intake(spark: SparkSession, root: str) -> DataFrame:
    """One row per uploaded file: tenant, role, size, blank, binary.

    Names and sizes come from the file listing; contents are never read whole. A NUL
    within the first ``NUL_DEPTH`` characters means the file is not text: only lines
    of a file's first split can lie there, and of those the first ``NUL_DEPTH``.
    """
    path = f"{root.rstrip('/')}/company_id=*/*"
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("uid"))
    filled = lines.groupBy("file").agg(
        F.bool_or(strip(F.regexp_replace("value", r"^\x{FEFF}", "")) != "").alias("filled"))
    head = lines.where("block = 0")
    first = head.groupBy("file").agg(F.min("uid").alias("first_uid"))
    head = head.join(first, "file").where(F.col("uid") < F.col("first_uid") + NUL_DEPTH)
    before = Window.partitionBy("file").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(NUL_DEPTH) - F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    # At most NUL_DEPTH short texts of a file meet in the window.
    nul = head.select("file", "uid", F.substring("value", 1, NUL_DEPTH).alias("text")) \
        .withColumn("room", room).where("room > 0") \
        .groupBy("file").agg(F.bool_or(F.substring(F.col("text"), F.lit(1), F.col("room").cast("int")).contains("\0"))
                             .alias("binary"))
    return listed.join(filled, "file", "left").join(nul, "file", "left").select(
        F.regexp_extract("file", r"company_id=(\d+)", 1).cast("bigint").alias("company_id"),
        F.element_at(F.split("file", "/"), -1).alias("role"), "bytes",
        (~F.coalesce("filled", F.lit(False))).alias("blank"), F.coalesce("binary", F.lit(False)).alias("binary"))


def intake_problems(files: DataFrame) -> DataFrame:
    """Every reason to refuse a tenant's batch: ``company_id, role, problem``.

    An incomplete batch is refused because a load replaces the whole dataset.
    """
    roles = F.array(*[F.lit(f) for f in EXPORT_FILES])
    counted = files.groupBy("company_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("binary").alias("binary"))
    unknown = counted.where(~F.col("role").isin(EXPORT_FILES)).select("company_id", "role", F.lit("unknown-role").alias("problem"))
    twice = counted.where("n > 1").select("company_id", "role", F.lit("sent-twice").alias("problem"))
    binary = counted.where("binary").select("company_id", "role", F.lit("not-text").alias("problem"))
    expected = files.select("company_id").distinct().select("company_id", F.explode(roles).alias("role"))
    missing = expected.join(counted.where("not blank"), ["company_id", "role"], "left_anti") \
        .select("company_id", "role", F.lit("missing-or-blank").alias("problem"))
    return unknown.unionByName(twice).unionByName(binary).unionByName(missing)
