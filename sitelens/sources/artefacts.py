"""JSON artefacts: machine-written findings and stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Field names of the two artefact files (fixed values).
FINDING = T.StructType([
    T.StructField("incident_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("is_psychosocial", T.BooleanType()), T.StructField("psychosocial_subtype", T.StringType()),
    T.StructField("severity_assessment", T.IntegerType()), T.StructField("confidence", T.DecimalType(3, 2)),
    T.StructField("evidence_quote", T.StringType()), T.StructField("rationale", T.StringType())])
USAGE = T.StructType([
    T.StructField("inputTokens", T.LongType()), T.StructField("outputTokens", T.LongType()),
    T.StructField("estimatedCostUsd", T.DoubleType())])
FINDINGS_FILE = T.StructType([
    T.StructField("generatedAt", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("promptVersion", T.StringType()),
    T.StructField("incidentsClassified", T.IntegerType()), T.StructField("usage", USAGE),
    T.StructField("rejected", T.ArrayType(T.StructType([
        T.StructField(c, T.StringType()) for c in ("incidentId", "reason", "detail", "quote")]))),
    T.StructField("findings", T.ArrayType(FINDING))])
CITATIONS = T.StructField("citations", T.ArrayType(T.StringType()))
REPORT_FILE = T.StructType([
    T.StructField("generatedAt", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("promptVersion", T.StringType()),
    T.StructField("factDigest", T.StringType()),
    T.StructField("period", T.StructType([T.StructField(c, T.StringType()) for c in ("from", "to", "company")])),
    T.StructField("sections", T.ArrayType(T.StructType([
        T.StructField("section", T.StringType()),
        T.StructField("claims", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), CITATIONS])))]))),
    T.StructField("rejected", T.ArrayType(T.StructType([
        T.StructField("section", T.StringType()), T.StructField("text", T.StringType()), CITATIONS,
        T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType()),
        T.StructField("round", T.IntegerType())]))),
    T.StructField("claimsAccepted", T.IntegerType()), T.StructField("claimsRejected", T.IntegerType()),
    T.StructField("usage", USAGE)])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all artefact files, one row each, in array order (``seq``).

    ``path`` may hold one file or ``company_id=<n>`` folders; then the tenant comes
    from the folder and findings of one tenant cannot reach another.
    """
    files = spark.read.schema(FINDINGS_FILE).option("multiLine", True).json(path)
    return files.select("*", "_metadata.file_path").select(
        F.regexp_extract("file_path", r"company_id=(\d+)", 1).try_cast("bigint").alias("company_id"),
        "provider", "model", F.col("promptVersion").alias("prompt_version"),
        F.to_timestamp("generatedAt").alias("created_at"), F.posexplode("findings").alias("seq", "f")) \
        .select("company_id", F.col("seq").cast("bigint").alias("seq"), "f.*",
                "provider", "model", "prompt_version", "created_at")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports; a malformed file counts as no report."""
    schema = T.StructType([*REPORT_FILE.fields, T.StructField("_corrupt_record", T.StringType())])
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return files.select("*", "_metadata.file_path").where("_corrupt_record is null") \
        .withColumn("report_id", F.element_at(F.split("file_path", "/"), -1)) \
        .drop("_corrupt_record", "file_path")


def report_claims(reports: DataFrame) -> DataFrame:
    """Claims of reports: ``report_id, seq, section, text, citations`` in document order."""
    sections = reports.select("report_id", F.posexplode("sections").alias("s_pos", "s"))
    claims = sections.select("report_id", "s_pos", F.col("s.section").alias("section"),
                             F.posexplode("s.claims").alias("c_pos", "c"))
    return claims.select("report_id", (F.shiftleft(F.col("s_pos").cast("bigint"), 32) + F.col("c_pos")).alias("seq"),
                         "section", F.col("c.text").alias("text"), F.col("c.citations").alias("citations"))
