"""Grounding gate: a finding stands only on a verbatim quote of its incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from sitelens.functions.numbers import strip
from sitelens.operators.skew import HOT_ROWS, SLOTS, attach, number_in_order
from sitelens.session import materialise
from sitelens.sources.artefacts import FINDING

# The vocabulary of findings and the batch size of classification.
CATEGORIES = [
    "Psychosocial hazard", "Vehicle & mobile equipment", "Plant & equipment failure",
    "Slip, trip & fall", "Fall from height", "Caught in / crushed", "Manual handling",
    "Dropped object", "Environmental release", "Dust & air quality", "Electrical & power", "Other"]
SUBTYPES = [
    "Bullying or harassment", "Aggression or violence", "Excessive workload or fatigue",
    "Low job control", "Poor support", "Role conflict or lack of role clarity",
    "Exposure to traumatic events", "Remote or isolated work", "Not applicable"]
BATCH_SIZE = 8


def verify_findings(findings: DataFrame, incidents: DataFrame, run: list[str] | None = None,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``reason`` (null = accepted), the trimmed quote and the severity comparison.

    ``findings``: company_id, seq (unique order), incident_id, evidence_quote,
    severity_assessment and more. ``run`` names the columns of one run (model and
    prompt version); only the first acceptable finding per incident and run counts.
    Reasons are tried in the order unknown-incident, duplicate-finding, quote-empty,
    quote-not-verbatim. The quote comparison is byte-exact.
    """
    keys = ["company_id", "incident_id"]
    rows = findings.withColumn("quote", strip(F.coalesce("evidence_quote", F.lit(""))))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    source = incidents.select(
        "company_id", F.col("id").alias("incident_id"), F.lit(True).alias("known"),
        F.col("severity").cast("int").alias("recorded_severity"), F.col("description").alias("source_text"))
    # Texts travel once, to the findings; what is known of hot incidents comes from the counts alone.
    hot = F.broadcast(sizes.where(F.col("key_rows") > hot_rows).select(*keys, F.lit(True).alias("_hot")))
    slots = F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SLOTS))).otherwise(F.array(F.lit(0)))
    slot = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64("seq"), F.lit(SLOTS)).cast("int")).otherwise(F.lit(0))
    seen = rows.join(hot, keys, "left").withColumn("_slot", slot).drop("_hot").join(
        source.join(hot, keys, "left").withColumn("_slot", F.explode(slots)).drop("_hot").hint("merge"), [*keys, "_slot"], "left")
    # Written once without the texts, because the first of each group and the rows both read it.
    checked = materialise(seen.withColumn("verbatim", F.coalesce(F.contains("source_text", "quote"), F.lit(False))) \
        .withColumn("known", F.coalesce("known", F.lit(False))).drop("source_text", "_slot"))
    # The first acceptable finding replaces a running "accepted so far" flag.
    valid = F.col("known") & (F.col("quote") != "") & F.col("verbatim")
    group = keys + (run or [])
    first = checked.groupBy(*group).agg(
        F.min(F.when(valid, F.col("seq"))).alias("first_valid"), F.count(F.lit(1)).alias("key_rows"))
    judged = attach(checked, first, group, "key_rows", F.col("seq"), hot_rows)
    reason = F.when(~F.col("known"), "unknown-incident") \
        .when(F.col("seq") > F.col("first_valid"), "duplicate-finding") \
        .when(F.col("quote") == "", "quote-empty") \
        .when(~F.col("verbatim"), "quote-not-verbatim")
    mismatch = F.col("recorded_severity").isNotNull() & (
        F.col("severity_assessment") != F.col("recorded_severity"))
    return judged.withColumn("reason", reason) \
        .withColumn("severity_mismatch", F.when(F.col("reason").isNull(), F.coalesce(mismatch, F.lit(False)))) \
        .withColumn("evidence_quote", F.when(
            F.col("reason").isNull() | (F.col("reason") == "quote-not-verbatim"), F.col("quote"))
            .otherwise(F.col("evidence_quote"))) \
        .drop("quote", "known", "verbatim", "first_valid", "key_rows")


def accepted_findings(verified: DataFrame) -> DataFrame:
    return verified.where("reason is null").drop("reason")


def rejected_findings(verified: DataFrame) -> DataFrame:
    return verified.where("reason is not null").select(
        "company_id", "seq", "incident_id", "reason", F.col("evidence_quote").alias("quote"))


def without_finding(requested: DataFrame, accepted: DataFrame) -> DataFrame:
    """Requested incidents for which nothing was accepted."""
    return requested.select("company_id", F.col("id").alias("incident_id")).join(
        accepted, ["company_id", "incident_id"], "left_anti")


def load_findings(findings: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gate again at load: accepted rows, and counts per tenant.

    Findings about incidents the tenant does not have are skipped, not rejected.
    """
    verified = verify_findings(findings, incidents, ["model", "prompt_version"])
    counts = verified.groupBy("company_id").agg(
        F.count_if(F.col("reason").isNull()).alias("loaded"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "unknown-incident")).alias("rejected"),
        F.count_if(F.col("reason") == "unknown-incident").alias("skipped_missing_incident"),
        F.count_if(F.col("reason").isNull() & F.col("is_psychosocial")).alias("psychosocial"),
        F.count_if(F.col("reason").isNull() & F.col("severity_mismatch")).alias("severity_mismatches"))
    return accepted_findings(verified), counts


def plan_batches(incidents: DataFrame, cached: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Incidents still to classify, in batches of eight per tenant by date and id.

    A cached finding is reused only for the same model and prompt version.
    """
    done = cached.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)) \
        .select("company_id", F.col("incident_id").alias("id"))
    todo = incidents.select("company_id", "id", "incident_date").join(done, ["company_id", "id"], "left_anti")
    return number_in_order(todo, "company_id", ["incident_date", "id"], "position") \
        .withColumn("batch", F.floor((F.col("position") - 1) / BATCH_SIZE))


def merge_findings(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and new findings together; a new one replaces the cached one."""
    kept = cached.join(fresh.select("company_id", "incident_id"), ["company_id", "incident_id"], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def response_problems(findings: DataFrame) -> DataFrame:
    """Findings outside the response contract: vocabulary and ranges."""
    problem = F.when(~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "category") \
        .when(~F.coalesce(F.col("psychosocial_subtype").isin(SUBTYPES), F.lit(False)), "psychosocial_subtype") \
        .when(~F.coalesce(F.col("severity_assessment").between(1, 3), F.lit(False)), "severity_assessment") \
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    return findings.withColumn("problem", problem).where("problem is not null")


def parse_response(responses: DataFrame, column: str) -> DataFrame:
    """Typed findings of JSON response texts, one row each."""
    parsed = F.from_json(column, T.StructType([T.StructField("findings", T.ArrayType(FINDING))]))
    return responses.withColumn("r", parsed).select(
        *[c for c in responses.columns if c != column], F.posexplode("r.findings").alias("seq", "f")) \
        .select(*[c for c in responses.columns if c != column], F.col("seq").cast("bigint").alias("seq"), "f.*")
