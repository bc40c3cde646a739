"""The load audit: one row per attempt and tenant, one per attempt; kept when data is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.sinks.store import Load, Store

LOAD_SCHEMA = (
    "company_id bigint, load_id string, source string, files array<struct<role:string,name:string,bytes:bigint>>, "
    "row_counts map<string,bigint>, issue_count bigint, error_count bigint, status string, "
    "failure_reason string, started_at timestamp, finished_at timestamp")
RUN_SCHEMA = (
    "load_id string, source string, status string, tenants_loaded bigint, tenants_failed bigint, "
    "rows_written map<string,bigint>, error_issues bigint, failure_reason string, started_at timestamp, finished_at timestamp")
TABLES = ["data_loads", "load_runs"]
REASON_LENGTH = 2000
_NO_COUNTS = "map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))"


def file_manifest(files: DataFrame) -> DataFrame:
    """Files of each tenant's batch as an array (five roles, so always short)."""
    return files.groupBy("company_id").agg(F.array_sort(F.collect_list(
        F.struct("role", F.col("role").alias("name"), F.col("bytes").cast("bigint").alias("bytes")))).alias("files"))


def row_counts(load: Load, names: list[str]) -> DataFrame:
    """Rows per tenant and written table as one map per tenant, from what the load has stored."""
    parts = None
    for name in names:
        part = load.written[name].withColumn("t", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    pairs = F.array_sort(F.collect_list(F.struct("t", "rows")))
    return parts.groupBy("company_id").agg(F.map_from_entries(pairs).alias("row_counts"))


def _rows(attempts: DataFrame, load: Load, source: str, status: str, reason: Column) -> DataFrame:
    return attempts.select(
        "company_id", F.lit(load.id).alias("load_id"), F.lit(source).alias("source"), "files",
        F.coalesce("row_counts", F.expr(_NO_COUNTS)).alias("row_counts"), F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"), F.lit(status).alias("status"),
        F.substring(reason, 1, REASON_LENGTH).alias("failure_reason"), F.lit(load.started_at).cast("timestamp").alias("started_at"),
        F.current_timestamp().alias("finished_at"))


def succeeded(load: Load, files: DataFrame, passed: DataFrame, issues: DataFrame, names: list[str], source: str) -> DataFrame:
    tally = issues.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "error").alias("error_count"))
    attempts = file_manifest(files.join(passed, "company_id", "left_semi")) \
        .join(row_counts(load, names), "company_id", "left").join(tally, "company_id", "left")
    return _rows(attempts, load, source, "succeeded", F.lit(None).cast("string"))


def failed(load: Load, files: DataFrame, reasons: DataFrame, source: str) -> DataFrame:
    """``reasons``: company_id, reason. A long reason is cut to 2000 characters."""
    attempts = file_manifest(files).join(reasons, "company_id").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("row_counts", "map<string,bigint>"), ("issue_count", "bigint"), ("error_count", "bigint"))])
    return _rows(attempts, load, source, "failed", F.col("reason"))


def run_row(load: Load, attempt: Load, source: str, status: str, loaded: int, lost: int, reason: str | None) -> DataFrame:
    """The attempt as a whole, with the rows that its writes have observed."""
    counts = {name: seen["rows"] for name, seen in attempt.observed.items()}
    errors = sum(seen.get("errors", 0) for seen in attempt.observed.values())
    return load.store.spark.createDataFrame(
        [(attempt.id, source, status, loaded, lost, counts, errors, reason and reason[:REASON_LENGTH], attempt.started_at, None)],
        RUN_SCHEMA).withColumn("finished_at", F.current_timestamp())


def record(load: Load, files: DataFrame, passed: DataFrame, lost: DataFrame, issues: DataFrame, names: list[str],
           source: str) -> None:
    """Write the audit of a load that is about to be published; it becomes visible with it."""
    run = run_row(load, load, source, "succeeded", passed.count(), lost.select("company_id").distinct().count(), None)
    done = succeeded(load, files, passed, issues, names, source)
    load.write("data_loads", done.unionByName(failed(load, files, lost, source)))
    load.write("load_runs", run, per_tenant=False)


def record_failure(store: Store, attempt: Load, files: DataFrame | None, reason: str, source: str) -> None:
    """Publish the audit of an attempt that has thrown. Nothing else that it wrote becomes visible.

    Without a file listing the tenants are unknown, and only the run is recorded.
    """
    load = store.begin()
    lost = 0
    if files is not None:
        tenants = files.where("company_id is not null").select("company_id").distinct()
        lost = tenants.count()
        load.write("data_loads", failed(attempt, files, tenants.withColumn("reason", F.lit(reason)), source))
    load.write("load_runs", run_row(load, attempt, source, "failed", 0, lost, reason), per_tenant=False)
    load.publish(appended=TABLES)
