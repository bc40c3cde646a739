"""The issue ledger: one row per problem, never a silent fix."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelens.operators.rules import RULES

ISSUE_SCHEMA = (
    "company_id bigint, rule_id string, source_file string, source_row_number bigint, "
    "record_key string, field string, severity string, action string, "
    "description string, original_value string, resolved_value string")
ISSUE_COLUMNS = [part.split()[0] for part in ISSUE_SCHEMA.split(", ")]


def span_key(first: Column, last: Column) -> Column:
    """Record key of an issue about many records: the first and the last of them.

    The form is the same at every size; all records are rows of the member table.
    """
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(" ... "), last))


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def issue(rule_id: str, description, line: Column | None = None, key=None, field=None,
          original=None, resolved=None, severity=None, action=None) -> Column:
    """An issue struct; severity, action and file default to the rule's own."""
    rule = RULES[rule_id]
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule.source_file).alias("source_file"),
        (F.lit(None) if line is None else line).cast("bigint").alias("source_row_number"),
        _text(key).alias("record_key"),
        _text(field).alias("field"),
        _text(severity if severity is not None else rule.default_severity).alias("severity"),
        _text(action if action is not None else rule.default_action).alias("action"),
        _text(description).alias("description"),
        _text(original).alias("original_value"),
        _text(resolved).alias("resolved_value"),
    )


class Check(NamedTuple):
    """A rule on single rows: when it fires, its issue, and the issue's severity."""
    condition: Column
    item: Column
    severity: str


def check(condition: Column, rule_id: str, *args, severity=None, **more) -> Check:
    """A row check; further arguments are those of ``issue``."""
    return Check(condition, issue(rule_id, *args, severity=severity, **more), severity or RULES[rule_id].default_severity)


def mark(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """Add ``fired``, whose bit k says that check k fires, and the row's issue and error counts.

    No text is made here: rows carry one number, and most of them a zero.
    """
    bits = reduce(Column.__add__, [F.when(c.condition, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, c in enumerate(checks)])
    errors = F.lit(sum(1 << k for k, c in enumerate(checks) if c.severity == "error")).cast("bigint")
    return rows.withColumn("fired", bits).withColumns({
        "issue_count": F.bit_count("fired"), "error_count": F.bit_count(F.col("fired").bitwiseAND(errors))})


def explode_issues(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """The issues of marked rows, in the given order; only rows with a bit set are looked at.

    Every column is a case of its own, so whoever reads only some of them makes no text for the others.
    """
    numbers = F.filter(F.array(*[F.lit(k) for k in range(len(checks))]), lambda k: F.getbit("fired", k) == 1)
    fired = rows.where("fired <> 0").withColumn("_k", F.explode(numbers))
    return fired.select("company_id", *[
        reduce(lambda case, kc: case.when(F.col("_k") == kc[0], kc[1].item[c]), enumerate(checks), F).alias(c)
        for c in ISSUE_COLUMNS if c != "company_id"])


def file_issue(df: DataFrame, item: Column) -> DataFrame:
    """One issue per row of ``df`` (file- or group-level findings)."""
    return df.select("company_id", item.alias("i")).select("company_id", "i.*") \
        .select(*ISSUE_COLUMNS)


def unresolved_fixes(issues: DataFrame) -> DataFrame:
    """Ledger rows that claim a fix without saying what the value became. Must be empty."""
    return issues.where("action = 'fixed' and resolved_value is null")


def issue_counts(issues: DataFrame, by: str) -> DataFrame:
    """Findings per tenant by ``rule_id``, ``severity`` or ``action``, largest first."""
    return issues.groupBy("company_id", by).agg(F.count(F.lit(1)).alias("issue_count")) \
        .orderBy("company_id", F.desc("issue_count"), by)


def issues_per_source_row(issues: DataFrame) -> DataFrame:
    """Issue and error counts per source line; a line raises only a handful."""
    return (
        issues.where("source_row_number is not null")
        .groupBy("company_id", "source_file", "source_row_number")
        .agg(F.count(F.lit(1)).cast("int").alias("issue_count"),
             F.count_if(F.col("severity") == "error").cast("int").alias("error_count"))
    )


def with_issue_counts(facts: DataFrame, issues: DataFrame, source_file: str) -> DataFrame:
    """Add issue and error counts to facts keyed by source line (unique, so no skew)."""
    counts = issues_per_source_row(issues.where(F.col("source_file") == source_file)) \
        .drop("source_file")
    base = facts.drop("issue_count", "error_count")
    return base.join(counts, ["company_id", "source_row_number"], "left") \
        .fillna(0, ["issue_count", "error_count"])


def findings_report(issues: DataFrame, min_chars: int = 110, tenants: DataFrame | None = None) -> DataFrame:
    """Per tenant and fired rule: count, default action and a one-to-two sentence reason.

    Rules that did not fire come back with a count of 0 and ``fired = false``, and so
    do all rules of a tenant in ``tenants`` (company_id) without issues. A
    sentence ends at ``.``, ``!`` or ``?`` before white space or the end of text.
    """
    tenants = (issues if tenants is None else tenants).select("company_id").distinct()
    catalogue = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(r._fields, r)])
                          for r in RULES.values()])
    hits = issues.groupBy("company_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    sentences = F.expr(r"regexp_extract_all(rationale, '(?s).*?[.!?](?=\\s|$)', 0)")
    first = F.coalesce(F.get(sentences, F.lit(0)), F.col("rationale"))
    second = F.coalesce(F.get(sentences, F.lit(1)), F.lit(""))
    short = F.length(F.trim(first)) < min_chars
    return (
        tenants.select("company_id", F.explode(catalogue).alias("r")).select("company_id", "r.*")
        .join(hits, ["company_id", "rule_id"], "left")
        .select("company_id", "source_file", "rule_id", "title",
                F.coalesce("n", F.lit(0)).alias("issue_count"),
                F.col("default_action").alias("action"),
                F.trim(F.when(short, F.concat(first, second)).otherwise(first)).alias("reason"),
                F.col("n").isNotNull().alias("fired"))
        .orderBy("company_id", F.desc("fired"), "source_file", "rule_id")
    )


def findings_totals(issues: DataFrame) -> DataFrame:
    """Headline of the findings report per tenant: totals by action and by severity."""
    def hits(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value).alias(value)
    return issues.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("rule_id").alias("rules"),
        *[hits("action", a) for a in ("fixed", "flagged", "rejected")],
        *[hits("severity", s) for s in ("error", "warning", "info")])


def newest_first(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows per tenant; Spark keeps ``n`` per task before the shuffle."""
    w = Window.partitionBy("company_id").orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
