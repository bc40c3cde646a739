"""Plans that must not grow with the data beyond what they read."""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.sql import functions as F

from sitelens import session
from sitelens.functions import normalise
from sitelens.operators import contracts, fuel, suppliers
from sitelens.operators.ledger import explode_issues, mark
from sitelens.operators.skew import attach
from sitelens.plans import reports
from sitelens.session import materialise


def _plan(df) -> str:
    """The plan as it was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_merged_attach_broadcasts_no_rows(spark):
    rows = spark.createDataFrame([(1, n) for n in range(9)], "company_id bigint, node bigint") \
        .withColumn("key", F.explode(F.array(F.col("node") % 2, F.col("node") % 3)))
    stats = rows.groupBy("company_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre"))
    # The filter makes the join inner, so that Spark may build either side.
    joined = attach(rows, stats, ["company_id", "key"], "n", F.col("node"), merge=True).where("centre is not null")
    assert joined.count() == 18
    assert "SortMergeJoin" in _plan(joined) and "BroadcastHashJoin" not in _plan(joined)


def test_supplier_clusters_broadcast_no_names(spark):
    names = ["alpha mining services", "alpha mining servces", "beta haulage works", "beta haulage wrks", "gamma drilling works"]
    raw = spark.createDataFrame([(1, k + 2, name, "", "", "1") for k, name in enumerate(names)],
                                "company_id bigint, source_row_number bigint, supplier_name string, abn string, category string, fy_spend_aud string")
    clusters = suppliers.supplier_clusters(suppliers.parse_suppliers(raw))
    assert clusters.select("component").distinct().count() == 3
    assert "SortMergeJoin" in _plan(clusters) and "BroadcastHashJoin" not in _plan(clusters)


def test_supplier_lists_broadcast_no_sums(spark):
    rows = spark.createDataFrame(
        [(1, 2, None, "10.00"), (1, 3, 2, "4.00"), (1, 4, 2, None), (1, 5, None, None)],
        "company_id bigint, source_row_number bigint, duplicate_of_row bigint, spend string") \
        .withColumn("fy_spend_aud", F.col("spend").cast("decimal(14,2)")) \
        .withColumns({c: F.lit("x") for c in ("supplier_name", "name_canonical", "abn_raw", "abn", "category",
                                              "category_canonical", "duplicate_of_name")}).withColumn("abn_valid", F.lit(True))
    found = reports.find_suppliers(rows)
    assert [(r.source_row_number, r.consolidated_spend_aud and int(r.consolidated_spend_aud)) for r in found.collect()] \
        == [(2, 14), (3, None), (4, None), (5, None)]
    for df in (found, reports.supplier_list_totals(rows)):
        assert "SortMergeJoin" in _plan(df) and "BroadcastHashJoin" not in _plan(df)


def test_contracts_broadcast_no_keys(spark):
    rows = spark.createDataFrame([(1, 2, None), (1, 3, 2), (1, 4, 9), (2, 5, 2), (2, 6, 6), (2, 5, None)],
                                 "company_id bigint, source_row_number bigint, duplicate_of_row bigint")
    broken = contracts.validate(contracts.supplier_checks(rows))
    assert sorted(map(tuple, broken.collect())) == [
        ("supplier-not-own-duplicate", 2, "", 1), ("supplier-primary", 1, "9", 1), ("supplier-primary", 2, "2", 1)]
    assert "SortMergeJoin" in _plan(broken) and "BroadcastHashJoin" not in _plan(broken)


def test_invoice_owners_are_not_broadcast(spark):
    raw = spark.createDataFrame([(1, n, f"INV-{n % 3}") for n in range(6)], "company_id bigint, source_row_number bigint, invoice_no string") \
        .withColumns({"delivery_date": F.lit("2021-01-05"), "fuel_type": F.lit("Diesel"), "quantity": F.lit("5"), "unit": F.lit("L"),
                      "cost": F.lit("9"), "site_area": F.lit("")})
    rows = fuel.classify_rows(raw)
    assert sorted(r.first_line for r in rows.collect() if r.reject == "duplicate") == [0, 1, 2]
    # Only hot keys, of which there are none here, are broadcast.
    assert "SortMergeJoin" in _plan(rows) and _plan(rows).count("BroadcastHashJoin") <= 1


def test_quantity_and_amount_are_parsed_once(spark):
    raw = spark.createDataFrame([("1,250.5", "kL", "$-3,000.00")], "quantity string, unit string, cost string")
    parsed = raw.select(normalise.normalise_quantity(F.col("quantity"), F.col("unit")).alias("q"),
                        normalise.parse_amount(F.col("cost")).alias("c"))
    read = parsed.select("q.litres", "q.error", "q.factor", "c.value", "c.formatted")
    row = read.first()
    assert (str(row.litres), row.error, row.factor, str(row.value), row.formatted) == ("1250500.00", None, 1000, "-3000.00", True)
    text = parsed._jdf.queryExecution().optimizedPlan().toString()
    # One decimal of the quantity, one of the amount.
    assert text.lower().count("as decimal(18,6)") == 1
    assert text.count("$,-") == 1


def test_projected_parsers_equal_the_column_functions(spark):
    texts = ["", "0", "-5", "+1.5", "1,250.005", "-0.005", "1e3", "1e400", ".", "$-3,000.00", "-$1.00", "N/A", "1.2.3", ",", "$", "9" * 30,
             "2021-02-30", "2021-03-01", "31/12/2020", "12/31/2020", "Mar-21", "Xyz-21", "March", None]
    raw = spark.createDataFrame([(t, u) for t in texts for u in ("kL", "Litres", "drum", "", None)], "t string, u string")
    plain = raw.select("t", "u", normalise.normalise_date(F.col("t")).alias("d"),
                       normalise.normalise_quantity(F.col("t"), F.col("u")).alias("q"), normalise.parse_amount(F.col("t")).alias("c"))
    staged = normalise.with_amount(normalise.with_quantity(normalise.with_date(raw, "t", "d"), "t", "u", "q"), "t", "c")
    assert staged.dtypes == plain.dtypes
    assert sorted(map(repr, staged.collect())) == sorted(map(repr, plain.collect()))


def test_fuel_rows_are_parsed_in_compiled_projections(spark):
    raw = spark.createDataFrame([(1, 2, *["x"] * len(fuel.RAW_COLUMNS))], "company_id bigint, source_row_number bigint, "
                                + ", ".join(f"{c} string" for c in fuel.RAW_COLUMNS))
    staged = []
    fuel.classify_rows(raw, stage=lambda df: staged.append(df) or df)
    text = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    # Each text is matched where Spark compiles it; a lambda's body is interpreted.
    assert text.count("RLIKE") > 0 and text.lower().count("as decimal(18,6)") == 1
    for body in text.split("lambdafunction(")[1:]:
        assert "RLIKE" not in body[:body.index("lambda ")]


def _exchanges_with(spark, df, column):
    """Shuffles whose rows carry ``column``, with broadcasts by size off."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return sum(" Exchange hashpartitioning" in a and f"{column}#" in b for a, b in zip(lines, lines[1:]))


def test_texts_travel_to_their_findings_once(spark, monkeypatch):
    from sitelens.operators import grounding
    written = []
    monkeypatch.setattr(grounding, "materialise", lambda df: written.append(df) or materialise(df))
    incidents = spark.createDataFrame([(1, "A", 2, "dust at the pit"), (1, "A", 2, "other"), (1, "B", None, None)],
                                      "company_id bigint, id string, severity smallint, description string")
    findings = spark.createDataFrame(
        [(1, 0, "A", "dust", 1), (1, 1, "A", "pit", 2), (1, 2, "B", "x", 1), (1, 3, "C", "x", 1), (1, 4, None, "x", 1)],
        "company_id bigint, seq bigint, incident_id string, evidence_quote string, severity_assessment int")
    for hot_rows in (1, 1000):
        verified = grounding.verify_findings(findings, incidents, hot_rows=hot_rows)
        assert _exchanges_with(spark, written.pop(), "source_text") == 1 and _exchanges_with(spark, verified, "source_text") == 0
        assert sorted((r.seq, r.reason or "") for r in verified.collect()) == [
            (0, ""), (0, "quote-not-verbatim"), (1, "duplicate-finding"), (1, "duplicate-finding"),
            (2, "quote-not-verbatim"), (3, "unknown-incident"), (4, "unknown-incident")]


def test_loaded_facts_are_not_written_again(spark, monkeypatch):
    from registered import registry
    from sitelens.operators.fuel import FuelResult
    written = []
    monkeypatch.setattr(registry, "materialise", lambda df: written.append(df) or df)
    facts, issues = spark.range(2), spark.range(3)
    monkeypatch.setattr(registry, "_fuel", lambda spark, d: FuelResult(facts, facts, issues))
    assert registry._fuel_facts(spark, "nowhere") is facts and written == []
    assert registry.fuel_tables(spark, "nowhere") == [facts, issues] == registry.fuel_tables(spark, "nowhere")
    assert written == [issues]


def test_register_joins_digests_when_no_filter_reads_texts(spark, monkeypatch):
    from registered import registry
    facts = spark.createDataFrame([("a long text",), (None,)], "description string")
    seen = []
    monkeypatch.setattr(registry, "incident_tables", lambda spark, d: [facts, None])
    monkeypatch.setattr(registry, "_as_register", lambda spark, d: None)
    monkeypatch.setattr(registry.reports, "find_incidents", lambda rows, *more, **filters: seen.append(rows) or rows)
    digests = [r.description_md5 for r in registry._register_query(spark, "nowhere").collect()]
    assert digests == [hashlib.md5(b"a long text").hexdigest(), None] == [r.description for r in seen[0].collect()]
    assert registry._register_query(spark, "nowhere", search="long").collect()[0].description_md5 == digests[0]
    assert seen[1] is facts


def _deliveries(spark):
    return spark.createDataFrame(
        [(n % 3, n, f"A{n % 7}", "2025-01-05" if n % 5 else "Oct-25", "Diesel", str(n % 4), "kL", "$5,000.00", "Haul Fleet") for n in range(2, 80)],
        "company_id long, source_row_number long, invoice_no string, delivery_date string, fuel_type string, "
        "quantity string, unit string, cost string, site_area string")


def test_fuel_is_classified_in_slices(spark):
    whole, written = fuel.clean_fuel(_deliveries(spark)), []

    def stage(df):
        written.append(materialise(df))
        return written[-1]

    for hot_rows in (1, 1000):
        written.clear()
        parts = fuel.clean_fuel(_deliveries(spark), hot_rows=hot_rows, stage=stage, slice_bytes=1)
        parsed, *slices, _ = written
        assert len(slices) == fuel.MOST_SLICES and sum(s.count() for s in slices) == 78
        # No invoice number is in two of them.
        assert sum(s.select("company_id", "invoice_no").distinct().count() for s in slices) == 21
        assert whole.facts.exceptAll(parts.facts).isEmpty() and parts.facts.exceptAll(whole.facts).isEmpty()
        assert whole.issues.exceptAll(parts.issues).isEmpty() and parts.issues.exceptAll(whole.issues).isEmpty()
        # Parsed rows go once all are classified; a table that nobody has staged is left alone.
        assert session.staged_bytes(slices[0]) > 0 and not os.path.exists(parsed._staged)
        session.discard(whole.facts)


def test_a_written_table_leaves_no_shuffle_behind(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles().mkString(" ").split()
        return {f for f in files if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}

    before = shuffles()
    materialise(spark.range(1000).repartition(5, "id"))
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        # What listeners still hold goes with the next table.
        materialise(spark.range(1))
    assert not shuffles() - before


def test_counts_of_issues_make_no_texts(spark):
    rows = mark(fuel.classify_rows(_deliveries(spark)), fuel.row_checks())
    issues = explode_issues(rows, fuel.row_checks())
    counted = issues.groupBy("company_id", "rule_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Works out at" not in counted and "Works out at" in issues._jdf.queryExecution().optimizedPlan().toString()
