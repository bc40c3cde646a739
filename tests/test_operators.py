"""Normalisers, skew-safe operators against brute force, gates."""

import itertools
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sitelens.functions import normalise
from sitelens.operators.citations import verify_claims
from sitelens.operators.components import connected_components
from sitelens.operators.fuel import clean_fuel
from sitelens.operators.grounding import verify_findings
from sitelens.operators.incidents import clean_incidents
from sitelens.operators.skew import exact_median, number_in_order, number_within
from sitelens.operators.suppliers import near_name_links
from sitelens.session import materialise
from sitelens.sources.csv_export import read_export


def apply(spark, fn, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_dates(spark):
    got = apply(spark, normalise.normalise_date,
                ["2025-12-19", "21/05/2026", "3/4/2025", "Oct-25", "October-25", "31/02/2025", "05/21/2026",
                 "Foo-25", "", "2025-02-30", "19.12.2025"])
    assert [(str(g.value), g.precision, g.error) for g in got] == [
        ("2025-12-19", "day", None), ("2026-05-21", "day", None), ("2025-04-03", "day", None),
        ("2025-10-01", "month", None), ("2025-10-01", "month", None), ("None", None, "not-a-date"),
        ("None", None, "month-first"), ("None", None, "unknown-month"), ("None", None, "empty"),
        ("None", None, "not-a-date"), ("None", None, "unknown-format")]


def test_amounts_numbers_names(spark):
    got = apply(spark, normalise.parse_amount, ["$182,946.64", "132182.58", "$-23,375.00", "-$1.00", "N/A", "1.2.3", ""])
    assert [None if g.value is None else float(g.value) for g in got] == [182946.64, 132182.58, -23375, -1, None, None, None]
    got = apply(spark, normalise.normalise_abn, ["51 824 753 556", "51824753557", "1234567", ""])
    assert [(g.present, g.well_formed, g.checksum_valid) for g in got] == [
        (True, True, True), (True, True, False), (True, False, False), (False, False, False)]
    assert apply(spark, normalise.canonical_name, ["Alpha & Sons Pty Ltd", "Co Pty Ltd", "Coral Coast P/L"]) == [
        "alpha and sons", "co", "coral coast"]
    got = apply(spark, normalise.normalise_severity, ["1", "Low", "HIGH", "4", ""])
    assert [g.severity for g in got] == [1, 1, 3, None, None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_names_against_brute_force(spark):
    rng = random.Random(7)
    names = set()
    for _ in range(60):
        base = "".join(rng.choice("abc") for _ in range(rng.randint(10, 13)))
        names.add(base)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(base))
            base = rng.choice([base[:i] + base[i + 1:], base[:i] + "b" + base[i:], base[:i] + "c" + base[i + 1:]])
        names.add(base)
    names = sorted(names)
    df = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "company_id long, name_canonical string, node long")
    label = list(range(len(names)))
    for _ in names:
        for i, j in itertools.combinations(range(len(names)), 2):
            if min(len(names[i]), len(names[j])) >= 10 and edits(names[i], names[j]) <= 2:
                label[i] = label[j] = min(label[i], label[j])
    # As names meet on three segments, with a few keys crowded, and with all of them, down to single characters.
    for crowd in (256, 3, 0):
        links = near_name_links(df, crowd)
        for r in links.collect():
            assert edits(names[r.a], names[r.b]) <= 2
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert [got.get(i, i) for i in range(len(names))] == label


def test_many_names_share_a_segment(spark):
    """One long common beginning, random ends, planted neighbours; and numbered names, nearly all of them near."""
    n = int(os.environ.get("SITELENS_CROWD_NAMES", "2000"))
    rng = random.Random(9)
    names, want = [], set()
    for i in range(n):
        code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
        names.append("mining services " + code)
        if i % 50 == 0:
            at, other = rng.randrange(14), rng.randrange(14)
            near = rng.choice([code[:at] + code[at + 1:], code[:at] + "0" + code[at:],
                               code[:at] + "0" + code[at + 1:other] + "1" + code[other + 1:] if at < other else "00" + code])
            want.add((len(names) - 1, len(names)))
            names.append("mining services " + near)
    numbered = [f"pit supplier {k:04d}" for k in range(300)]
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate(names)] + [(2, x, i) for i, x in enumerate(numbered)],
                               "company_id long, name_canonical string, node long").repartition(8)
    links = materialise(near_name_links(df))
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.where("company_id = 1").collect()} == want
    two = connected_components(links.where("company_id = 2"))
    assert two.where("component = 0").count() == len(numbered)


def test_exact_median_and_numbering(spark):
    rng = random.Random(3)
    data = [(k, round(rng.choice([1, 1e3, 1e9]) * rng.uniform(-1, 1), 2)) for k in range(4) for _ in range(3 + 7 * k)]
    df = spark.createDataFrame(data, "k int, v double").withColumn("v", F.col("v").cast("decimal(14,2)"))
    for r in exact_median(df, ["k"], "v", 2, "m").collect():
        assert r.m == pytest.approx(statistics.median([v for k, v in data if k == r.k]), abs=1e-6)
    lines = spark.range(700).select((F.col("id") % 3).alias("k"), F.col("id").alias("line"))
    assert number_within(lines, ["k"], "line", "pos", 50).where("pos <> floor(line / 3) + 1").isEmpty()
    assert number_in_order(lines, "k", ["line"], "pos").where("pos <> floor(line / 3) + 1").isEmpty()


def test_hot_keys_change_nothing(spark):
    """The hot-key path (threshold 1) and the plain path give the same tables."""
    raw = spark.createDataFrame(
        [(1, i, f"A{i % 3}", "2025-01-05", "Diesel", str(i % 4), "kL", "$5,000.00", "Haul Fleet") for i in range(2, 60)],
        "company_id long, source_row_number long, invoice_no string, delivery_date string, fuel_type string, "
        "quantity string, unit string, cost string, site_area string")
    plain, hot = clean_fuel(raw), clean_fuel(raw, hot_rows=1)
    assert plain.facts.exceptAll(hot.facts).isEmpty() and plain.issues.exceptAll(hot.issues).isEmpty()
    assert plain.facts.count() == 3


def test_incident_groups(spark):
    raw = spark.createDataFrame(
        [(1, 2, "I-1", "2025-01-01", "Haul Fleet", "DUS", "Low", "same text at the CRUSHER"),
         (1, 3, "I-1", "2025-01-02", "Processing Plant", "ZZZ", "2", "same text at the CRUSHER"),
         (1, 4, "I-5", "31/02/2025", "Site Services", "DUS", "2", "x"),
         (1, 5, "I-40", "2025-01-04", "Site Services", "DUS", "9", "y")],
        "company_id long, source_row_number long, incident_id string, incident_date string, location string, "
        "type_code string, severity string, description string")
    result = clean_incidents(raw)
    keys = {(r.rule_id, r.record_key) for r in result.issues.collect()}
    assert {("INC-DESC-REUSED-01", "I-1 ... I-1-2"), ("INC-ID-SEQUENCE-01", "I-40"), ("INC-LOCATION-01", "I-1"),
            ("INC-TYPE-UNKNOWN-01", "I-1"), ("INC-DUP-ID-01", "I-5")} <= keys
    assert sorted(r.id for r in result.facts.collect()) == ["I-1", "I-1-2", "I-40"]
    assert result.members.count() == 3


def test_grounding(spark):
    incidents = spark.createDataFrame([(1, "A", 2, "Pump failed at dawn."), (1, "B", None, "Other text")],
                                      "company_id long, id string, severity int, description string")
    rows = [("A", "pump failed"), ("A", " Pump failed "), ("A", "Pump"), ("B", " "), ("C", "x"), ("B", "Pump failed")]
    findings = spark.createDataFrame([(1, i, inc, q, 1) for i, (inc, q) in enumerate(rows)],
                                     "company_id long, seq long, incident_id string, evidence_quote string, severity_assessment int")
    for hot in (1_000_000, 1):
        got = {r.seq: r for r in verify_findings(findings, incidents, hot_rows=hot).collect()}
        assert [got[i].reason for i in range(6)] == [
            "quote-not-verbatim", None, "duplicate-finding", "quote-empty", "unknown-incident", "quote-not-verbatim"]
        assert got[1].severity_mismatch and got[1].evidence_quote == "Pump failed"


def test_citations(spark):
    facts = spark.createDataFrame(
        [(1, "TOTAL-T", "Total, Scope 1 plus Scope 2", "46929.8", 46929.8, None),
         (1, "INC-2025-11", "Incident", "2025-03-01", None, "12 hours"), (1, "A B", "odd id", "7", 7.0, None)],
        "company_id long, id string, label string, value string, value_num double, detail string")
    cases = [("Total was 46,930 t.", ["TOTAL-T"], None), ("Total was 46,931 t.", ["TOTAL-T"], "unsupported-number"),
             ("Total was 4,693 t.", ["TOTAL-T"], "unsupported-number"), ("In 2025 it fell.", ["TOTAL-T"], None),
             ("No source.", [], "no-citations"), ("Ghost.", ["NOPE"], "unknown-fact"),
             ("INC-2025-11 took 12 hours.", ["INC-2025-11"], None), ("INC-2025-11 took long.", ["TOTAL-T"], "uncited-record"),
             ("INC-2025-118 is another one.", ["INC-2025-11"], "unsupported-number"),
             ("See A B here.", ["TOTAL-T"], "uncited-record"), ("A−7 change", ["TOTAL-T"], "unsupported-number")]
    claims = spark.createDataFrame([(1, "R", i, "Headline", t, c) for i, (t, c, _) in enumerate(cases)],
                                   "company_id long, report_id string, seq long, section string, text string, citations array<string>")
    got = {r.seq: r.reason for r in verify_claims(claims, facts).collect()}
    for i, (text, _, want) in enumerate(cases):
        assert got[i] == want, text


def test_mentions_are_found_by_rare_tokens(spark):
    """A token in a third of the claims does not anchor an id that has a rarer one; where it must, slots do the work."""
    facts = spark.createDataFrame(
        [(1, "TOTAL 7 A", "odd", "7", 7.0, None), (1, "TOTAL #", "odd", "1", 1.0, None), (1, "OK", "plain", "1", 1.0, None)],
        "company_id long, id string, label string, value string, value_num double, detail string")
    texts = [("TOTAL of all.", None), ("See TOTAL 7 A here.", "uncited-record"), ("Plain words.", None), ("A TOTAL # too.", "uncited-record"),
             ("TOTAL 7 AB is none.", "unsupported-number"), ("A 7 TOTAL is none.", "unsupported-number")] * 10
    claims = spark.createDataFrame([(1, "R", i, "Headline", t, ["OK"]) for i, (t, _) in enumerate(texts)],
                                   "company_id long, report_id string, seq long, section string, text string, citations array<string>")
    for hot in (1_000_000, 5, 0):
        got = {r.seq: r.reason for r in verify_claims(claims, facts, hot).collect()}
        assert [got[i] for i in range(len(texts))] == [want for _, want in texts], hot


def test_fact_digest_depends_on_facts_and_order(spark, monkeypatch):
    from sitelens.operators import citations
    rows = [(c, f"F-{i:03d}", "metric", f"label {i}", str(i), None if i % 3 else "t", "src", None, i) for c in (1, 2) for i in range(40)]
    names = "company_id long, id string, kind string, label string, value string, unit string, source string, detail string, at long"
    def digests(rows, order=("id",)):
        return {r.company_id: r.fact_digest for r in citations.fact_digest(spark.createDataFrame(rows, names).repartition(3), order).collect()}
    monkeypatch.setattr(citations, "DIGEST_CHUNK", 7)
    base = digests(rows)
    assert base[1] == base[2] == digests(rows[::-1])[1]
    changed = [(*r[:4], "other", *r[5:]) if r[:2] == (2, "F-020") else r for r in rows]
    assert digests(changed)[1] == base[1] and digests(changed)[2] != base[2]
    swapped = [(*r[:8], {3: 30, 30: 3}.get(r[8], r[8])) if r[0] == 2 else r for r in rows]
    assert digests(swapped, ("at",))[1] == base[1] and digests(swapped, ("at",))[2] != base[2]
    moved = [(r[0], r[1], r[2], r[3], r[4], None, (r[5] or "") + r[6], r[7], r[8]) for r in rows]
    assert digests(moved)[1] != base[1]


def strict_fields(line):
    """Fields of a record whose quotes wrap whole fields, else None."""
    out, at = [], 0
    while True:
        if line[at:at + 1] == '"':
            text, at = "", at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                text += line[at:end]
                at = end + 1
                if line[at:at + 1] != '"':
                    break
                text, at = text + '"', at + 1
        else:
            end = line.find(",", at)
            text = line[at:end if end >= 0 else len(line)]
            if '"' in text:
                return None
            at += len(text)
        out.append(text)
        if at == len(line):
            return out
        if line[at] != ",":
            return None
        at += 1


def test_csv(spark, tmp_path):
    folder = tmp_path / "company_id=7"
    folder.mkdir()
    (folder / "suppliers.csv").write_text(
        'abn, supplier_name,fy_spend_aud\n1,"A, B",5\n\n2,C,6\n3,D\n4,"E,7\n5,x"y",8\n6,"x" ,8\n7,F,8,9\n"8","","a ""q"", c"\n')
    export = read_export(spark, str(tmp_path), "suppliers.csv")
    assert sorted((r.source_row_number, r.supplier_name, r.category, r.fy_spend_aud) for r in export.rows.collect()) == [
        (2, "A, B", "", "5"), (4, "C", "", "6"), (10, "", "", 'a "q", c')]
    assert sorted((r.source_row_number, r.problem) for r in export.broken.collect()) == [
        (5, "ragged-row"), (6, "unbalanced-quote"), (7, "misplaced-quote"), (8, "misplaced-quote"), (9, "ragged-row")]
    assert export.headers.first().raw_headers == ["abn", " supplier_name", "fy_spend_aud"]


def test_csv_against_a_strict_reader(spark, tmp_path):
    """Random records of two tenants with different columns; which parse, which do not, and to what."""
    r = random.Random(6)
    want = {}
    for tenant, header in ((1, ["supplier_name", "abn", "category"]), (2, ["category", "more", "abn", "fy_spend_aud", "supplier_name"])):
        folder = tmp_path / f"company_id={tenant}"
        folder.mkdir()
        lines = ["\ufeff" + ",".join(header)]
        for n in range(600):
            line = "".join(r.choice(['"', '""', ",", ",", "a", " ", "é", "b c", '"x"', '"y,z"', "'", "\\", "#"]) for _ in range(r.randint(1, 9)))
            if n % 3:  # nearer to well-formed
                line = ",".join(r.choice(["", "v", '"q"', '"a ""b"""', '"c,d"', " s ", '""']) for _ in header)
            lines.append(line)
            fields = strict_fields(line)
            if line.strip():
                want[tenant, n + 2] = tuple(fields[header.index(c)] if c in header else "" for c in ("supplier_name", "abn", "category")) \
                    if fields and len(fields) == len(header) else None
        (folder / "suppliers.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    export = read_export(spark, str(tmp_path), "suppliers.csv")
    got = {(x.company_id, x.source_row_number): (x.supplier_name, x.abn, x.category) for x in export.rows.collect()}
    got |= {(x.company_id, x.source_row_number): None for x in export.broken.collect()}
    assert got == want
    assert sum(v is not None for v in want.values()) > 300
    # The parsed records are staged: the rows scan no text, and parse nothing again.
    plan = export.rows._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.lower().split("parquet")[0] and "from_csv" not in plan.lower()
