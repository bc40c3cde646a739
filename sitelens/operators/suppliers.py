"""Supplier cleaning and entity resolution without comparing all pairs."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.functions.normalise import canonical_name, normalise_abn
from sitelens.functions.numbers import parse_decimal, plain, strip
from sitelens.operators.components import connected_components
from sitelens.operators.ledger import Check, check, explode_issues, file_issue, issue, mark
from sitelens.operators.skew import HOT_ROWS, attach
from sitelens.session import materialise

RAW_COLUMNS = ["supplier_name", "abn", "category", "fy_spend_aud"]

# Largest edit distance of a near match, least name length for one.
MAX_EDITS = 2
MIN_FUZZY_LENGTH = 10

# Names of one key that are compared with each other. Where more meet, their names
# meet again on longer keys.
CROWD = 256


class SupplierResult(NamedTuple):
    facts: DataFrame
    issues: DataFrame


def parse_suppliers(raw: DataFrame) -> DataFrame:
    """A spend that cannot be read, blank included, stays null."""
    text = raw.select("company_id", F.col("source_row_number").cast("bigint").alias("source_row_number"),
                      *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RAW_COLUMNS])
    parsed = text.withColumn("a", normalise_abn(F.col("abn")))
    return parsed.select(
        "company_id", "source_row_number", "supplier_name",
        canonical_name(F.col("supplier_name")).alias("name_canonical"),
        F.when(F.col("abn") != "", F.col("abn")).alias("abn_raw"), F.col("a.digits").alias("abn"),
        F.col("a.well_formed").alias("abn_well_formed"), F.col("a.checksum_valid").alias("abn_valid"),
        F.when(F.col("category") != "", F.col("category")).alias("category"),
        parse_decimal(F.col("fy_spend_aud")).try_cast("decimal(14,2)").alias("fy_spend_aud"))


def name_keys(segments: int) -> tuple[Column, Column]:
    """Keys on which names within two edits meet, as arrays of BIGINT: own ones and sought ones.

    A name of l characters is cut into s segments (at most l). Two edits lie in at most
    two of them, so for some two segments a < b the near name has the same text before a,
    between a and b (moved by at most two places) and after b (moved by the difference of
    the lengths). A key is the hash of l, a, b and those three texts.

    Own keys leave out every two segments of the name itself. Sought keys are those that a
    name as long or shorter by one or two may have: a longer name seeks a shorter one, and
    of two equally long ones the one whose middle lies one place further on. So with three
    segments a name has 3 + 10 keys, with s segments at most 7 s (s - 1) / 2.
    """
    parts = """concat(substring(name_canonical, 1, a * l div s), '|',
        substring(name_canonical, (a + 1) * l div s + d + 1, b * l div s - (a + 1) * l div s), '|',
        substring(name_canonical, (b + 1) * l div s + n - l + 1))"""
    key = f"xxhash64(company_id, l, a, b, {parts})"

    def every(shifts: str, lengths: str) -> Column:
        return F.expr(f"""flatten(transform({lengths}, l -> flatten(transform(array(least({segments}, l)), s ->
            flatten(transform(sequence(0, s - 2), a -> flatten(transform(sequence(a + 1, s - 1), b ->
                transform({shifts}, d -> {key})))))))))""")

    # Two neighbours leave nothing between them, so nothing is moved.
    sought = """CASE WHEN b = a + 1 THEN CASE WHEN n > l THEN array(0) ELSE slice(array(0), 1, 0) END
        WHEN n > l THEN sequence(0, n - l) ELSE array(1) END"""
    lengths = f"filter(sequence(n - 2, n), l -> l >= {MIN_FUZZY_LENGTH})"
    return every("array(0)", "array(n)"), every(sought, lengths)


def near_name_links(names: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links that connect every pair of distinct names within two edits.

    ``names``: company_id, name_canonical, node. Names are cut into three segments and
    meet on keys (see ``name_keys``); names that meet are compared. Where more than
    ``crowd`` names have or seek a key, nothing is compared, and all its names go on to
    keys of more segments, which hold more of the name: 4, 6, 10, 18 and so on. A pair
    that meets only on crowded keys is among those, so no pair is lost. At last segments
    are single characters. Then names that own a key differ in two places at most, and
    are linked to one of them; there are no more than the square of the alphabet.

    Joins are merged, never broadcast (see ``attach``).
    """
    pending = names.where(F.length("name_canonical") >= MIN_FUZZY_LENGTH) \
        .select("company_id", "node", "name_canonical", F.length("name_canonical").alias("n"))
    longest = pending.agg(F.max("n")).first()[0]
    links = names.select("company_id", F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    kept = 1
    while longest is not None:
        segments, last = min(kept + 2, longest), kept + 2 >= longest
        own, sought = name_keys(segments)
        keys = F.concat(F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(0).alias("seeks"))),
                        F.transform(sought, lambda k: F.struct(k.alias("key"), F.lit(1).alias("seeks"))))
        rows = pending.select("company_id", "node", "name_canonical", F.explode(keys).alias("k")) \
            .select("company_id", "node", "name_canonical", "k.key", "k.seeks")
        groups = rows.groupBy("company_id", "key").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("seeks").alias("seekers"), F.min(F.when(F.col("seeks") == 0, F.col("node"))).alias("centre"),
            F.min("node").alias("low"), F.max("node").alias("high")).where("centre is not null and low < high") \
            .withColumn("owners", F.col("rows") - F.col("seekers")).drop("low", "high")
        met = materialise(attach(rows, groups, ["company_id", "key"], "rows", F.col("node"), merge=True)
                          .where("centre is not null"))
        crowded = F.lit(False) if last else (F.col("owners") > crowd) | (F.col("seekers") > crowd)
        few = met.where(~crowded).select("company_id", "key", "seeks", "node", "name_canonical", "centre")
        have = few.where("seeks = 0").select("company_id", "key", F.col("node").alias("b"), F.col("name_canonical").alias("y"), "centre")
        # Owners of a key of single characters are all near each other: one of them is enough.
        partners = (have.where("b = centre") if last else have).select("company_id", "key", F.col("b"), F.col("y"))
        equal = have.select("company_id", "key", F.col("b").alias("a"), F.col("y").alias("x")).join(partners.hint("merge"), ["company_id", "key"]) \
            .where("a > b")
        moved = few.where("seeks = 1").select("company_id", "key", F.col("node").alias("a"), F.col("name_canonical").alias("x")) \
            .join(have.drop("centre").hint("merge"), ["company_id", "key"]).where("a <> b")
        links = links.unionByName(equal.unionByName(moved).where(F.levenshtein("x", "y", MAX_EDITS) >= 0).select("company_id", "a", "b"))
        if last:
            break
        pending = materialise(met.where(crowded).groupBy("company_id", "node").agg(F.first("name_canonical").alias("name_canonical"))
                              .withColumn("n", F.length("name_canonical")))
        longest, kept = pending.agg(F.max("n")).first()[0], kept * 2
    return links.distinct()


def supplier_clusters(parsed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(company_id, name_canonical, component)`` for names that belong together.

    Rows with one canonical name are one node. Nodes are linked by a shared ABN
    (even a malformed one) through the smallest node of that ABN, and by near
    names. ``component`` is a node number: the smallest line of a name.
    """
    nodes = materialise(parsed.groupBy("company_id", "name_canonical").agg(
        F.min("source_row_number").alias("node"), F.count(F.lit(1)).alias("name_rows")))
    abn_names = parsed.where("abn is not null").groupBy("company_id", "abn", "name_canonical") \
        .agg(F.count(F.lit(1)).alias("_")).drop("_") \
        .join(nodes.drop("name_rows").hint("merge"), ["company_id", "name_canonical"])
    hubs = abn_names.groupBy("company_id", "abn").agg(
        F.min("node").alias("hub"), F.count(F.lit(1)).alias("names")).where("names > 1")
    by_abn = attach(abn_names.select("company_id", "abn", "node"), hubs, ["company_id", "abn"],
                    "names", F.col("node"), hot_rows, merge=True) \
        .where("hub is not null and hub <> node") \
        .select("company_id", F.col("node").alias("a"), F.col("hub").alias("b"))
    components = connected_components(by_abn.unionByName(near_name_links(nodes)))
    return nodes.join(components.hint("merge"), ["company_id", "node"], "left").select(
        "company_id", "name_canonical", "name_rows",
        F.coalesce("component", "node").alias("component"))


def resolve_suppliers(parsed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Link every row of a cluster to its primary row.

    Primary: a row with an ABN before one without, then the larger spend, then the
    earlier line. Larger clusters than two get one primary for all their rows.
    """
    clusters = supplier_clusters(parsed, hot_rows)
    grouped = attach(parsed, clusters, ["company_id", "name_canonical"], "name_rows",
                     F.col("source_row_number"), hot_rows, merge=True).drop("name_rows")
    rank = F.struct(F.col("abn").isNull().alias("without_abn"),
                    (-F.coalesce("fy_spend_aud", F.lit(0).cast("decimal(14,2)"))).alias("less"),
                    F.col("source_row_number").alias("line"))
    best = grouped.groupBy("company_id", "component").agg(
        F.min(rank).alias("best"), F.count(F.lit(1)).alias("cluster_rows"),
        F.sum("fy_spend_aud").alias("cluster_spend"))
    primaries = best.select("company_id", "component", "cluster_rows", "cluster_spend",
                            F.col("best.line").alias("primary_line"))
    details = parsed.select(
        "company_id", F.col("source_row_number").alias("primary_line"),
        F.col("supplier_name").alias("primary_name"), F.col("name_canonical").alias("primary_canonical"),
        F.col("abn").alias("primary_abn"), F.col("category").alias("primary_category"),
        F.col("fy_spend_aud").alias("primary_spend"))
    primaries = primaries.where("cluster_rows > 1").join(details.hint("merge"), ["company_id", "primary_line"])
    linked = attach(grouped, primaries, ["company_id", "component"], "cluster_rows",
                    F.col("source_row_number"), hot_rows, merge=True)
    is_duplicate = F.coalesce(F.col("primary_line") != F.col("source_row_number"), F.lit(False))
    distance = F.levenshtein("name_canonical", "primary_canonical", MAX_EDITS)
    near = (F.least(F.length("name_canonical"), F.length("primary_canonical")) >= MIN_FUZZY_LENGTH) \
        & (distance >= 0)
    reason = F.when(F.col("abn") == F.col("primary_abn"), "identical-abn") \
        .when(F.col("name_canonical") == F.col("primary_canonical"), "identical-canonical-name") \
        .when(near, "near-identical-name").otherwise("linked-through-cluster")
    moved = is_duplicate & F.col("category").isNotNull() & F.col("primary_category").isNotNull()
    return linked.select(
        "company_id", "source_row_number", "supplier_name", "name_canonical", "abn_raw", "abn",
        "abn_well_formed", "abn_valid", "category",
        F.when(moved, F.col("primary_category")).otherwise(F.col("category")).alias("category_canonical"),
        "fy_spend_aud",
        F.when(is_duplicate, F.col("primary_line")).alias("duplicate_of_row"),
        F.when(is_duplicate, reason).alias("match_reason"),
        F.when(is_duplicate & (reason == "near-identical-name"), distance).alias("edit_distance"),
        F.when(is_duplicate, F.col("primary_name")).alias("duplicate_of_name"),
        F.when(is_duplicate, F.col("primary_spend")).alias("primary_spend"),
        F.when(is_duplicate, F.col("cluster_spend")).alias("cluster_spend"))


def supplier_issues(resolved: DataFrame) -> DataFrame:
    line, key = F.col("source_row_number"), F.col("supplier_name")
    row_checks = [
        check(
            ~F.col("abn_well_formed"), "SUP-ABN-FORM-01",
            F.when(F.col("abn").isNotNull(), F.concat(
                F.lit("Business number has "), F.length("abn").cast("string"), F.lit(" digits, not 11.")))
            .otherwise(F.lit("No business number; loaded as null.")),
            line, key, "abn", F.coalesce("abn_raw", F.lit("(blank)"))),
        check(
            F.col("duplicate_of_row").isNotNull(), "SUP-DUP-01",
            F.concat(F.lit("Linked to '"), "duplicate_of_name", F.lit("' ("), "match_reason",
                     F.coalesce(F.concat(F.lit(", distance "), F.col("edit_distance").cast("string")), F.lit("")),
                     F.lit("). The entity spends "), plain(F.col("cluster_spend")),
                     F.lit(", the primary row alone "), F.coalesce(plain(F.col("primary_spend")), F.lit("nothing known")),
                     F.lit(".")),
            line, key, "supplier_name", key, F.concat(F.lit("duplicate of "), "duplicate_of_name")),
        check(
            F.col("category_canonical") != F.col("category"), "SUP-CATEGORY-01", F.lit("Category taken from the primary row."),
            line, key, "category", F.col("category"), F.col("category_canonical")),
    ]
    well_formed = F.col("abn_well_formed")
    checks = resolved.groupBy("company_id").agg(
        F.count_if(well_formed).alias("well_formed"),
        F.count_if(well_formed & ~F.col("abn_valid")).alias("failing")) \
        .where("well_formed > 0 and failing = well_formed")
    return explode_issues(mark(resolved, row_checks), row_checks).unionByName(file_issue(checks, issue(
        "SUP-ABN-CHECKSUM-01",
        F.concat(F.lit("All "), F.col("well_formed").cast("string"),
                 F.lit(" well-formed business numbers fail the checksum.")),
        field="abn", original=F.concat(F.col("failing").cast("string"), F.lit("/"),
                                       F.col("well_formed").cast("string"), F.lit(" fail checksum")))))


def clean_suppliers(raw: DataFrame, hot_rows: int = HOT_ROWS,
                    stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> SupplierResult:
    resolved = stage(resolve_suppliers(stage(parse_suppliers(raw)), hot_rows))
    facts = resolved.drop("match_reason", "edit_distance", "primary_spend", "cluster_spend")
    return SupplierResult(facts, supplier_issues(resolved))
