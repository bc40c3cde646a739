"""Citation gate: a sentence may state only what the facts it cites contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelens.operators.skew import HOT_ROWS, SLOTS, attach, number_in_order

# Fixed values.
SECTIONS = ["Headline", "Emissions", "Safety", "Data quality", "Watch list"]
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
TOKEN = r"[A-Za-z0-9-]+"
YEARS = (1900, 2100)
KEEP_SHARE = 0.7
DIGEST_CHUNK = 1024

CLAIM_KEY = ["company_id", "report_id", "seq"]


def number_tokens(text: Column) -> Column:
    """Numbers as written; a minus sign or en dash counts as a hyphen."""
    return F.regexp_extract_all(F.translate(text, "\u2212\u2013", "--"), F.lit(NUMBER), F.lit(0))


def _value(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).cast("double")


def _decimals(token: Column) -> Column:
    return F.length(F.regexp_extract(token, r"\.(\d+)$", 1))


def _matches(token: Column, value: Column) -> Column:
    """Equal within half a unit of the last written decimal."""
    half_unit = F.lit(0.5) * F.pow(F.lit(10.0), -_decimals(token))
    return F.abs(_value(token) - value) <= half_unit + F.lit(1e-9)


def _is_year(token: Column) -> Column:
    return (_decimals(token) == 0) & _value(token).between(*YEARS)


def fact_numbers(facts: DataFrame) -> DataFrame:
    """Every figure a fact puts on the table: value, and numbers in value, label, detail."""
    texts = F.concat(*[F.transform(number_tokens(F.coalesce(c, F.lit(""))), _value)
                       for c in ("value", "label", "detail")])
    own = F.filter(F.array(F.col("value_num").cast("double")), lambda v: v.isNotNull())
    return facts.select("company_id", "id", F.concat(own, texts).alias("numbers"))


def _whole_token(identifier: Column) -> Column:
    """Pattern of an id that is not part of a longer token."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(identifier, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit("(?<![A-Za-z0-9-])"), quoted, F.lit("(?![A-Za-z0-9-])"))


def _uncited_mentions(claims: DataFrame, facts: DataFrame, hot_rows: int) -> DataFrame:
    """Fact ids that stand in a claim's text as whole tokens without being cited."""
    tokens = claims.select(*CLAIM_KEY, F.explode(F.array_except(
        F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))), "citations")).alias("token"))
    # Counting tokens first folds frequent words before they meet the facts.
    counted = tokens.groupBy("company_id", "token").agg(F.count(F.lit(1)).alias("key_rows"))
    anchored = facts.select("company_id", "id", F.regexp_extract("id", TOKEN, 0).alias("token"))
    plain = anchored.where("id = token")
    known = counted.join(plain, ["company_id", "token"], "left")
    direct = attach(tokens, known, ["company_id", "token"], "key_rows", F.col("seq"), hot_rows) \
        .where("id is not null").select(*CLAIM_KEY, "id")
    # Ids with other characters are found by their rarest token, then checked whole. All
    # tokens count here: a cited id may share a token.
    odd = anchored.where("id <> token and token <> ''")
    every = claims.select(*CLAIM_KEY, F.explode(F.array_distinct(
        F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    frequency = every.groupBy("company_id", "token").agg(F.count(F.lit(1)).alias("uses"))
    anchors = odd.select("company_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("id", F.lit(TOKEN), F.lit(0)))).alias("token")) \
        .join(frequency, ["company_id", "token"], "left").groupBy("company_id", "id") \
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("rarest")) \
        .where("rarest.uses > 0").select("company_id", "id", F.col("rarest.token").alias("token"), F.col("rarest.uses").alias("uses"))
    # Anchors used more often than ``hot_rows`` meet their claims on slots; the others directly.
    slots = F.when(F.col("uses") > hot_rows, F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    hot = anchors.where(F.col("uses") > hot_rows).select("company_id", "token", F.lit(True).alias("hot")).distinct()
    slot = F.when(F.col("hot"), F.pmod(F.xxhash64("report_id", "seq"), F.lit(SLOTS)).cast("int")).otherwise(F.lit(0))
    # Fewer than claims' tokens / hot_rows tokens are hot, which bounds the broadcast.
    indirect = every.join(F.broadcast(hot), ["company_id", "token"], "left").withColumn("slot", slot) \
        .join(anchors.withColumn("slot", F.explode(slots)), ["company_id", "token", "slot"]).select(*CLAIM_KEY, "id") \
        .join(claims.select(*CLAIM_KEY, "text", "citations"), CLAIM_KEY) \
        .where(~F.array_contains("citations", F.col("id"))) \
        .where(F.regexp_like("text", _whole_token(F.col("id")))).select(*CLAIM_KEY, "id")
    return direct.unionByName(indirect).groupBy(*CLAIM_KEY).agg(
        F.array_sort(F.collect_set("id")).alias("uncited"))


def verify_claims(claims: DataFrame, facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``reason`` (null = accepted) and ``detail`` to every claim.

    ``claims``: company_id, report_id, seq, section, text, citations. ``facts``:
    company_id, id (with at least one letter or digit), label, value, value_num,
    detail. Reasons in order: no-citations, unknown-fact, uncited-record,
    unsupported-number.
    """
    claims = claims.withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
    cited = claims.select(*CLAIM_KEY, F.posexplode("citations").alias("pos", "id"))
    sizes = cited.groupBy("company_id", "id").agg(F.count(F.lit(1)).alias("key_rows"))
    numbers = sizes.join(fact_numbers(facts), ["company_id", "id"], "left")
    looked_up = attach(cited, numbers, ["company_id", "id"], "key_rows", F.col("seq"), hot_rows)
    # Collected per claim: no more than the claim's own citations.
    per_claim = looked_up.groupBy(*CLAIM_KEY).agg(
        F.collect_list(F.when(F.col("numbers").isNull(), F.struct("pos", "id"))).alias("unknown"),
        F.flatten(F.collect_list("numbers")).alias("allowed"))
    joined = claims.join(per_claim, CLAIM_KEY, "left") \
        .join(_uncited_mentions(claims, facts, hot_rows), CLAIM_KEY, "left")
    stripped = F.aggregate("citations", F.col("text"),
                           lambda text, c: F.regexp_replace(text, _whole_token(c), F.lit(" ")))
    allowed = F.coalesce("allowed", F.array().cast("array<double>"))
    unsupported = F.filter(number_tokens(F.col("stripped")), lambda t: ~_is_year(t) & ~F.exists(
        "allowed", lambda v: _matches(t, v)))
    judged = joined.withColumn("stripped", stripped).withColumn("allowed", allowed) \
        .withColumn("unsupported", unsupported)
    unknown_ids = F.transform(F.array_sort("unknown"), lambda u: u["id"])
    reason = F.when(F.size("citations") == 0, "no-citations") \
        .when(F.size(F.coalesce("unknown", F.array())) > 0, "unknown-fact") \
        .when(F.size(F.coalesce("uncited", F.array())) > 0, "uncited-record") \
        .when(F.size("unsupported") > 0, "unsupported-number")
    detail = F.when(F.col("reason") == "unknown-fact", F.array_join(unknown_ids, ", ")) \
        .when(F.col("reason") == "uncited-record", F.array_join("uncited", ", ")) \
        .when(F.col("reason") == "unsupported-number", F.array_join("unsupported", ", "))
    return judged.withColumn("reason", reason).withColumn("detail", detail) \
        .select(*claims.columns, "reason", "detail")


def distinct_claims(claims: DataFrame) -> DataFrame:
    """First of the claims of a report with equal text, ignoring case and outer space."""
    key = F.lower(F.trim("text"))
    firsts = claims.groupBy("company_id", "report_id", F.unhex(F.sha2(key, 256)).alias("k")) \
        .agg(F.min("seq").alias("seq"))
    return claims.join(firsts.drop("k"), CLAIM_KEY, "left_semi")


def two_round_outcome(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted claims of both rounds without repeats, and the rejection ledger.

    ``first`` and ``second`` are verified claims; second-round ``seq`` follows the first.
    """
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return (distinct_claims(both.where("reason is null")).drop("reason", "detail", "round"),
            both.where("reason is not null"))


def by_section(accepted: DataFrame) -> DataFrame:
    """Claims in display order: fixed section order, then document order; empty sections vanish.

    One row per claim with its section's position, rather than one nested document.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return accepted.withColumn("section_order", place.cast("int")).where("section_order > 0") \
        .orderBy("company_id", "report_id", "section_order", "seq")


def recheck_reports(reports: DataFrame, claims: DataFrame, facts: DataFrame, digests: DataFrame) -> DataFrame:
    """Stored reports against current facts: claims still shown or dropped, facts changed.

    ``reports``: company_id, report_id, fact_digest. ``digests``: company_id, fact_digest.
    """
    tally = verify_claims(claims, facts).groupBy("company_id", "report_id").agg(
        F.count(F.lit(1)).alias("claims_checked"),
        F.count_if(F.col("reason").isNull()).alias("claims_shown"),
        F.count_if(F.col("reason").isNotNull()).alias("claims_dropped"))
    current = digests.select("company_id", F.col("fact_digest").alias("current_digest"))
    return reports.select("company_id", "report_id", "fact_digest") \
        .join(tally, ["company_id", "report_id"], "left").join(current, "company_id", "left") \
        .select("company_id", "report_id",
                *[F.coalesce(c, F.lit(0)).alias(c) for c in ("claims_checked", "claims_shown", "claims_dropped")],
                (~F.col("fact_digest").eqNullSafe(F.col("current_digest"))).alias("facts_changed"))


def offered_reports(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether a report still describes a tenant: at least 70% of its claims verify."""
    return verify_claims(claims, facts).groupBy("company_id", "report_id").agg(
        F.avg(F.col("reason").isNull().cast("double")).alias("share")) \
        .withColumn("offered", F.col("share") >= KEEP_SHARE)


def artefact_claims(claims: DataFrame, tenants: DataFrame, report_id: str) -> DataFrame:
    """Claims of one shared report (a few sentences) as candidates for given tenants."""
    one = claims.where(F.col("report_id") == report_id)
    return tenants.select("company_id").distinct().withColumn("report_id", F.lit(report_id)) \
        .join(one, "report_id").select(*CLAIM_KEY, "section", "text", "citations")


def _fact_line() -> Column:
    """A fact as text; lengths stand before the values, so no two facts read alike."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
                              for c in ("id", "kind", "label", "value", "unit", "source", "detail")])


def fact_digest(facts: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """16 hex digits per tenant that change when any fact, or the order of facts, changes.

    Facts are numbered in ``order`` (unique per tenant) over a range exchange. Every
    ``DIGEST_CHUNK`` neighbours give one SHA-256 over their own hashes, and the chunks'
    digests in order give the tenant's, so a task holds one chunk of a pack, and at last
    64 characters a chunk.
    """
    hashed = facts.select("company_id", *order, F.sha2(_fact_line(), 256).alias("h"))
    chunks = number_in_order(hashed, "company_id", list(order), "place") \
        .groupBy("company_id", F.floor((F.col("place") - 1) / DIGEST_CHUNK).alias("chunk")) \
        .agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("l")) \
        .select("company_id", "chunk", F.size("l").alias("n"),
                F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256).alias("h"))
    return chunks.groupBy("company_id").agg(
        F.sum("n").alias("facts"), F.array_sort(F.collect_list(F.struct("chunk", "h"))).alias("l")) \
        .select("company_id", "facts",
                F.substring(F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256), 1, 16).alias("fact_digest"))
