"""What writes compute: keyed upsert, insert-if-absent, site areas. Publication itself: see ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upserted(current: DataFrame | None, incoming: DataFrame, keys: list[str],
             newest: str | None = None) -> DataFrame:
    """``incoming`` over ``current``: one row per key, incoming first, then the newest."""
    tagged = incoming.withColumn("_age", F.lit(0))
    if current is not None:
        tagged = tagged.unionByName(current.withColumn("_age", F.lit(1)))
    order = [F.col("_age")] + ([F.desc(newest)] if newest else [])
    ranked = tagged.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank", "_age")


def absent(current: DataFrame | None, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet; equal keys inside it collapse."""
    fresh = incoming.dropDuplicates(keys)
    return fresh if current is None else fresh.join(current, keys, "left_anti")


def known_site_areas(areas: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two-tier area resolution.

    ``areas``: name, category, company_id (null = global). ``names``: company_id and
    site_area of all facts. Returns the resolved ``(company_id, site_area, category)``
    and the new tenant-owned rows with category ``unknown``. A blank name resolves to
    nothing. A tenant's row wins over a global one.
    """
    wanted = names.where("site_area is not null and site_area <> ''") \
        .select("company_id", "site_area").distinct()
    own = areas.where("company_id is not null").select(
        "company_id", F.col("name").alias("site_area"), F.col("category").alias("own"))
    shared = areas.where("company_id is null").select(
        F.col("name").alias("site_area"), F.col("category").alias("shared"))
    found = wanted.join(own, ["company_id", "site_area"], "left").join(shared, "site_area", "left")
    fresh = found.where("own is null and shared is null").select(
        F.col("site_area").alias("name"), F.lit("unknown").alias("category"), "company_id")
    resolved = found.select("company_id", "site_area",
                            F.coalesce("own", "shared", F.lit("unknown")).alias("category"))
    return resolved, fresh


def write_findings_artefact(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines in incident order, so that two runs give equal files."""
    findings.orderBy("company_id", "incident_id").write.mode("overwrite").json(path)
