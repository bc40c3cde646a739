"""Emission factors: prose activity to a stable key; an unmapped activity stops the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.numbers import parse_decimal, strip
from sitelens.sources.reference import FACTOR_KEY_BY_ACTIVITY, lookup


def factor_table(raw: DataFrame) -> DataFrame:
    """``raw``: activity, scope, unit, kg_co2e_per_unit, source (text), company_id, line."""
    activity = strip(F.col("activity"))
    return raw.select(
        lookup(FACTOR_KEY_BY_ACTIVITY, activity).alias("factor_key"), activity.alias("activity"),
        strip(F.col("scope")).try_cast("smallint").alias("scope"), strip(F.col("unit")).alias("unit"),
        parse_decimal(strip(F.col("kg_co2e_per_unit"))).cast("decimal(10,4)").alias("kg_co2e_per_unit"),
        strip(F.col("source")).alias("source"), "company_id", "source_row_number")


def unmapped_activities(factors: DataFrame) -> DataFrame:
    """Rows whose activity has no key. The whole load of their tenant must stop."""
    return factors.where("factor_key is null").select("company_id", "source_row_number", "activity")


def global_factors(factors: DataFrame) -> DataFrame:
    """One row per key over all tenants' files: the latest line wins, as an upsert would."""
    latest = Window.partitionBy("factor_key").orderBy(F.desc("company_id"), F.desc("source_row_number"))
    return factors.where("factor_key is not null") \
        .withColumn("_rank", F.row_number().over(latest)).where("_rank = 1") \
        .drop("_rank", "company_id", "source_row_number")
