"""Robust statistics over short bounded series (months of one tenant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Iglewicz-Hoaglin constant and cut-off, least relative gap.
Z_CONSTANT = 0.6745
Z_THRESHOLD = 3.5
MIN_RELATIVE_DEVIATION = 0.2


def median(value: Column) -> Column:
    """Exact median, mean of the middle two; 0 for an empty group."""
    return F.coalesce(F.percentile(value, F.lit(0.5)), F.lit(0.0))


def robust_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``median_value``, ``mad``, ``modified_z``, ``is_outlier`` to a series per key.

    The windows hold one group each: meant for series bounded by the calendar
    (monthly figures), not for row-level facts (see ``operators.skew.exact_median``).
    """
    group = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    centred = (
        df.withColumn("median_value", F.percentile(x, F.lit(0.5)).over(group))
        .withColumn("mad", F.percentile(F.abs(x - F.col("median_value")), F.lit(0.5)).over(group))
    )
    med, mad = F.col("median_value"), F.col("mad")
    z = F.when(mad == 0, F.lit(0.0)).otherwise(F.lit(Z_CONSTANT) * (x - med) / mad)
    far = F.abs(x - med) / med >= MIN_RELATIVE_DEVIATION
    return (
        centred.withColumn("modified_z", z)
        .withColumn("is_outlier", F.when(med == 0, F.lit(False)).otherwise(
            (F.abs(F.col("modified_z")) > Z_THRESHOLD) & far))
    )
