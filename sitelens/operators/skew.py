"""Joins, numbering and medians that stay distributed when one key is huge.

One tenant, meter, invoice number or text may hold a third of all rows. Nothing
here sends such a group to a single task: groups are first aggregated map-side,
and the rows of a hot group are spread by a deterministic slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelens.session import materialise

# A key with more rows than this is hot. There are fewer than rows / HOT_ROWS of
# them, which is what bounds the broadcast in ``attach``.
HOT_ROWS = 1_000_000
SLOTS = 256


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], size: str,
           spread: Column, hot_rows: int = HOT_ROWS, merge: bool = False) -> DataFrame:
    """Left-join one ``stats`` row per key onto ``rows``.

    ``stats`` is an aggregate with unique non-null ``keys`` and ``size``, the
    number of ``rows`` per key. Rows of a key above ``hot_rows`` travel under one of
    SLOTS slots, and its stats row is copied to every slot. Only the hot keys
    themselves are broadcast, fewer than rows / ``hot_rows``, never their values.
    Both uses of the aggregate are whole, so Spark computes it once.

    ``merge`` rules a broadcast of either side out. Spark guesses the size of exploded rows
    and of rows read back from compressed files far too low, and a broadcast passes the driver.
    """
    values = [c for c in stats.columns if c not in keys]
    packed = stats.select(*keys, F.struct(*values).alias("_v"), F.col(size).alias("_n"))
    hot = packed.where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    slots = F.when(F.col("_n") > hot_rows, F.sequence(F.lit(1), F.lit(SLOTS))).otherwise(F.array(F.lit(0)))
    dealt = packed.select(*keys, "_v", F.explode(slots).alias("_slot"))
    dealt = dealt.hint("merge") if merge else dealt
    slot = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(SLOTS)).cast("int")).otherwise(F.lit(0))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_slot", slot).join(dealt, [*keys, "_slot"], "left")
    return joined.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


def number_within(rows: DataFrame, keys: list[str], line: str, out: str,
                  width: int = 65_536) -> DataFrame:
    """1-based position of each row in its key by an integer unique within the key.

    Rows are numbered inside ``(key, line div width)`` and shifted by the count of
    the earlier blocks, so no task sorts more than ``width`` rows of one key.
    """
    block = F.floor(F.col(line) / width).cast("bigint")
    rows = rows.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(line)
    return (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_block", "_in", "_before")
    )


def number_in_order(rows: DataFrame, key: str, order: list[str], out: str,
                    partitions: int | None = None) -> DataFrame:
    """1-based position of each row in its key by any unique ordering columns.

    A range exchange on ``(key, *order)`` splits a hot key over many partitions.
    The partition number is written down with the rows, so the offsets counted
    afterwards stay true even if executors are lost.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(
        rows.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    return (
        ranged.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [key, "_part"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_part", "_in", "_before")
    )


_LOW_BITS = 24


def exact_median(rows: DataFrame, keys: list[str], value: str, scale: int,
                 out: str = "median_value") -> DataFrame:
    """Exact median per key over row-level DECIMAL values, as DOUBLE.

    ``percentile`` keeps every distinct value of a group in one buffer. Here the
    values are counted, the 2**24-wide bucket holding the middle ranks is found
    from bucket counts, and only that bucket is ordered. A window sees at most
    2**24 buckets of a key, then at most 2**24 values of a bucket.
    """
    ticks = (F.col(value).cast("decimal(38,6)") * F.lit(10 ** scale)).cast("bigint")
    counted = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, ticks.alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.shiftright("_t", _LOW_BITS))
    )
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    buckets = (
        counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(upto))
        .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
    )
    low = F.floor((F.col("_n") + 1) / 2)
    high = F.floor(F.col("_n") / 2) + 1
    middle = buckets.where((F.col("_upto") - F.col("_bc") < high) & (F.col("_upto") >= low)) \
        .select(*keys, "_b", "_n", (F.col("_upto") - F.col("_bc")).alias("_base"))
    within = Window.partitionBy(*keys, "_b").orderBy("_t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    picked = (
        counted.join(middle, [*keys, "_b"])
        .withColumn("_upto", F.col("_base") + F.sum("_c").over(within))
        .where((F.col("_upto") - F.col("_c") < high) & (F.col("_upto") >= low))
    )
    return picked.groupBy(*keys).agg(
        ((F.min("_t") + F.max("_t")) / F.lit(2.0 * 10 ** scale)).alias(out))
