"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelens.operators.skew import attach
from sitelens.session import materialise


def _nearest(edges: DataFrame, scope: str) -> DataFrame:
    """Smallest neighbour of every ``u``, attached to its edges."""
    smallest = edges.groupBy(scope, "u").agg(
        F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return attach(edges, smallest, [scope, "u"], "n", F.col("v"), merge=True) \
        .withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame, scope: str = "company_id") -> DataFrame:
    """``(scope, a, b)`` links between BIGINT nodes to ``(scope, node, component)``.

    The component is its smallest node. Every round points nodes at a smaller
    neighbour (large star, then small star; Kiveris et al., SoCC 2014) and is
    written to the shared folder, until a round changes nothing. Rounds grow with
    log^2 of the longest chain.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(
            scope, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def fingerprint(df: DataFrame):
        # Commutative, so it does not depend on row order.
        return tuple(df.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64(scope, "u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(canonical(links))
    mark = fingerprint(edges)
    if mark[0]:
        while True:
            both = edges.unionByName(edges.select(
                scope, F.col("v").alias("u"), F.col("u").alias("v")))
            large = _nearest(both, scope).where("v > u").select(
                scope, F.col("v").alias("a"), F.col("m").alias("b"))
            down = _nearest(canonical(large), scope)
            small = down.select(scope, F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                down.select(scope, F.col("u").alias("a"), F.col("m").alias("b")))
            edges = materialise(canonical(small))
            seen = fingerprint(edges)
            if seen == mark:
                break
            mark = seen
    return edges.select(scope, F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(scope, F.col("v").alias("node"),
                                  F.col("v").alias("component")).distinct())
