"""Exact top-k inner products by a Voronoi kNN join.

Largest inner product becomes nearest neighbour: with M the largest norm of all
candidates, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots cut the space into Voronoi cells:

1. every candidate goes to its nearest pivot's group; a group is summarised by its
   size, its largest distance to the pivot and its k smallest ones;
2. for a query at distance d from pivot j, each of the group's k nearest members is
   at most d + its own distance away, so the k-th smallest of these sums over all
   groups bounds the k-th neighbour;
3. a member of group j is at least d - (largest distance) away, so a query is copied
   only to groups where that does not exceed its bound. Queries are the smaller
   side, and no candidate is copied;
4. groups are dealt out in blocks of at most about ``BLOCK`` members, each solved by one
   matrix product per batch of queries, and the blocks' best k are merged.

Scores are exact integers; bounds carry a margin for rounding. Pivots are a bounded
sample (``PIVOTS`` rows with the smallest hash); every row is in a group, so recall is 1.

Defined cases: vectors that are null or hold a null or non-finite component take no
part; a scaled component or a score that leaves 64 bits ends the query with an error,
as it does in SQL, and drops nothing; shorter vectors are continued with zeros; rows that share the query's id
are not its candidates; a repeated row is a candidate as often as it occurs, but
one query; null ids take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelens.llm.common import materialise

PIVOTS = 64
BLOCK = 8192
SCALE = 256
LIMIT = 2.0 ** 63


def integer_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): floor(256 * component) of every vector that takes part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) * SCALE < LIMIT, F.floor(c.cast("double") * SCALE))
                    .otherwise(F.raise_error(F.lit("a vector's component leaves 64 bits")).cast("bigint"))).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles, zeros to the right."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Space:
    """Pivots in the lifted space, and distances to them."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.pivots, self.norm2 = pivots, norm2
        self.lift = np.sqrt(np.maximum(norm2 - (pivots ** 2).sum(axis=1), 0))
        self.square = (pivots ** 2).sum(axis=1) + self.lift ** 2

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = (x ** 2).sum(axis=1)
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - own, 0))
        d2 = (own + lift ** 2)[:, None] + self.square[None, :] - 2 * (x @ self.pivots.T + np.outer(lift, self.lift))
        return np.sqrt(np.maximum(d2, 0))


def top_products(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                 pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, all if fewer."""
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = integer_vectors(df, vec_id, vector)
    total = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    norm2, width, n = rows.agg(F.max(total), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], schema)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).toArrow()
    space = Space(np.unique(_matrix(chosen.column("x"), width), axis=0), float(norm2))

    def to_groups(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = space.distances(x, query=False)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, pa.int32()),
                 pa.array(d[np.arange(len(x)), near], pa.float64())], ["vec_id", "x", "cell", "distance"])

    members = rows.mapInArrow(to_groups, "vec_id bigint, x array<bigint>, cell int, distance double")
    members = materialise(members)
    # Summaries: at most k + 1 rows a pivot (one more, as the query itself is no candidate).
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).toArrow()
    nearest = members.select("cell", "distance").withColumn(
        "at", F.row_number().over(Window.partitionBy("cell").orderBy("distance"))).where(F.col("at") <= k + 1).toArrow()
    cells = len(space.pivots)
    far, count = np.full(cells, -1.0), np.zeros(cells, np.int64)
    far[sizes.column("cell").to_numpy()] = sizes.column("far").to_numpy()
    count[sizes.column("cell").to_numpy()] = sizes.column("n").to_numpy()
    near_cell, near_distance = nearest.column("cell").to_numpy(), nearest.column("distance").to_numpy()
    blocks = np.maximum(1, -(-count // block))
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    filled = np.flatnonzero(count)

    queries = rows.where(is_query).dropDuplicates(["vec_id", "x"])
    # How often each query id occurs among the candidates; its own rows do not bound anything.
    repeats = rows.where(is_query).groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))

    def to_copies(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            own = batch.column(2).to_numpy()
            d = space.distances(x, query=True)
            margin = 1e-6 * (1 + np.sqrt(space.norm2) + d.max(initial=0))
            sums = np.sort(d[:, near_cell] + near_distance[None, :], axis=1)
            kth = k - 1 + own  # position of the bound when the query's own rows came first
            bound = np.where(kth < sums.shape[1], sums[np.arange(len(x)), np.minimum(kth, sums.shape[1] - 1)], np.inf)
            needed = d[:, filled] - far[filled][None, :] <= bound[:, None] + margin
            q, cell = np.nonzero(needed)
            cell = filled[cell]
            copies = blocks[cell]
            q = np.repeat(q, copies)
            at = np.repeat(first_block[cell], copies) + np.arange(copies.sum()) - np.repeat(
                np.cumsum(copies) - copies, copies)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), batch.column(0).take(take), batch.column(1).take(take)],
                ["block", "vec_id", "x"])

    copies = queries.join(repeats, "vec_id").select("vec_id", "x", "own") \
        .mapInArrow(to_copies, "block bigint, vec_id bigint, x array<bigint>")
    starts = F.array(*[F.lit(int(b)) for b in first_block[:-1]])
    counts = F.array(*[F.lit(int(b)) for b in blocks])
    dealt = members.select(
        (starts[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "x"), counts[F.col("cell")])).cast("bigint").alias("block"),
        F.lit(0).alias("kind"), "vec_id", "x")
    # Within a block its members come first, then its queries as a stream of batches.
    both = dealt.unionByName(copies.withColumn("kind", F.lit(1)).select("block", "kind", "vec_id", "x")) \
        .repartition("block").sortWithinPartitions("block", "kind")

    def solve(batches):
        held_block, ids, parts = None, [], []
        matrix, members_ids = None, None
        for batch in batches:
            block_, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block_) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block_)]):
                if a == b:
                    continue
                if block_[a] != held_block:
                    held_block, ids, parts, matrix = block_[a], [], [], None
                part_ids = batch.column(2).slice(a, b - a).to_numpy()
                x = _matrix(batch.column(3).slice(a, b - a), width)
                if kind[a] == 0:
                    ids.append(part_ids)
                    parts.append(x)
                    continue
                if not parts:
                    continue
                if matrix is None:
                    members_ids, matrix = np.concatenate(ids), np.concatenate(parts)
                    order = np.argsort(members_ids, kind="stable")
                    members_ids, matrix = members_ids[order], matrix[order]
                for at in range(0, len(x), 512):
                    yield _best(x[at:at + 512], part_ids[at:at + 512], matrix, members_ids, k)

    local = both.mapInArrow(solve, "query_id bigint, q array<bigint>, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _best(x: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best members of a block for each query, with ties to the smaller id (``ids`` ascend)."""
    # Doubles hold sums below 2**53 exactly; beyond that, products are taken as integers.
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, x.shape[1])
    if largest < 2 ** 53:
        scores = (x @ matrix.T).astype(np.int64)
    else:
        # Sums wrap, so they are right wherever the result itself fits.
        scores = x.astype(np.int64) @ matrix.T.astype(np.int64)
        near = x @ matrix.T
        unsure = np.abs(near) + 1e-12 * (np.abs(x) @ np.abs(matrix).T) >= 2.0 ** 62
        for i, j in zip(*np.nonzero(unsure & (query_ids[:, None] != ids[None, :]))):
            if abs(sum(int(a) * int(b) for a, b in zip(x[i], matrix[j]))) >= 2 ** 63:
                raise OverflowError(f"the score of {query_ids[i]} and {ids[j]} leaves 64 bits")
    lowest = np.iinfo(np.int64).min
    scores[query_ids[:, None] == ids[None, :]] = lowest
    out_q, out_m = [], []
    for i, row in enumerate(scores):
        if len(row) > k:
            kth = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > kth)
            tied = np.flatnonzero(row == kth)[:k - len(above)]
            pick = np.concatenate([above, tied])
        else:
            pick = np.arange(len(row))
        pick = pick[row[pick] != lowest]
        out_q.append(np.full(len(pick), i))
        out_m.append(pick)
    q, m = np.concatenate(out_q).astype(np.int64), np.concatenate(out_m).astype(np.int64)
    vectors = pa.array(list(x.astype(np.int64)), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[q], pa.int64()), vectors.take(pa.array(q)), pa.array(ids[m], pa.int64()),
         pa.array(scores[q, m], pa.int64())], ["query_id", "q", "vec_id", "score"])
