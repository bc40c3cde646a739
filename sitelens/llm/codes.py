"""Vector codes from per-part codebooks, assigned by slice-and-intersect bitmasks.

Vectors become integers, are cut into equal parts, and every part is replaced by the
number of its codebook's nearest entry. The nearest entry is found without comparing
the part with all entries:

1. for every dimension, the entries' coordinates are sorted and a prefix mask is kept
   for every place: the uint64 words whose bits are the entries before that place;
2. an initial radius is the distance to an entry next to the part in the two widest
   dimensions, so the nearest entry lies in the box of that half side;
3. two binary searches a dimension give a range of the sorted coordinates, and the
   difference of its two prefix masks is the set of entries inside the slice;
4. the masks of all dimensions ANDed are the entries in the box. They include every
   entry that is as near as the nearest one; only these are compared exactly.

Codebooks are learnt in rounds over all vectors: each task sends one row per entry and
component (sum and count), Spark adds them, and the new entries (``parts`` * ``entries``
vectors, whatever the corpus size) come back to the driver. Vectors are staged once as
integers; every round reads that table, so a lost executor costs its own tasks only.

Defined cases: vectors that are null or hold null or non-finite components take no part;
the width is that of the longest vector, rounded up to whole parts, and shorter vectors
are continued with zeros; rows with a null id take part and come last where ids are
ordered, equal ids are ordered by vector, and repeated rows count as often as they occur;
fewer vectors than entries give a smaller codebook; a component or an error that leaves
64 bits ends the query with an error. Distances are exact whatever the components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import materialise
from sitelens.operators.skew import attach

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 2.0 ** 63
RESULT = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"


class Slices:
    """One part's codebook, prepared for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # int64, or Python integers where those could overflow
        k, width = entries.shape
        words = -(-k // 64)
        self.sorted, self.order, self.masks = [], [], []
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            masks = np.zeros((k + 1, words), np.uint64)
            for place, e in enumerate(order):
                masks[place + 1] = masks[place]
                masks[place + 1, e // 64] |= np.uint64(1) << np.uint64(e % 64)
            self.sorted.append(entries[order, d])
            self.order.append(order)
            self.masks.append(masks)
        spread = [int(s[-1]) - int(s[0]) for s in self.sorted]
        self.widest = sorted(range(width), key=lambda d: -spread[d])[:2]

    def _distance(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Squared distances between rows and entries, row by row."""
        return ((x - self.entries[e]) ** 2).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A distance within which every row has an entry: the box of this half side holds the nearest."""
        best = self._distance(x, np.zeros(len(x), np.int64))
        for d in self.widest:
            place = np.searchsorted(self.sorted[d], x[:, d])
            for near in (place.clip(0, len(self.entries) - 1), (place - 1).clip(0)):
                best = np.minimum(best, self._distance(x, self.order[d][near]))
        if best.dtype == object:
            return np.array([math.isqrt(b) for b in best], object)
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1  # at least the root

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """uint64 words a row: the entries whose every coordinate is within ``radius``."""
        inside = np.broadcast_to(self.masks[0][-1] if self.masks else np.uint64(0),
                                 (len(x), -(-len(self.entries) // 64))).copy()
        for d, (places, masks) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(places, x[:, d] - radius, "left")
            high = np.searchsorted(places, x[:, d] + radius, "right")
            inside &= masks[high] ^ masks[low]
        return inside

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of every row, ties to the lower number, and its squared distance."""
        at = np.zeros(len(x), np.int64)
        if not x.shape[1]:
            return at, np.zeros(len(x), np.int64)
        inside = self.candidates(x, self.radius(x))
        best = np.full(len(x), -1, x.dtype)
        for e in range(len(self.entries)):  # ascending, so an equal distance never replaces an entry
            rows = np.flatnonzero(inside[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            distance = ((x[rows] - self.entries[e]) ** 2).sum(axis=1)
            nearer = (best[rows] < 0) | (distance < best[rows])
            rows = rows[nearer]
            at[rows], best[rows] = e, distance[nearer]
        return at, best


def _exact(x: np.ndarray, books: np.ndarray | None = None) -> np.ndarray:
    """``x`` as it is, or as Python integers where a squared distance could leave 64 bits."""
    largest = max([abs(int(v)) for a in (x, books) if a is not None and a.size for v in (a.min(), a.max())], default=0)
    return x if x.shape[-1] * (2 * largest) ** 2 < 2 ** 62 else x.astype(object)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as integers, zeros to the right."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances, one column a part. ``books``: part, entry, component."""
    parts, _, width = books.shape
    at, distance = [], []
    x = _exact(x, books)
    books = books if x.dtype != object else books.astype(object)
    for p in range(parts):
        a, d = Slices(books[p]).nearest(x[:, p * width:(p + 1) * width])
        at.append(a)
        distance.append(d)
    return np.stack(at, axis=1), np.stack(distance, axis=1)


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): floor(scale * component) of every vector that takes part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) * scale < LIMIT, F.floor(c.cast("double") * scale))
                         .otherwise(F.raise_error(F.lit("a vector's component leaves 64 bits")).cast("bigint")))
    return df.where(F.col(vector).isNotNull() & finite) \
        .select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), scaled.alias("x"))


def learnt(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds over ``rows`` (see ``integer_rows``)."""
    part_width = width // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    start = _matrix(first.column("x").combine_chunks(), width)
    books = np.stack([start[:, p * part_width:(p + 1) * part_width] for p in range(parts)])
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts nearest to it."""
    parts, entries, part_width = books.shape
    if not part_width:
        return books

    def add(batches):
        sums, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * part_width)
            at, _ = assigned(x, books)
            wide = x if np.abs(x.astype(float)).max(initial=0) * len(x) < 2 ** 62 else x.astype(object)
            for p in range(parts):
                counts[p] += np.bincount(at[:, p], minlength=entries)
                for e in np.unique(at[:, p]):
                    sums[p, e] += wide[at[:, p] == e, p * part_width:(p + 1) * part_width].sum(axis=0).astype(object)
        used = np.argwhere(counts > 0).repeat(part_width, axis=0)
        place = np.tile(np.arange(part_width), int((counts > 0).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(place, pa.int32()),
             pa.array([str(v) for v in sums[used[:, 0], used[:, 1], place]], pa.string()),
             pa.array(counts[used[:, 0], used[:, 1]], pa.int64())], ["part", "entry", "place", "total", "n"])

    totals = rows.select("x").mapInArrow(add, "part int, entry int, place int, total string, n bigint") \
        .groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for r in totals.toArrow().to_pylist():  # one row per component of the codebooks
        moved[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row; ``code`` has two hex digits a part."""
    width = books.shape[0] * books.shape[2]

    def encode(batches):
        for batch in batches:
            at, distance = assigned(_matrix(batch.column(2), width), books)
            error = distance.astype(object).sum(axis=1)
            if len(error) and max(error) >= 2 ** 63:
                raise OverflowError("an error leaves 64 bits")
            text = at.astype(np.uint8).tobytes().hex()
            step = 2 * at.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                 pa.array(error.astype(np.int64), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(encode, "vec_id bigint, label string, code string, error bigint")


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of all vectors with their error, their label's summed error and the codebooks' digest."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    rows = materialise(integer_rows(df, vec_id, vector, label, scale))
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    books = learnt(rows, -(-longest // parts) * parts, parts, entries, rounds)
    # A null label is a label of its own; labels with very many rows are spread by ``attach``.
    codes = materialise(encoded(rows, books).withColumns(
        {"bare": F.col("label").isNull(), "label": F.coalesce("label", F.lit(""))}))
    totals = codes.groupBy("label", "bare").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return attach(codes, totals, ["label", "bare"], "rows", F.col("vec_id")) \
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
