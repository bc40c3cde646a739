"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest distinct 48-bit hashes of a
text's five-word shingles. Sketches of parts merge into the sketch of the whole,
and give estimates of resemblance, containment and the number of distinct shingles.

Defined cases: a null text counts as empty; an empty text has the empty sketch; a
text of one to four words has one shingle, its whole word sequence. Two empty
sketches have resemblance 1, an empty and a filled one 0. Equal texts have equal
sketches. Ties of doc_id are ordered by text. Input columns other than the two
named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitelens.llm.common import as_id, materialise, partitions

K = 128
WORDS = 5
BITS = 48
BLANKS = " \t\n\x0b\x0c\r"
# Neighbouring ids that travel together to find each document's successor.
SPAN = 128


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Add the sketch of column ``text`` as ``out`` (array<bigint>, ascending)."""
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    h = F.col(f"{out}_w")
    shingles = F.when(F.size(h) == 0, F.array().cast("array<bigint>")) \
        .when(F.size(h) < WORDS, F.array(F.xxhash64(h))) \
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - WORDS),
                               lambda i: F.xxhash64(*[h[i + j] for j in range(WORDS)])))
    return (
        df.withColumn(f"{out}_w", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(f"{out}_s", F.transform(shingles, lambda x: F.shiftrightunsigned(x, 64 - BITS)))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(f"{out}_s")), 1, k))
        .drop(f"{out}_w", f"{out}_s")
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that both have."""
    # Both arrays are named first, as a lambda would compute them again for each element.
    named = F.array(F.struct(merged(a, b, k).alias("all"), F.array_intersect(a, b).alias("both")))
    share = F.transform(named, lambda s: F.when(F.size(s["all"]) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(s["both"], lambda x: x <= F.element_at(s["all"], -1))) / F.size(s["all"])))
    return F.element_at(share, 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k`` shingles, else (k - 1) / the k-th smallest hash as a fraction."""
    return F.when(F.size(a) < k, F.size(a).cast("double")) \
        .otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance * |union| / |a|, at most 1."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key. Each task first keeps the k smallest hashes of a key, so a
    key with a third of all rows sends k rows per task, not its rows."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    smallest = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    found = hashes.withColumn("_n", smallest).where(F.col("_n") <= k) \
        .groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    same = None
    for c in keys:
        same = F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) if same is None else \
            same & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    every = df.select(*keys).distinct()
    return every.alias("e").join(found.alias("f"), same, "left").select(
        *[F.col(f"e.{c}") for c in keys],
        F.coalesce(F.col(f"f.{sketch}"), F.array().cast("array<bigint>")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """Twelve hexadecimal digits a hash, concatenated."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def _following(buckets: DataFrame) -> DataFrame:
    """(b, after): the next larger bucket, after the last one the first.

    The narrow list of buckets is range-partitioned and written, so that partition
    numbers stay true if executors are lost; only one row per partition meets in
    the last window.
    """
    ranged = materialise(
        buckets.repartitionByRange(partitions(buckets), "b").withColumn("part", F.spark_partition_id()))
    edges = ranged.groupBy("part").agg(F.min("b").alias("first"))
    turn = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.withColumn("next_first", F.coalesce(F.lead("first").over(turn), F.first("first").over(whole)))
    inside = F.lead("b").over(Window.partitionBy("part").orderBy("b"))
    return ranged.withColumn("inside", inside).join(F.broadcast(edges), "part") \
        .select("b", F.coalesce("inside", "next_first").alias("after"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): every document and its successor by id.

    Ids that are close travel together in spans of ``SPAN`` ids and find their
    successor in a window; only the last document of a span needs the first one of
    the next span, through a join over spans.
    """
    # Null ids (before all others) share one bucket below every real one.
    bucket = F.coalesce(F.floor(F.col(doc_id) / SPAN).cast("bigint"), F.lit(-(1 << 62)))
    rows = with_sketch(docs.select(as_id(docs, doc_id),
                                   F.coalesce(F.col(text), F.lit("")).alias("text"), bucket.alias("b")),
                       "text", "sketch", k)
    order = Window.partitionBy("b").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.select(
        "*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"),
        F.lag(F.lit(1)).over(order).alias("before"))
    heads = placed.where("before is null").select(
        F.col("b").alias("after"), F.col("text").alias("head_text"), F.col("sketch").alias("head_sketch"))
    after = _following(docs.select(bucket.alias("b")).distinct())
    tails = placed.where("next_sketch is null").join(after, "b").join(heads, "after").select(
        "doc_id", "text", "sketch", F.col("head_text").alias("next_text"), F.col("head_sketch").alias("next_sketch"))
    return placed.where("next_sketch is not null") \
        .select("doc_id", "text", "sketch", "next_text", "next_sketch").unionByName(tails)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(docs, doc_id, text, k).select(
        "*", n.cast("bigint").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                 F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    edited = with_sketch(edited, "edited", "edited_sketch", k)
    a, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"), resemblance(a, x, k).alias("near_next"),
        distinct_shingles(a, k).alias("distinct_estimate"), containment(a, e, k).alias("contained_in_edited"))
