"""Quality classifier: importance resampling with hashed n-gram models.

Two bags of hashed word unigrams and bigrams are counted: one over target
texts (at most ``TARGET_ROWS`` rows labelled as good, those with the smallest hash
of doc_id), one over all raw texts. The log weight of a text is
the sum over its n-grams of log p_target - log p_raw. Rows are then sampled without
replacement in proportion to their weights: each gets log weight + Gumbel noise,
and the k largest keys win (Gumbel top-k). The noise is drawn from a hash of the
row's id and text, so a rerun after a lost executor draws the same.

k is the number of rows times the share of good rows among the labelled ones, a
share counted over all labels. The k-th key is found without ordering all rows:
counts of key intervals are refined until one interval holds few rows.

Raw counts cover all texts. Every task sums its rows into one vector of ``BUCKETS``
counts, so what is gathered grows with tasks, not rows.

Defined cases: a null or empty text has no n-gram and log weight 0; without
labelled good rows, or labelled bad ones, all rows are kept; ties of keys are left to
rows with the same text and id, which stay or go together; rows that
share a doc_id are drawn each on its own.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import claim, hashes, materialise, mix, raw

BUCKETS = 1 << 17
# Bound of the sample of labelled good rows that the target model is counted on.
TARGET_ROWS = 20_000
PARTS = 4096
FEW = 10_000


_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")


def grams(data: bytes) -> np.ndarray:
    """Buckets of a text's lower-cased tokens (words, runs of punctuation) and token pairs."""
    words = _TOKEN.findall(data.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counted(docs: DataFrame, text: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed n-grams of all rows, and of the rows where ``target`` holds.

    Each task sends one vector of at most ``BUCKETS`` sums.
    """
    def run(batches):
        claim("quality")
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, at = raw(batch.column(0))
            whole = data.tobytes()
            good = batch.column(1).to_pylist()
            parts: list[list[np.ndarray]] = [[], []]
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                g = grams(whole[a:b])
                parts[0].append(g)
                if good[i]:
                    parts[1].append(g)
            for k in (0, 1):
                if parts[k]:
                    totals[k] += np.bincount(np.concatenate(parts[k]), minlength=BUCKETS)
        full = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(totals[0][full], pa.int64()),
                                          pa.array(totals[1][full], pa.int64())], ["bucket", "n", "m"])

    sums = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"), target) \
        .mapInArrow(run, "bucket int, n bigint, m bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    out[:, sums.column("bucket").to_numpy()] = [sums.column("n").to_numpy(), sums.column("m").to_numpy()]
    return out[0], out[1]


def log_ratio(target: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket; the target is drawn to the raw model where it has seen little."""
    prior = (everything + 1.0) / (everything.sum() + BUCKETS)
    strength = BUCKETS / 2
    return np.log((target + strength * prior) / (target.sum() + strength)) - np.log(prior)


def _weights(ratio: np.ndarray, whole: bytes, at: np.ndarray, ids: list) -> tuple[list[float], list[float]]:
    """Log weight, and key (log weight plus Gumbel noise), of a batch's texts."""
    import xxhash
    weights, keys = [], []
    for a, b, i in zip(at[:-1].tolist(), at[1:].tolist(), ids):
        data = whole[a:b]
        w = float(ratio[grams(data)].sum())
        u = (xxhash.xxh64_intdigest(data, seed=zlib.crc32(str(i).encode())) + 0.5) / 2.0 ** 64
        weights.append(w)
        keys.append(w - math.log(-math.log(min(u, 1 - 1e-16))))
    return weights, keys


def weighed(docs: DataFrame, ratio: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, log_weight, sample_key) of every row."""
    def run(batches):
        claim("quality")
        for batch in batches:
            data, at = raw(batch.column(1))
            weights, keys = _weights(ratio, data.tobytes(), at, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())],
                ["doc_id", "log_weight", "sample_key"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")) \
        .mapInArrow(run, "doc_id bigint, log_weight double, sample_key double")


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, from interval counts of a written table.

    Each round splits the interval that holds it into ``PARTS`` and counts them, until
    it has at most ``FEW`` rows (read then) or one value.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    rest = k
    inside = keys.select(F.col(column).alias("x"))
    while low < high:
        width = (high - low) / PARTS
        part = F.least(F.floor((F.col("x") - low) / width), F.lit(PARTS - 1)).cast("int") if width > 0 else F.lit(0)
        rows = inside.where(F.col("x").between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")) \
            .orderBy(F.desc("part")).collect()
        for r in rows:
            if r["n"] >= rest:
                break
            rest -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= FEW:
            few = sorted((x[0] for x in inside.where(F.col("x").between(low, high)).collect()), reverse=True)
            return few[rest - 1]
    return low


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """(log ratio per bucket, share of good rows among the labelled ones of ``docs``)."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id") \
        .agg(F.max("quality").alias("quality"))
    labelled = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    labelled = materialise(labelled)
    n, good = labelled.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    if not good or good == n:
        return np.zeros(BUCKETS), 1.0
    chosen = labelled.where(F.col("quality") == 1).select("doc_id") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).toArrow()
    sample = spark.createDataFrame(chosen).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_good"))
    everything, target = counted(docs.join(F.broadcast(sample), docs[doc_id] == F.col("_id"), "left"), text, "_good")
    return log_ratio(target, everything), good / n


def resampled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, log_weight, sample_key, selected) of every row."""
    ratio, share = fit(docs, labels, doc_id, text)
    keys = materialise(weighed(docs, ratio, doc_id, text))
    least = kth_largest(keys, "sample_key", math.ceil(share * keys.count()))
    return keys.withColumn("selected", F.col("sample_key") >= least)


def keep_selected(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected rows of ``docs``, all columns unchanged. Keys are computed again beside the rows."""
    ratio, share = fit(docs, labels, doc_id, text)
    keys = materialise(weighed(docs, ratio, doc_id, text))
    least = kth_largest(keys, "sample_key", math.ceil(share * keys.count()))
    schema = docs.schema
    names = schema.fieldNames()

    def run(batches):
        claim("quality")
        for batch in batches:
            data, at = raw(batch.column(names.index(text)))
            _, got = _weights(ratio, data.tobytes(), at, batch.column(names.index(doc_id)).to_pylist())
            yield batch.filter(pa.array([x >= least for x in got], pa.bool_()))

    return docs.mapInArrow(run, schema)
