"""Toxicity by compression distance: two zstandard dictionaries and window lengths.

zstandard's dictionary builder trains one dictionary on toxic labelled texts and one
on ordinary ones. Its samples are the texts' words, each cut to the stretch (the word or
one of its beginnings) that tells the classes apart best; what does so by chance is no
sample: a stretch needs ``LEAST_EVIDENCE`` nats of log-likelihood ratio between the
shares of texts that have it. Such stretches are counted by Spark over whole texts. Of a
trained dictionary whole stretches are kept, in its order; both dictionaries end in the
same frequent words of the sample, so that ordinary prose compresses alike under both.

A text is cut into windows of whole words. Each is compressed with either dictionary,
and the bytes the toxic one saves over the ordinary one are the window's distance. Words
are set off by two blanks and begin in capitals, so the middle of a word does not match
the beginning of another. Five figures of a text (its largest saving, the mean of the
three largest, of the largest twentieth, and of all windows, and the logarithm of the
number of windows) go through a logistic calibration fitted on labelled texts; its
output is the score, and the threshold applies to it.

Bounds of training, and of nothing else: ``TOXIC_ROWS`` toxic and ``PLAIN_ROWS`` other
labelled documents (smallest hash of doc_id), whole texts. ``DICTIONARY`` and
``COMMON_BYTES`` are the sizes of a dictionary's two parts. Calibration is cross-fitted:
either half is measured, whole texts, with the other's dictionaries. Scoring covers
every byte of every text; labels, lang, source and doc_id are not inputs of a score.

Defined cases: a null or empty text has the calibration's value for no savings; if
the sample lacks toxic or ordinary texts every score is 0. Samples too small for
zstandard's builder are the dictionary themselves, the strongest stretches last. Rows that
share a doc_id are scored each on its own; in training, a doc_id with several labels is
toxic if one of them says so, and equal texts of a class count once. Null ids or labels
are not learnt from. Extra columns of the input are ignored by ``scored``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sitelens.llm.common import claim, forgetting, materialise

TOXIC_ROWS = 1000
PLAIN_ROWS = 2000
WINDOW = 48  # bytes
LEVEL = 7
MIN_MATCH = 6
DICTIONARY = 2048  # bytes that zstandard trains
COVER_D, COVER_K = 6, 32  # lengths that its builder works with
COMMON_BYTES = 6000
LEAST_EVIDENCE = 18.0  # log-likelihood ratio of a stretch, in nats
BEGINNINGS = range(4, 12)  # bytes of a word
LONGEST = 16  # bytes of a word that counts as a whole
GAP = b"  "
THRESHOLD = 0.3
FIGURES = 5

_BLANKED = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def marked_words(text: str) -> list[bytes]:
    """Lower-cased words, the first three bytes in capitals; ASCII punctuation parts them."""
    return [w[:3].upper() + w[3:] for w in text.lower().encode("utf-8", "replace").translate(_BLANKED).split()]


def windows(text: str) -> list[bytes]:
    """Runs of whole words of at most ``WINDOW`` bytes, longer words in parts; they cover every word."""
    out, current = [], GAP
    for word in marked_words(text):
        if len(current) + len(word) + len(GAP) > WINDOW and current != GAP:
            out.append(current)
            current = GAP
        rest = len(word) // WINDOW * WINDOW if len(word) > WINDOW else 0
        out += [GAP + word[i:i + WINDOW] for i in range(0, rest, WINDOW)]
        if rest < len(word):
            current += word[rest:] + GAP
    if current != GAP:
        out.append(current)
    return out


def stretches(word: bytes) -> list[bytes]:
    """Beginnings of a word, and the word with a blank behind it."""
    out = [word[:k] for k in BEGINNINGS if k < len(word)]
    if len(word) <= LONGEST:
        out.append(word + b" ")
    return out


@dataclass
class Model:
    toxic: bytes = b""
    plain: bytes = b""
    centre: list[float] = field(default_factory=lambda: [0.0] * FIGURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FIGURES)
    weights: list[float] = field(default_factory=lambda: [-math.inf] + [0.0] * FIGURES)


def strongest(word: bytes, typical: dict[bytes, float]) -> bytes | None:
    """The stretch of a word with most evidence, the longest of equals."""
    found = [s for s in stretches(word) if s in typical]
    return max(found, key=lambda s: (typical[s], len(s), s)) if found else None


def _spelt(stretch: bytes) -> bytes:
    """A stretch as windows hold it."""
    return GAP + (stretch[:-1] + GAP if stretch.endswith(b" ") else stretch)


def train_dictionary(samples: list[list[bytes]], typical: dict[bytes, float]) -> bytes:
    """What zstandard's builder picks from the texts' stretches, whole ones, each once."""
    import zstandard
    # The builder passes over samples of less than eight bytes.
    texts = [b"".join(map(_spelt, s)) + b"\0" * 8 for s in samples if s]
    try:
        built = zstandard.train_dictionary(DICTIONARY, texts, d=COVER_D, k=COVER_K).as_bytes()
    except zstandard.ZstdError:
        last = sorted(typical, key=lambda s: (typical[s], s))
        return b"\0".join(map(_spelt, last))[-DICTIONARY:] + b"\0"
    # The builder cuts its samples anywhere, and puts a table of its own in front.
    found = {}
    for s in sorted({s for text in samples for s in text}):
        spelt = _spelt(s) if _spelt(s) in built else GAP + s.rstrip()
        if spelt in built:
            found[spelt] = built.rindex(spelt)
    return b"\0".join(sorted(found, key=lambda s: (found[s], s))) + b"\0"


_compressors: dict[bytes, tuple] = {}
forgetting(_compressors.clear)


def _compressor(content: bytes):
    import zstandard
    return zstandard.ZstdCompressor(
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), min_match=MIN_MATCH, write_checksum=False, write_content_size=False,
            write_dict_id=False),
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress


def _pair(model: Model):
    key = hashlib.sha256(model.toxic + b"\0" + model.plain).digest()
    if key not in _compressors:
        if len(_compressors) == 4:
            _compressors.clear()
        _compressors[key] = _compressor(model.toxic), _compressor(model.plain)
    return _compressors[key]


def distances(model: Model, text: str) -> tuple[float, ...]:
    """Largest saving of a window, means of the three largest, the largest twentieth and all,
    and the logarithm of the number of windows."""
    found = windows(text) if model.toxic else []
    if not found:
        return (0.0,) * FIGURES
    toxic, plain = _pair(model)
    saved = sorted(len(plain(w)) - len(toxic(w)) for w in found)
    top = saved[-max(1, len(saved) // 20):]
    return (float(saved[-1]), sum(saved[-3:]) / len(saved[-3:]), sum(top) / len(top), sum(saved) / len(saved),
            math.log(len(saved)))


def calibrate(rows: np.ndarray, labels: np.ndarray, model: Model) -> Model:
    """Fit centre, scale and ridge-regularised logistic weights by Newton steps."""
    if not len(rows) or labels.min() == labels.max():
        return Model()
    model.centre = rows.mean(axis=0).tolist()
    model.scale = (rows.std(axis=0) + 1e-6).tolist()
    x = np.column_stack([np.ones(len(rows)), (rows - model.centre) / model.scale])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.1] * FIGURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()
    return model


def score(model: Model, text: str) -> float:
    z = model.weights[0]
    for w, x, c, s in zip(model.weights[1:], distances(model, text), model.centre, model.scale):
        z += w * (x - c) / s
    return 0.0 if z < -60 else 1.0 / (1.0 + math.exp(-min(z, 60.0)))


def _sample(labels: DataFrame, train: Column | None, toxic_rows: int, plain_rows: int) -> DataFrame:
    """(doc_id, toxic): at most the two bounds of rows, so it may be broadcast."""
    known = labels.where("doc_id is not null and toxic is not null")
    if train is not None:
        known = known.where(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == 1).orderBy(*order).limit(toxic_rows),
             known.where(F.col("toxic") != 1).orderBy(*order).limit(plain_rows)]
    return parts[0].unionByName(parts[1])


def _counted(picked: DataFrame) -> DataFrame:
    """(stretch, t0, t1, p0, p1): toxic and plain texts of either half that have it."""
    names = ["t0", "t1", "p0", "p1"]

    def run(batches):
        claim("toxicity")
        for batch in batches:
            counts = [Counter() for _ in names]
            for toxic, half, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts[(0 if toxic == 1 else 2) + half].update({s for w in set(marked_words(text)) for s in stretches(w)})
            keys = list(set().union(*counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary())] + [pa.array([c[k] for k in keys], pa.int64()) for c in counts],
                ["stretch", *names])

    return picked.select("toxic", "half", "text").mapInArrow(run, "stretch binary, t0 bigint, t1 bigint, p0 bigint, p1 bigint") \
        .groupBy("stretch").agg(*[F.sum(c).alias(c) for c in names])


def _typical(counted: DataFrame, toxic: list[int], plain: list[int]) -> list[tuple[dict, dict]]:
    """For the first half, the second and both: evidence of toxic and of ordinary stretches."""
    def nats(own, n, other, m):
        p, q = (own + 0.5) / F.lit(n + 1.0), (other + 0.5) / F.lit(m + 1.0)
        return F.when(p > 3 * q, own * F.log(p / q) + (n - own) * F.log((1 - p) / (1 - q))).otherwise(0.0)

    t, p = [F.col("t0"), F.col("t1")], [F.col("p0"), F.col("p1")]
    subsets = [(t[0], toxic[0], p[0], plain[0]), (t[1], toxic[1], p[1], plain[1]),
               (t[0] + t[1], sum(toxic), p[0] + p[1], sum(plain))]
    measured = [nats(*s) for s in subsets] + [nats(s[2], s[3], s[0], s[1]) for s in subsets]
    found = counted.select("stretch", *[m.alias(f"e{i}") for i, m in enumerate(measured)]) \
        .where(" or ".join(f"e{i} >= {LEAST_EVIDENCE}" for i in range(6)))
    rows = sorted((bytes(r[0]), *r[1:]) for r in found.collect())
    return [tuple({r[0]: r[1 + i + k] for r in rows if r[1 + i + k] >= LEAST_EVIDENCE} for k in (0, 3))
            for i in range(3)]


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id",
        text: str = "text", toxic_rows: int = TOXIC_ROWS, plain_rows: int = PLAIN_ROWS) -> Model:
    """Model learnt from the labelled rows of ``docs`` for which ``train`` (over labels) holds."""
    spark = docs.sparkSession
    chosen = [tuple(r) for r in _sample(labels, train, toxic_rows, plain_rows).collect()]
    if not chosen:
        return Model()
    # Copies of a text would pass for evidence, so each counts once, in one half.
    picked = materialise(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, toxic int")), "doc_id")
        .select("toxic", F.pmod(F.xxhash64(F.lit("half"), F.col("text")), F.lit(2)).cast("int").alias("half"), "text")
        .distinct())
    sizes = {(r[0] == 1, r[1]): r[2] for r in picked.groupBy("toxic", "half").count().collect()}
    toxic, plain = ([sizes.get((k, h), 0) for h in (0, 1)] for k in (True, False))
    if not sum(toxic) or not sum(plain):
        return Model()
    counted = materialise(_counted(picked))
    typical = _typical(counted, toxic, plain)
    # Every word costs three bytes or more of the shared part.
    frequent = [bytes(r[0]) for r in counted.where("endswith(stretch, X'20')").orderBy(
        F.expr("-(t0 + t1 + p0 + p1)"), "stretch").limit(COMMON_BYTES // 3).collect()]

    def sampled(batches):
        claim("toxicity")
        for batch in batches:
            found = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = set(marked_words(text))
                found.append([sorted({s for w in words if (s := strongest(w, sides[0 if toxic == 1 else 1]))})
                              for sides in typical])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.list_(pa.binary())))],
                ["toxic", "half", "found"])

    samples = sorted((r[0], r[1], [[bytes(s) for s in part] for part in r[2]]) for r in picked.mapInArrow(
        sampled, "toxic int, half int, found array<array<binary>>").toLocalIterator())

    def trained(subset: int) -> Model:
        """From the documents of the first half (0), the second (1) or both (2)."""
        shared, size = [], 0
        for word in frequent:
            # What tells the classes apart must not be shared.
            if any(s in side for side in typical[subset] for s in stretches(word[:-1])):
                continue
            size += len(word)
            if size > COMMON_BYTES:
                break
            shared.append(_spelt(word))
        common = b"".join(reversed(shared))
        # The shared words lie last, so a match with them costs the same under both dictionaries.
        return Model(*[train_dictionary([found[subset] for toxic, half, found in samples
                                         if (toxic == 1) == (k == 0) and subset in (half, 2)],
                                        typical[subset][k]) + common for k in (0, 1)])

    # Each half is measured with the other half's dictionaries.
    across = [trained(1), trained(0)]

    def measured(batches):
        claim("toxicity")
        for batch in batches:
            rows = [list(distances(across[h], t)) for h, t in
                    zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             ["toxic", "figures"])

    figures = sorted(tuple(r) for r in picked.mapInArrow(measured, "toxic int, figures array<double>").collect())
    return calibrate(np.array([r[1] for r in figures]).reshape(-1, FIGURES),
                     np.array([float(r[0] == 1) for r in figures]), trained(2))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    def run(batches):
        claim("toxicity")
        for batch in batches:
            got = [score(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id bigint, score double") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns unchanged."""
    schema = docs.schema

    def run(batches):
        claim("toxicity")
        for batch in batches:
            got = [score(model, t or "") < threshold for t in batch.column(schema.fieldNames().index(text)).to_pylist()]
            yield batch.filter(pa.array(got, pa.bool_()))

    return docs.mapInArrow(run, schema)
