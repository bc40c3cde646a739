"""What the training-data operators share: inputs, shipped code, arrow blocks."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sitelens.session import materialise, shared_root  # noqa: F401  (used by the operators)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers import the functions below by name. The driver may have found the
    package through ``sys.path`` alone, so Spark's own file server hands it out.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    from pyspark import SparkFiles
    path = os.path.join(SparkFiles.getRootDirectory(), "sitelens_llm_code.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_id(df: DataFrame, column: str) -> Column:
    """``column`` as a bigint ``doc_id``. Left untouched where it is one already: an alias
    of a column by its own name would keep Spark from reusing an equal exchange."""
    if column == "doc_id" and isinstance(df.schema[column].dataType, T.LongType):
        return F.col(column)
    return F.col(column).cast("bigint").alias("doc_id")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus`` (a null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an arrow string or binary column, without a Python object per row.

    Nulls have length 0. Offsets start at 0 and have one entry more than rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h



# Entries of one generation of a memo.
REMEMBERED = 400_000


class Remembered(dict):
    """A memo of two generations, each of at most ``REMEMBERED`` entries; what is used stays."""

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def _word_hash(word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word)


# Word to unsigned 64-bit hash, per worker.
hashes = Remembered(_word_hash)

_holders: list = [hashes.forget]
_owner = ""


def forgetting(forget) -> None:
    """Register how a module's memory of a worker is given up."""
    _holders.append(forget)


def claim(owner: str) -> None:
    """Called by an operator's functions in a worker: what others remember there is given up.

    Workers are reused from stage to stage. A memo serves the operator that is at work, and
    its memory goes back to the system when another operator's first task arrives.
    """
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for forget in _holders:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
