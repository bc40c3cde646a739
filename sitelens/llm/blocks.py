"""Documents in blocks of bounded size, and corpus-wide counts of their keys.

Several operators need, for each 64-bit key of a text (an anchor, a shingle, an
n-gram), a figure over the whole corpus. A row per key would be far more than the
text itself, so keys travel as sorted arrays:

* documents are dealt into blocks of about ``BLOCK_BYTES`` of text;
* a block sends each of its distinct keys once, split by bucket, as 32 low bits and
  a count, so that a key in a third of all texts arrives once per block, not per text;
* a bucket, about ``BUCKET_KEYS`` keys, adds the counts and sends each block the sums
  of its own keys, in the order in which the block sent them.

Keys of one bucket that agree in the 32 bits are counted as one, unless whole keys
are sent (see ``send``). The number of buckets grows with the corpus, so this stays as rare at any size: about one key in
2**32 / BUCKET_KEYS.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import as_id

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 1 << 20


def corpus_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def blocked(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", *more) -> DataFrame:
    """(block, doc_id, text as bytes, *more). ``size`` is the corpus size in bytes."""
    n = max(1, -(-size // BLOCK_BYTES))
    return docs.select(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).alias("block"),
                       as_id(docs, doc_id),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), *more)


def buckets(size: int) -> int:
    return max(1, -(-size // BUCKET_BYTES))


def places(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and low bits of 64-bit keys as one sortable number."""
    return ((keys >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def send(block: int, at: np.ndarray, counts: np.ndarray, first_bucket: int = 0,
         keys: np.ndarray | None = None) -> pa.Table:
    """Rows (bucket, block, keys, counts) of a block's distinct places, ascending.

    ``keys``, in the same order, replaces the low bits where no two keys may be
    taken for one (eight bytes each then).
    """
    bucket = (at >> np.uint64(32)).astype(np.int64) + first_bucket
    low = at.astype("<u4") if keys is None else keys.astype("<u8")
    counts = counts.astype("<u4" if counts.max(initial=0) > 255 else "u1")
    found, start = np.unique(bucket, return_index=True)
    cuts = [*start.tolist(), len(bucket)]
    return pa.table([pa.array(found, pa.int64()), pa.array(np.full(len(found), block), pa.int64()),
                     pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["bucket", "block", "keys", "counts"])


SENT = "bucket bigint, block bigint, keys binary, counts binary"
TOTALS = "block bigint, bucket bigint, totals binary"


def totalled(sent: DataFrame, shape: Callable[..., np.ndarray], exact_below: int = 0,
             with_senders: bool = False) -> DataFrame:
    """Sums per key, back to the blocks: ``shape`` turns int64 sums into the array to return.

    Buckets below ``exact_below`` hold whole keys. ``with_senders``: ``shape`` is also
    given the number of blocks that sent each key.
    """
    def run(t: pa.Table) -> pa.Table:
        kind = "<u8" if t.column("bucket")[0].as_py() < exact_below else "<u4"
        keys = [np.frombuffer(k, kind) for k in t.column("keys").to_pylist()]
        counts = [np.frombuffer(c, "u1" if len(c) == len(k) else "<u4") for c, k in
                  zip(t.column("counts").to_pylist(), keys)]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        out = (shape(sums, np.bincount(inverse)) if with_senders else shape(sums))[inverse]
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        return pa.table([t.column("block"), t.column("bucket"),
                         pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                        ["block", "bucket", "totals"])

    return sent.groupBy("bucket").applyInArrow(run, TOTALS)


def received(t: pa.Table, dtype: str) -> np.ndarray:
    """A block's totals in the order of its places."""
    order = np.argsort(t.column("bucket").to_numpy(), kind="stable")
    parts = t.column("totals").to_pylist()
    return np.frombuffer(b"".join([parts[i] for i in order]), dtype)
