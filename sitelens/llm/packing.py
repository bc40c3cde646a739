"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. All queues are cut into the same number of
stretches, source s giving stretch g its tokens floor(n_s * g / G) to
floor(n_s * (g + 1) / G): the fractions a source is owed at a cut are its deficits,
and they carry into the next stretch. Within a stretch (one task, about
``STRETCH`` tokens) windows of ``WINDOW`` tokens are filled in turn: each source is
credited its share of the window, gives as many whole tokens as it has credit for,
and keeps the rest as its deficit; tokens still missing come from the largest
deficits. What remains at the end of a stretch, less than one window, is cut into
sequences whose lengths are powers of two, which need no padding.

No token moves to lay windows out: documents travel as (row, source, tokens), and
only pieces come back to the written tokens. A source with a third of all rows is
numbered in parts (per written file part) and spread over all stretches.

Defined cases: a null text counts as empty and is one token, the end id; a null
source is a queue of its own; rows that share a doc_id are packed each on its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sitelens.llm.common import Remembered, claim, forgetting, materialise

WINDOW = 4096
STRETCH = 4096 * 512
END_ID = 2

# White space as str.split() sees it, but not as the tokenizer does; its special tokens.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")
# Characters that normalisation leaves alone but for case, each lower-cased by itself.
_SIMPLE = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
# Fixed by the vocabulary file: how it splits text, over those characters, in lower case.
_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
_coders: dict[str, "Words"] = {}
forgetting(_coders.clear)


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Words:
    """Ids of a text through the tokenizers library, word by word.

    The tokenizer drops white space and never joins what it separates, so a text's
    ids are those of its chunks, and a chunk's those of its words; both repeat and
    are remembered. Chunks of other than common Latin letters, digits and ASCII signs,
    and texts with special tokens, go to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.signs = _byte_signs()
        self.word = Remembered(self._word)
        self.chunk = Remembered(self._chunk)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.signs))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _SIMPLE.fullmatch(chunk):
            return b"".join([self.word[w] for w in _WORDS.findall(chunk.lower())])
        return self._library(chunk)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _WHOLE.search(text):
            return self._library(text)
        return b"".join(map(self.chunk.__getitem__, text.split()))


def tokenised(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text",
              source: str = "source") -> DataFrame:
    """(doc_id, source, tokens, ids): ids as bytes, two per id where the vocabulary allows it, end id included."""
    def run(batches):
        claim("packing")
        coder = _coders.setdefault(spec, None) or Words(spec)
        _coders[spec] = coder
        wide = coder.library.get_vocab_size() > 65536
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            packed, counts = [], []
            for text_ in batch.column(2).to_pylist():
                ids = np.frombuffer(coder.ids(text_) + end, "<u4")
                counts.append(len(ids))
                packed.append((ids if wide else ids.astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "source", "tokens", "ids"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .mapInArrow(run, "doc_id bigint, source string, tokens bigint, ids binary")


def queue_places(rows: DataFrame) -> DataFrame:
    """(row, source, tokens) with ``begin``, its first token's place in its source's queue.

    ``row`` holds the number of its written part above 2**33; parts are summed
    first, so no task orders more than one part of a source.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"),
                         F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))) \
        .join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))) \
        .select("row", "source", "tokens", (F.col("before") + F.col("inside")).alias("begin"))


def fill(lengths: np.ndarray, window: int) -> np.ndarray:
    """Tokens each source gives each window: deficit round-robin over queues of these lengths.

    One row a full window, one column a source. The rest of every queue is what is
    left for the sequences without padding.
    """
    total = int(lengths.sum())
    turns = total // window
    given = np.zeros((turns, len(lengths)), np.int64)
    if not turns:
        return given
    left = lengths.astype(np.int64).copy()
    quantum = lengths * (window / total)
    deficit = np.zeros(len(lengths))
    for t in range(turns):
        deficit += quantum
        take = np.minimum(np.floor(deficit + 1e-9).astype(np.int64).clip(0), left)
        short = window - int(take.sum())
        if short > 0:
            # The largest deficits give one token more each, as often as it takes.
            while short > 0:
                owed = np.where(left - take > 0, deficit - take, -np.inf)
                order = np.argsort(-owed, kind="stable")[:short]
                order = order[owed[order] > -np.inf]
                take[order] += 1
                short -= len(order)
        elif short < 0:
            order = np.argsort(deficit - take, kind="stable")
            for s in order:
                back = min(-short, int(take[s]))
                take[s] -= back
                short += back
                if not short:
                    break
        deficit -= take
        left -= take
        given[t] = take
    return given


def sequences(total: int, window: int) -> list[int]:
    """Lengths of the sequences of a stretch: full windows, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def lay_out(stretch: int, sources: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
            window: int) -> tuple[np.ndarray, ...]:
    """Pieces of one stretch: (row, start in the document, length, sequence, offset).

    Inputs are the stretch's shares of documents, ordered by source and place in the queue.
    """
    sizes = np.bincount(sources, weights=lengths).astype(np.int64)
    total = int(sizes.sum())
    given = fill(sizes, window)
    rest = sizes - given.sum(axis=0)
    out = sequences(total, window)[len(given):]
    # The rest of all queues in source order, cut at the powers of two.
    runs = [(t, s, int(n)) for t, take in enumerate(given) for s, n in enumerate(take) if n]
    k, room = 0, out[0] if out else 0
    for s, n in enumerate(rest.tolist()):
        while n:
            got = min(n, room)
            runs.append((len(given) + k, s, got))
            n -= got
            room -= got
            if not room:
                k += 1
                room = out[k] if k < len(out) else 0
    seq, src, got = (np.array(x, np.int64) for x in zip(*runs))
    # Offset within a sequence: tokens of its earlier runs.
    order = np.lexsort((np.arange(len(seq)), seq))
    seq, src, got = seq[order], src[order], got[order]
    run_end = np.cumsum(got)
    first = np.searchsorted(seq, seq, "left")
    offset = run_end - got - np.where(first > 0, run_end[first - 1], 0)
    # Both documents and runs cut a source's queue; pieces lie between neighbouring cuts.
    by_source = np.lexsort((seq, src))
    seq, src, got, offset = seq[by_source], src[by_source], got[by_source], offset[by_source]
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    run_at = np.concatenate([[0], np.cumsum(got)])
    doc_at = np.concatenate([[0], np.cumsum(lengths)])
    del base
    cuts = np.unique(np.concatenate([run_at, doc_at]))
    begin, size = cuts[:-1], np.diff(cuts)
    d = np.searchsorted(doc_at, begin, "right") - 1
    r = np.searchsorted(run_at, begin, "right") - 1
    return (rows[d], starts[d] + begin - doc_at[d], size, stretch * (2 * window) + seq[r],
            offset[r] + begin - run_at[r])


def packed(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two. Sequence ids are unique, not dense.
    """
    stored = materialise(tokenised(docs, spec, doc_id, text, source)
                         .withColumn("row", F.monotonically_increasing_id()))
    totals = stored.agg(F.sum("tokens")).first()[0] or 0
    stretches = max(1, -(-totals // stretch))
    placed = queue_places(stored.select("row", "source", "tokens"))
    sizes = stored.groupBy("source").agg(F.sum("tokens").alias("queue"))
    sizes = sizes.select(F.col("source").alias("_s"), "queue")
    placed = placed.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    g = F.lit(stretches)

    def cut(at):  # first token of stretch ``at``; decimal, as the product may pass 64 bits
        return F.floor(F.col("queue").cast("decimal(19,0)") * at.cast("decimal(19,0)") / g).cast("bigint")

    first = F.floor(F.col("begin").cast("decimal(19,0)") * g / F.col("queue")).cast("bigint")
    last = F.floor((F.col("begin") + F.col("tokens")).cast("decimal(19,0)") * g / F.col("queue")).cast("bigint")
    shares = placed.withColumn("stretch", F.explode(F.sequence(
        F.greatest(first - 1, F.lit(0)), F.least(last + 1, g.cast("bigint") - 1))))
    low = F.greatest(F.col("begin"), cut(F.col("stretch")))
    high = F.least(F.col("begin") + F.col("tokens"), cut(F.col("stretch") + 1))
    shares = shares.select("stretch", "source", "row", "begin", (low - F.col("begin")).alias("start"),
                           (high - low).alias("length")).where("length > 0")

    def run(t: pa.Table) -> pa.Table:
        number = t.column("stretch")[0].as_py()
        names = t.column("source").to_pylist()
        ordered = {s: i for i, s in enumerate(sorted(set(names), key=lambda s: (s is not None, s or "")))}
        source_ = np.array([ordered[s] for s in names])
        begin, row, start, length = (t.column(c).to_numpy() for c in ("begin", "row", "start", "length"))
        order = np.lexsort((start, begin, source_))
        cols = lay_out(number, source_[order], row[order], start[order], length[order], window)
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["row", "start", "length", "sequence_id", "offset"])

    pieces = shares.groupBy("stretch").applyInArrow(
        run, "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint")
    # A document has fewer pieces than tokens, so its list is no larger than its ids.
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("at"))

    def cut_ids(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat = cols["at"].flatten()
            n = np.diff(np.asarray(cols["at"].offsets))
            owner = np.repeat(np.arange(len(n)), n)
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            counts = cols["tokens"].to_numpy()
            ids = cols["ids"].to_pylist()
            wide = [np.frombuffer(x, "<u4" if len(x) == 4 * c else "<u2").astype("<u4") for x, c in zip(ids, counts)]
            crc = [zlib.crc32(wide[o][s:s + m]) for o, s, m in zip(owner.tolist(), start.tolist(), length.tolist())]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [cols["doc_id"].take(take), cols["source"].take(take), flat.field("start"), flat.field("length"),
                 pa.array(crc, pa.int64()), cols["tokens"].take(take), flat.field("sequence_id"),
                 flat.field("offset")],
                ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return stored.join(lists, "row").select("doc_id", "source", "tokens", "ids", "at").mapInArrow(
        cut_ids, "doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, "
                 "doc_tokens bigint, sequence_id bigint, offset bigint")
