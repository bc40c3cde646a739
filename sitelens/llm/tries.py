"""Prefix trie of conversations, built as a burst trie over shards.

A conversation is a path of turn ids (16 bytes of the SHA-256 of role and text).

1. Conversations with equal paths are one sequence with a count, a smallest id and the
   digest of its ids, so a group of copies is one row from here on.
2. A container holds the suffixes of all sequences below one prefix, its head. It starts
   at the root; where it holds more than ``CONTAINER`` sequences it bursts: its prefix
   becomes a head of the trie and its sequences move on to containers by their next turn
   id. Only bursting containers are read again, and copies are gone, so every burst
   divides or shortens; there is no limit on rounds.
3. The remaining containers are dealt out by head. Sorted by path, a container is swept
   once: neighbours' common prefix says which nodes to close and which to open, and one
   pass backwards over the container's nodes adds children up.
4. Heads get their counts from the burst, and the leaves and savings of everything below
   from the containers' tops, which name all their heads.

What a task holds is one container: at most ``CONTAINER`` sequences, 24 bytes a turn.
Ids that end in one node are first joined in runs of consecutive ids, then hashed in
order as a stream. Every burst round is written, so lost executors repeat no round.

Defined cases: rows with a null conv_id belong to no conversation; null roles and texts
are empty; turns of one number are ordered by turn id, null numbers come first; repeated
rows are repeated turns; a conversation without turns ends in the root; an empty table
has no nodes. A conversation is one row (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sitelens.llm.common import materialise

CONTAINER = 1024
# Sequences or ids of one node are first put together in ranges of so many ids.
ID_RUN = 4096
# Heads of a round that may be broadcast, and bytes of their prefixes.
FEW_HEADS, FEW_BYTES = 100_000, 32 << 20
TURN = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string")


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as (id, chars)."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_)
    one = F.struct(F.col(turn).isNotNull().alias("numbered"), F.coalesce(F.col(turn).cast("bigint"), F.lit(0)).alias("turn"),
                   F.substring(F.unhex(F.sha2(named, 256)), 1, TURN).alias("id"),
                   F.char_length(text_).cast("bigint").alias("chars"))
    return turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), one.alias("one")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")) \
        .select("conv_id", F.transform("turns", lambda t: F.struct(t.id.alias("id"), t.chars.alias("chars"))).alias("turns"))


def grafted(convs: DataFrame, base: Column, is_base: Column, taken: Column, most: int) -> DataFrame:
    """Conversations whose first ``taken`` turns are replaced by as many of conversation ``base``.

    ``is_base`` is true of the rows that some conversation names as its base, and
    ``taken`` is at most ``most``: only so many turns of a base travel.
    """
    heads = convs.where(is_base).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most).alias("lent"))
    none = F.slice("turns", 1, 0)
    return convs.withColumn("base_id", base).join(heads, "base_id", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("lent", none), F.lit(1), taken),
                            F.slice("turns", taken + 1, F.greatest(F.size("turns") - taken, F.lit(0)))).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(path, chars, n, first, ends): distinct sequences with their conversations' count, smallest id and digest."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.id)), ""))
    runs = convs.select("conv_id", F.coalesce(path, F.lit(b"")).alias("path"),
                        F.transform("turns", lambda t: t.chars).alias("chars"),
                        F.floor(F.col("conv_id") / ID_RUN).alias("run")) \
        .groupBy("path", "run").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"),
                                    F.min("conv_id").alias("first"), F.sort_array(F.collect_list("conv_id")).alias("ids")) \
        .select("path", "run", "chars", "n", "first",
                F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def add(batches):
        held = None
        for batch in batches:
            out = []
            for path_, chars, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "n", "first", "ids"))):
                if held is None or held[0] != path_:
                    if held is not None:
                        out.append((*held[:4], held[4].hexdigest()))
                    held = [path_, chars, n, first, hashlib.sha256(ids.encode())]
                else:
                    held[2] += n
                    held[3] = min(held[3], first)
                    held[4].update(("," + ids).encode())
            yield _table(out, SEQUENCES)
        if held is not None:
            yield _table([(*held[:4], held[4].hexdigest())], SEQUENCES)

    return runs.repartition("path").sortWithinPartitions("path", "run") \
        .mapInArrow(add, "path binary, chars array<bigint>, n bigint, first bigint, ends string")


SEQUENCES = pa.schema([("path", pa.binary()), ("chars", pa.list_(pa.int64())), ("n", pa.int64()), ("first", pa.int64()),
                       ("ends", pa.string())])
SWEPT = pa.schema([("parent_head", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("ends_sha256", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _may_broadcast(heads: DataFrame, column: str) -> bool:
    n, size = heads.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return n <= FEW_HEADS and (size or 0) <= FEW_BYTES


def burst(seqs: DataFrame, container: int = CONTAINER) -> tuple[DataFrame, DataFrame | None]:
    """Containers of at most ``container`` sequences, and the heads above them (None: the root's container did not burst).

    Containers: the sequences with their ``head``, a prefix of ``path``. Heads: (head, depth,
    n, first, chars, ends), each more than ``container`` sequences.
    """
    settled, heads, depth = [], [], 0
    pending = seqs.withColumn("head", F.substring("path", 1, 0))
    while True:
        last = F.coalesce(F.try_element_at("chars", F.lit(depth)), F.lit(0)) if depth else F.lit(0).cast("bigint")
        large = materialise(
            pending.groupBy("head").agg(
                F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("first").alias("first"), F.first(last).alias("chars"),
                F.max(F.when(F.octet_length("path") == depth * TURN, F.col("ends"))).alias("ends"))
            .where(F.col("rows") > container).drop("rows").withColumn("depth", F.lit(depth).cast("bigint")))
        few = _may_broadcast(large, "head")
        if large.isEmpty():
            settled.append(pending)
            break
        heads.append(large)
        names = large.select("head", F.lit(True).alias("bursts"))
        moved = materialise(pending.join(F.broadcast(names) if few else names, "head", "left"))
        settled.append(moved.where("bursts is null").drop("bursts"))
        depth += 1
        # What ends in the head itself is part of it; the others move on by their next turn.
        pending = moved.where(F.col("bursts") & (F.octet_length("path") >= depth * TURN)).drop("bursts") \
            .withColumn("head", F.substring("path", 1, depth * TURN))

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return union(settled), union(heads) if heads else None


def sweep(head: bytes, rows: list[tuple]) -> list[tuple]:
    """Nodes of one container, whose rows (path, chars, n, first, ends) ascend by path. The first is its top."""
    base = len(head) // TURN
    parent, depth, own_chars, n, first, ends = [-1], [base], [rows[0][1][base - 1] if base else 0], [0], [None], [NO_ENDS]
    open_nodes, before = [0], head
    for path, chars, copies, smallest, digest in rows:
        size, common, most = len(path) // TURN, base, min(len(path), len(before)) // TURN
        while common < most and path[common * TURN:(common + 1) * TURN] == before[common * TURN:(common + 1) * TURN]:
            common += 1
        del open_nodes[common - base + 1:]
        for d in range(common + 1, size + 1):
            parent.append(open_nodes[-1])
            open_nodes.append(len(depth))
            depth.append(d)
            own_chars.append(chars[d - 1])
            n.append(0)
            first.append(None)
            ends.append(NO_ENDS)
        at = open_nodes[-1]
        n[at], first[at], ends[at], before = copies, smallest, digest, path
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for i in range(len(n) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * own_chars[i]
        if (p := parent[i]) >= 0:
            n[p] += n[i]
            first[p] = first[i] if first[p] is None else min(first[p], first[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    above = head[:-TURN] if base else None
    return [(above if i == 0 else None, first[i], depth[i], first[parent[i]] if i else None, n[i], children[i], leaves[i], saved[i],
             ends[i]) for i in range(len(n))]


def _swept(batches):
    """Containers arrive whole and in order; one may lie over several batches."""
    head, held = None, []
    for batch in batches:
        out = []
        for head_, *row in zip(*(batch.column(c).to_pylist() for c in ("head", "path", "chars", "n", "first", "ends"))):
            if head_ != head:
                if held:
                    out += sweep(head, held)
                head, held = head_, []
            held.append(row)
        yield _table(out, SWEPT)
    if held:
        yield _table(sweep(head, held), SWEPT)


def trie(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie of ``convs`` (conv_id, turns: id and chars), see ``NODES``."""
    seqs = materialise(sequences(convs))
    containers, heads = burst(seqs, container)
    nodes = containers.select("head", "path", "chars", "n", "first", "ends").repartition("head") \
        .sortWithinPartitions("head", "path") \
        .mapInArrow(_swept, "parent_head binary, " + NODES)
    if heads is None:
        return nodes.drop("parent_head")
    nodes, heads = materialise(nodes), materialise(heads)
    tops = nodes.where("parent_head is not null")
    above = F.when(F.col("depth") > 0, F.substring("head", F.lit(1), (F.octet_length("head") - TURN).cast("int")))
    # What each container's top and each head adds to every head above it.
    shares = tops.select(F.col("parent_head").alias("below"), "n_leaves", "saved_tokens").unionByName(
        heads.select(F.col("head").alias("below"), F.lit(0).cast("bigint").alias("n_leaves"),
                     ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens")))
    levels = F.explode(F.sequence(F.lit(0), (F.octet_length("below") / TURN).cast("int")))
    sums = shares.select("*", levels.alias("level")) \
        .groupBy(F.substring("below", F.lit(1), F.col("level") * TURN).alias("head")) \
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = tops.select(F.col("parent_head").alias("head")).unionByName(
        heads.where("depth > 0").select(above.alias("head"))).groupBy("head").agg(F.count(F.lit(1)).alias("n_children"))
    named = heads.select(F.col("head").alias("parent_head"), F.col("first").alias("above_id"))
    named = F.broadcast(named) if _may_broadcast(heads, "head") else named
    inner = heads.join(sums, "head").join(children, "head").withColumn("parent_head", above).join(named, "parent_head", "left") \
        .select(F.col("first").alias("conv_id"), "depth", F.col("above_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    outer = nodes.join(named, "parent_head", "left") \
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id")).select(*inner.columns)
    return inner.unionByName(outer)


def shared_prefix_trie(turns: DataFrame, block: int = 100, most: int = 6, container: int = CONTAINER,
                       taken: Callable[[Column], Column] | None = None) -> DataFrame:
    """The trie of conversations that share opening turns by block of ids.

    Conversation c starts with the first h turns of conversation c - c % ``block``, h being
    ``taken(c)``, by default the unsigned crc32 of the decimal c modulo ``most``.
    """
    c = F.col("conv_id")
    h = taken(c) if taken else F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")
    return trie(grafted(conversations(turns), c - c % block, c % block == 0, h, most - 1), container)
