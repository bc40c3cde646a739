"""N-gram Jaccard join with grouped prefixes, and components of the linked documents.

A document is the set of its distinct five-word shingles (64-bit hashes); two
documents link when their Jaccard similarity is at least 3/4.

1. Rare first: corpus-wide counts of shingles (see ``blocks``) order every set by how
   many texts have the shingle. A shingle of one text cannot be shared, so a set in
   which fewer than 3/4 can be shared links with nothing and leaves here.
2. Copies collapse: equal sets are one class, whatever their number.
3. Grouped prefixes: two linked sets share one of their first n - ceil(3n/4) + 1
   shingles in that order. Classes with the same size and prefix are one group, and
   only groups are listed under prefix shingles. Group pairs must fit in size and in
   the places of their first common shingle.
4. Stars: each list has a centre, the group with most copies, and its other groups are
   paired with it; pairs are expanded to members, and members verified on whole sets.
5. The rest: pairs of a list that the star does not settle. Two members linked with
   the centre are connected already; of the others, only pairs of different
   components remain, and as 1 - Jaccard is a metric, only those whose distances
   from the centre differ by at most 1/4. These are verified too, so no link between
   different components is lost, while a list of near copies costs its length, not
   its square.

Components follow from the verified links, by smallest labels.

Defined cases: a text without words, or null, has the empty set and links with
nothing, not even its like; with one to four words the whole sequence is the one
shingle; rows that share a doc_id are one node; a null doc_id takes no part and has
a null component.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.blocks import SENT, blocked, buckets, corpus_bytes, places, received, send, totalled
from sitelens.llm.common import claim, hashes, materialise, mix, raw

WORDS = 5


def shingles(data: bytes) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles, ascending."""
    words = data.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(WORDS, len(h))
    m = len(h) - width + 1
    out = h[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m]
    return np.unique(mix(out + np.uint64(width)))


def _sets(t: pa.Table) -> list[np.ndarray]:
    data, at = raw(t.column("text"))
    whole = data.tobytes()
    return [shingles(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def least_shared(n: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return (3 * n + 3) // 4


def _rarity(sums: np.ndarray) -> np.ndarray:
    """0 for shingles of one text, else the bit length of the count."""
    return np.where(sums < 2, 0, np.floor(np.log2(np.maximum(sums, 1))) + 1).astype("u1")


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, class, shingles, prefix, prefix_key) of every row; materialised.

    The last four are null where no link is possible. ``prefix`` holds the prefix's
    shingles that other texts have, ``prefix_key`` stands for the whole prefix.
    """
    size = corpus_bytes(docs, text)
    n_buckets = buckets(size)
    texts = blocked(docs, size, doc_id, text).groupBy("block")

    def count(t: pa.Table) -> pa.Table:
        claim("jaccard")
        # Copies of a text within a block count once.
        distinct = {s.tobytes(): s for s in _sets(t)}
        every = np.concatenate([*distinct.values(), np.zeros(0, np.uint64)])
        at, n = np.unique(places(every, n_buckets), return_counts=True)
        return send(t.column("block")[0].as_py(), at, n)

    def pick(t: pa.Table, back: pa.Table) -> pa.Table:
        claim("jaccard")
        if not t.num_rows:
            return _SETS.empty_table()
        sets = _sets(t)
        at = np.unique(places(np.concatenate([*sets, np.zeros(0, np.uint64)]), n_buckets))
        rarity = received(back, "u1") if back.num_rows else np.zeros(0, "u1")
        out = []
        copies = Counter(s.tobytes() for s in sets)
        for i, s in zip(t.column("doc_id").to_pylist(), sets):
            n = len(s)
            need = least_shared(n)
            own = rarity[np.searchsorted(at, places(s, n_buckets))]
            if i is None or not n or np.count_nonzero(own) < need and copies[s.tobytes()] == 1:
                out.append((i, n, None, None, None, None))
                continue
            first = np.lexsort((s, own))[:n - need + 1]
            out.append((i, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes(),
                        s[first][own[first] > 0].view(np.int64),
                        hashlib.blake2b(s[first].tobytes(), digest_size=16).digest()))
        return pa.table([pa.array(c, ty) for c, ty in zip(zip(*out), _SETS.types)], schema=_SETS)

    totals = totalled(texts.applyInArrow(count, SENT), _rarity)
    return materialise(texts.cogroup(totals.groupBy("block")).applyInArrow(
        pick, "doc_id bigint, n bigint, class binary, shingles binary, prefix array<bigint>, prefix_key binary"))


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("shingles", pa.binary()),
                   ("prefix", pa.list_(pa.int64())), ("prefix_key", pa.binary())])


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their representatives' ids, and their distance 1 - Jaccard; ``links`` says whether it is at most 1/4."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            both = np.array([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), True))
                             for p, q in zip(x, y)], np.int64)
            union = np.array([(len(p) + len(q)) // 8 for p, q in zip(x, y)], np.int64) - both
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(1 - both / union), pa.array(100 * both >= 75 * union)],
                ["a", "b", "rep_a", "rep_b", "distance", "links"])

    sets = classes.select("cid", "rep", "shingles")
    joined = pairs.join(sets.select(F.col("cid").alias("b"), F.col("rep").alias("rep_b"),
                                    F.col("shingles").alias("set_b")), "b") \
        .join(sets.select(F.col("cid").alias("a"), F.col("rep").alias("rep_a"), F.col("shingles").alias("set_a")), "a")
    return joined.select("a", "b", "rep_a", "rep_b", "set_a", "set_b").mapInArrow(
        run, "a bigint, b bigint, rep_a bigint, rep_b bigint, distance double, links boolean")


def _fits(n: str, m: str, i: str, j: str):
    """Whether sets of n and m shingles can link, their first common one at places i and j.

    Linked sets share at least 3/7 of n + m, all of it from their first common
    shingle on. At a later common one this may fail, but a linked pair meets at its
    first, too.
    """
    total = 3 * (F.col(n) + F.col(m))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * (F.col(n) - F.col(i)) >= total) \
        & (7 * (F.col(m) - F.col(j)) >= total)


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = shingle_sets(docs, doc_id, text)
    able = rows.where(F.col("class").isNotNull())
    classes = able.groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("shingles").alias("shingles"),
        F.first("prefix").alias("prefix"), F.first("prefix_key").alias("prefix_key"))
    # Should two classes share a 64-bit name, joins find both and both are verified.
    classes = materialise(classes.withColumn("cid", F.xxhash64("class")))
    # A group goes by its class with the most copies, likely what its near copies come from.
    groups = classes.groupBy("n", "prefix_key").agg(
        F.min(F.struct((-F.col("copies")).alias("fewer"), "cid")).alias("g"), F.count(F.lit(1)).alias("members")) \
        .select("n", "prefix_key", F.col("g.cid").alias("gid"), F.col("g.fewer").alias("fewer"), "members")
    members = materialise(
        classes.select("cid", "rep", "n", "prefix_key", "prefix").join(groups, ["n", "prefix_key"]).select(
            "cid", "rep", "n", "gid", "fewer", "members", F.when(F.col("cid") == F.col("gid"), F.col("prefix")).alias("prefix")))
    # Places count from the set's rarest shingle; those of one text alone are not listed.
    lead = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - F.size("prefix")
    lists = members.where("prefix is not null").select(
        F.posexplode("prefix").alias("pos", "shingle"), "gid", "n", "fewer", "members", lead.alias("lead")) \
        .select("shingle", "gid", "n", "fewer", "members", (F.col("lead") + F.col("pos")).cast("int").alias("place"))
    # A list of one group settles pairs too, if the group has several classes.
    centres = lists.groupBy("shingle").agg(F.min(F.struct("fewer", "gid", "n", "place")).alias("c"),
                                           F.sum("members").alias("m")) \
        .where("m > 1").select("shingle", F.col("c.gid").alias("centre"), F.col("c.n").alias("centre_n"),
                               F.col("c.place").alias("centre_place"))
    listed = materialise(lists.drop("fewer", "members").join(centres, "shingle"))
    star = listed.where((F.col("gid") != F.col("centre")) & _fits("n", "centre_n", "place", "centre_place")) \
        .select("gid", "centre").distinct()
    pairs = star.join(members.select("cid", "gid"), "gid").select(F.col("cid").alias("a"), F.col("centre").alias("b")) \
        .unionByName(members.where("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b")))
    stars = materialise(verified(pairs, classes))
    links = stars.where("links").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # Rows of a class are linked with its smallest id.
    links = links.unionByName(
        able.select("doc_id", "class").join(classes.select("class", "rep"), "class")
        .where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    links = materialise(links)
    found = _components(links)

    named = members.select("cid", "rep", "n", "gid").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select("cid", "n", "gid", F.coalesce("component", "rep").alias("component"))
    near = stars.select(F.col("a").alias("cid"), F.col("b").alias("centre"), "distance", "links")
    # A group of its own centre's lists is at distance 0; its other members were paired with it.
    placed = listed.select("shingle", "gid", "centre", "place").join(named, "gid").join(near, ["cid", "centre"], "left") \
        .withColumn("distance", F.when(F.col("cid") == F.col("centre"), 0.0).otherwise(F.col("distance"))) \
        .withColumn("far", ~F.coalesce("links", F.col("cid") == F.col("centre")))
    placed = placed.select("shingle", "cid", "n", "place", "component", "distance", "far")
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("shingle")
    open_ = materialise(placed.join(mixed, "shingle"))
    one = open_.where("far").select("shingle", F.col("cid").alias("a"), F.col("n").alias("na"),
                                    F.col("component").alias("ca"), F.col("distance").alias("da"),
                                    F.col("place").alias("pa"))
    two = open_.select("shingle", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"),
                       F.col("distance").alias("db"), F.col("far").alias("fb"),
                        F.col("place").alias("pb"))
    rest = one.join(two, "shingle").where(
        (F.col("ca") != F.col("cb")) & (~F.col("fb") | (F.col("a") < F.col("b"))) & _fits("na", "nb", "pa", "pb")
        & F.coalesce(F.abs(F.col("da") - F.col("db")) <= 0.25 + 1e-9, F.lit(True))).select("a", "b").distinct()
    more = verified(rest, classes).where("links").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    more = materialise(more)
    if not more.isEmpty():
        found = _components(links.unionByName(more))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(
        found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node it reaches.

    Every round gives a node the smallest label of its neighbours, then the label of
    that label's node, so labels cover a chain in logarithmically many rounds. Links
    are mostly stars by then, which take two or three. Labels are written each round.
    """
    links = links.where("a <> b")
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("label"))
    labels = materialise(labels)
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                   F.least("label", "near").alias("next"))
        jumped = stepped.join(labels.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next") \
            .select("node", "old", F.least("next", "beyond").alias("label"))
        jumped = materialise(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns unchanged.

    Rows that share an id have their component's decision in common, and rows with a
    null id stay.
    """
    gone = linked(docs, doc_id, text).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == F.col("_gone"), "left_anti")
