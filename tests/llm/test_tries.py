"""The conversation trie against a plain dictionary of prefixes."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from sitelens.llm import tries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())] +
                      [T.StructField(c, T.IntegerType()) for c in ("head", "path", "n", "first", "ends", "depth", "turns")])


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - c % 100, [])[:h] + ts[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    if not members:
        return []
    out = []
    for p, inside in members.items():
        children = [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        below = [q for q in members if q[:len(p)] == p]
        leaves = sum(1 for q in below if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c, end in inside if end)))
        out.append((min(c for c, _ in inside), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(inside), len(children),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns():
    r = random.Random(4)
    texts = ["hi", "héllo wörld", "", None, "tell me more", "日本", "x" * 500]
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), 9_000_000_000, 9_000_000_101]:
        for t in range(r.randint(1, 7)):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, r.choice(["user", "assistant", None]), r.choice(texts[:3 + c % 4])))
    copy = [("user", "same"), ("assistant", "again"), ("user", "end")]
    rows += [(c, t, *copy[t]) for c in range(400, 460) for t in range(3)]  # copies of one conversation
    rows += [(470, t, "user", f"long {t // 7}") for t in range(300)]  # a long one
    rows += [(None, 1, "user", "nobody's"), (600, None, None, None), (480, 1, "ab", "c"), (481, 1, "a", "bc")]
    rows += [(490, 3, "user", "again"), (490, 3, "user", "again")]  # a repeated row
    return [(*row, *range(7)) for row in rows]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("container", [1, 3, 1024])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, container):
    rows = turns()
    if container == 3:
        monkeypatch.setattr(tries, "FEW_HEADS", 0)  # no broadcast
        monkeypatch.setattr(tries, "ID_RUN", 7)
    if container == 1:  # every round one turn deeper: without the long conversation
        rows = [r for r in rows if r[0] != 470]
    got = [tuple(r) for r in tries.shared_prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), container=container).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_containers_are_bounded(spark):
    df = spark.createDataFrame([r for r in turns() if r[0] != 470], SCHEMA)
    seqs = tries.sequences(tries.conversations(df))
    settled, heads = tries.burst(seqs, 4)
    sizes = [r[0] for r in settled.groupBy("head").count().select("count").collect()]
    assert max(sizes) <= 4 and heads.count() > 3
    ended = heads.where("ends is not null").count()
    assert sum(sizes) + ended == seqs.count()


def test_nothing(spark):
    assert tries.shared_prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tries.shared_prefix_trie(spark.createDataFrame([(None, 1, "user", "x", *range(7))], SCHEMA)).collect() == []
