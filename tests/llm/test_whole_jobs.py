"""Places where an operator once did less than its whole job."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators_llm import brute_components, brute_repeats, brute_scores, by_id, key

from sitelens.llm import blocks, jaccard, queries, suffixes, voronoi


def test_registered_language_model_uses_trigrams(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op8_backoff_automaton(spark, str(tmp_path)).drop("held_out")
    got = sorted((tuple(r) for r in out.collect()), key=key)
    want = sorted(brute_scores(by_id(rows), 3), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def meeting_texts(n):
    """One passage between different words in every document."""
    r = random.Random(5)

    def words(k):
        return "".join(r.choice("abcdefghij ") for _ in range(k))

    passage = words(150)
    return [(i, words(60) + passage + words(60)) for i in range(n)]


def test_suffix_groups_are_bounded(spark, monkeypatch):
    """Few blocks, many distinct runs of one anchor: no suffix array over all of them."""
    rows = meeting_texts(300)
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", 60)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    real = suffixes.first_owners

    def guarded(group):
        if len(group) > 60:
            raise AssertionError(f"{len(group)} runs in one suffix array")
        return real(group)

    monkeypatch.setattr(suffixes, "first_owners", guarded)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in suffixes.digests(df).collect()) == sorted(brute_repeats(rows))


def test_repeated_rows_are_dealt_once(spark, monkeypatch):
    rows = meeting_texts(20)
    rows += [rows[3]] * 200 + [(None, "x" * 90)] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    once, _ = suffixes._counted_once(df, "doc_id", "text", None)
    assert once.count() == 21
    got = Counter(tuple(r) for r in suffixes.digests(df).collect())
    assert got == Counter(brute_repeats(rows))
    assert Counter(r.doc_id for r in suffixes.deduplicated(df).collect()) == Counter(i for i, _ in rows)


def test_ngrams_that_agree_in_32_bits_are_told_apart(spark, rows, docs, monkeypatch):
    """Hashes of which only the high bits differ keep their own counts at every order."""
    from sitelens.llm import lm

    class Narrow(lm.Grams):
        def __init__(self, *args, **more):
            lm.Grams.__init__(self, *args, **more)
            self.hash = [h & np.uint64(0xFFFFFFFF00000001) for h in self.hash]

    monkeypatch.setattr(lm, "Grams", Narrow)
    from sitelens.llm.common import fold
    got = sorted((tuple(r) for r in lm.scored(docs, fold("doc_id", 10) != 0).collect()), key=key)
    want = sorted(brute_scores(by_id(rows), 3), key=key)
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


def test_large_vectors_take_part(spark):
    r = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in r.normal(size=4)]) for i in range(150)]
    vectors += [(200, [2.0 ** 21, 1.0, -3.5, 2.0 ** 20]), (201, [-2.0 ** 22, 0.25, 2.0 ** 21 + 1, 7.0]),
                (202, [2.0 ** 24, 0.0, 0.0, 1.0]), (203, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(x) for x in voronoi.top_products(df, F.col("vec_id") % 50 == 0, pivots=9, block=32).collect())
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in vectors if i != 203}
    want = []
    for q in range(0, 201, 50):
        if q in whole:
            best = sorted((-sum(a * b for a, b in zip(whole[q], x)), j) for j, x in whole.items() if j != q)[:5]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert {201, 202} & {r[2] for r in got}
    for big in (2.0 ** 50, 1e30):
        with pytest.raises(Exception, match="64 bits"):
            wide = df.unionByName(spark.createDataFrame([(50, [big, 0.0, 0.0, 0.0]), (300, [big, 0.0, 0.0, 0.0])], df.schema))
            voronoi.top_products(wide, F.col("vec_id") % 50 == 0, pivots=9, block=32).collect()


def test_one_group_of_three_classes_links_two(spark):
    """The same size and prefix, and only the two that are not the centre link."""
    p, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 30), ("x", 53), ("y", 53)))
    texts = [p + y + ["g"]] * 2 + [p + x + ["a"], p + x + ["b"]]
    texts += [p[-4:] + z + [f"u{k}{z[0]}{i}" for i in range(40)] for z in (x, y) for k in range(8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = [tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows))
    assert {i: c for i, _, c in got}[3] == 2
