"""Vector codes against plain loops."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from sitelens.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())] +
                      [T.StructField(c, T.IntegerType()) for c in ("x", "code", "rows", "bare", "entry", "n")])


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python integers."""
    kept = []
    for i, v, label, *_ in rows:
        if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v):
            kept.append((i, label, [int(np.floor(4096 * float(np.float32(c)))) for c in v]))
    width = -(-max(len(x) for _, _, x in kept) // parts) * parts
    w = width // parts
    kept = [(i, label, x + [0] * (width - len(x))) for i, label, x in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[x[p * w:(p + 1) * w] for _, _, x in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, x in kept:
                groups.setdefault(near(x[p * w:(p + 1) * w], books[p])[1], []).append(x[p * w:(p + 1) * w])
            for k, group in groups.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    done, totals = [], {}
    for i, label, x in kept:
        best = [near(x[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        done.append((i, label, "".join(f"{k:02x}" for _, k in best), error))
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, totals[label], sha) for i, label, code, error in done]


def vectors(n, width=16, seed=3):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 0.3) for _ in range(width)], r.choice([None, 0, 0, 0, 1, 7])) for i in range(n)]
    out += [out[-1], (5, [0.25] * width, 2), (None, [0.5] * width, None), (900, None, 1), (901, [None] * width, 1),
            (902, [float("nan")] + [0.0] * (width - 1), 1), (903, [float("-inf")] + [0.0] * (width - 1), 1), (904, [], 3),
            (905, [0.1, -0.7], 3), (-3, [1e-9, -1e-9] * (width // 2), 0)]
    return [(*v, *range(6)) for v in out]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n, width, entries", [(120, 16, 16), (3, 16, 16), (150, 13, 16), (200, 16, 100)])
def test_codes_equal_plain_loops(spark, n, width, entries):
    rows = vectors(n, width) if width == 16 else [(*r[:1], r[1][:13] if r[1] else r[1], *r[2:]) for r in vectors(n)]
    got = [tuple(r) for r in codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, entries=entries), key=key)


def test_large_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-2.0 ** 17, 2.0 ** 17) if i % 7 else r.gauss(0, 0.1) for _ in range(8)], 0, *range(6)) for i in range(60)]
    got = [tuple(r) for r in codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(brute(rows))
    with pytest.raises(Exception, match="leaves 64 bits"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 0, *range(6))], SCHEMA)).collect()


def test_masks_hold_every_near_entry():
    r = np.random.default_rng(1)
    for k in (1, 5, 64, 65, 200):
        book = r.integers(-50, 50, (k, 4))
        book[k // 2] = book[0]  # a tie
        x = r.integers(-60, 60, (300, 4))
        s = codes.Slices(book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, best = s.nearest(x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        inside = s.candidates(x, np.full(len(x), 9))
        for e in range(k):
            held = inside[:, e // 64] >> np.uint64(e % 64) & np.uint64(1)
            assert (held == (np.abs(x - book[e]).max(axis=1) <= 9)).all()


def test_nothing(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, None, 1, *range(6))], SCHEMA)).collect() == []
    only = codes.compressed(spark.createDataFrame([(1, [], 1, *range(6))], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in only] == [(1, "00" * 8, 0, 0)]
