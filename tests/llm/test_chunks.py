"""Chunked byte-level BPE against the tokenizers library."""
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitelens.llm import chunks


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    return Tokenizer.from_str(spec)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    out = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("chunk", [32, 512])
def test_ids_equal_the_library(spark, docs, rows, spec, library, chunk, monkeypatch):
    if chunk == 32:
        monkeypatch.setattr(chunks, "LEAST", 32)
    got = [tuple(r) for r in chunks.digests(docs, spec, chunk=chunk).collect()]
    every = [(r[0], r[1]) for r in rows] + [(None, "no id but text " * 20), (rows[10][0], rows[10][1])]
    assert sorted(got, key=key) == sorted([(i, *expected(library, t)) for i, t in every], key=key)


def awkward(r):
    """Text whose splits depend on what surrounds them."""
    bits = [" ", "  ", "\n", "\n\n", "\t", " \n", "'s", "'re", "'", "''", "a", "Zb", "é", "ßü", "12", "3", "²", "½", "!", "?!", "…", "€",
            "<|endoftext|>", "<|endo", "ftext|>", "日本", "語。", " ", "　", " ", "\x1c", "\x85", "🙂", "é", "\r\n", "word",
            "ñandú", "I'll", "don't", "\u0000", "ﬁ", "Ⅷ", "٣", "_"]
    return "".join(r.choice(bits) for _ in range(r.randint(1, 60)))


def test_every_cut_is_repaired(spec, library):
    """Whatever the cuts, joins come out as the library has the whole text."""
    code, r = chunks.Coder(spec), random.Random(11)
    for _ in range(3000):
        text = awkward(r)
        data = text.encode()
        bounds = [len(text[:i].encode()) for i in range(1, len(text))]
        ends = sorted({*r.sample(bounds, min(len(bounds), r.randint(0, 6))), len(data)})
        parts = [code.ids(data[a:b].decode()) for a, b in zip([0, *ends], ends)]
        ids = chunks.joined(code, data, ends, parts)
        assert len(parts) == 1 or chunks._joined_widely(code, data, ends, parts).tolist() == ids.tolist()
        found = chunks._windows(data, ends)
        assert not found or set(found) <= set(chunks.splits(np.frombuffer(data, np.uint8)).tolist())
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert code.decoded(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_common_characters_are_split_like_the_library(spec, library):
    code = chunks.Coder(spec)
    common = [chr(c) for c in range(1, 0x2100) if chunks._COMMON.fullmatch(chr(c))]
    r = random.Random(2)
    for c in common:
        for text in (c, f"a{c}1{c}", f" {c}{c} !{c}", f"'{c}"):
            assert code.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(500):
        text = "".join(r.choice(common) for _ in range(80))
        assert code.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_safe_places_split_in_every_context(library):
    r, seen = random.Random(3), 0
    for _ in range(3000):
        text = awkward(r)
        data = text.encode()
        for at in chunks.splits(np.frombuffer(data, np.uint8)).tolist()[:2]:
            whole = library.encode(text, add_special_tokens=False).ids
            parts = [library.encode(x.decode(), add_special_tokens=False).ids for x in (data[:at], data[at:])]
            assert whole == parts[0] + parts[1], text
            seen += 1
    assert seen > 1000


def test_cuts_depend_on_content_only():
    r = random.Random(5)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(6000))
    found = []
    for before in (b"", b"x" * 777, bytes(r.choice(b"abc ") for _ in range(1234))):
        data = before + passage + b"end" * 50
        ends = chunks.cuts(np.frombuffer(data, np.uint8), 256)
        assert ends[-1] == len(data) and min(np.diff([0, *ends])[:-1]) >= chunks.LEAST
        found.append({e - len(before) for e in ends if 1000 < e - len(before) < 6000})
    assert len(found[0] & found[1] & found[2]) >= 0.7 * len(found[0]) > 3
    same = chunks.cuts(np.frombuffer(b"a" * 100_000, np.uint8))
    assert same[-1] == 100_000 and len(same) < 2000


def test_shared_chunks_are_encoded_once(spark, spec, library):
    r = random.Random(8)
    passage = " ".join("".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(900))
    texts = [(i, f"{i} " * (50 + i) + passage + f" {i * i}" * 40) for i in range(12)] + [(90, passage), (91, passage)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = chunks.encoded(df, spec)
    got = {x.doc_id: np.frombuffer(x.ids, "<u2").tolist() for x in out.collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert {x.doc_id: x.decoded for x in out.collect()} == dict(texts)


def test_other_vocabularies_go_through_the_library(spark, spec):
    rules = json.loads(spec)
    rules["normalizer"] = {"type": "Lowercase"}
    changed = json.dumps(rules)
    texts = [(1, "Some TEXT " * 200), (2, "Some TEXT " * 200 + "more"), (3, None)]
    got = {x.doc_id: np.frombuffer(x.ids, "<u2").tolist() for x in
           chunks.encoded(spark.createDataFrame(texts, "doc_id long, text string"), changed).collect()}
    library = Tokenizer.from_str(changed)
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}


def test_nothing_and_bounded_memo(spark, nothing, spec):
    assert chunks.digests(nothing, spec).collect() == []
    memo = chunks.Memo(lambda w: w.encode(), 100_000)
    for k in range(5000):
        assert memo[f"w{k}"] == f"w{k}".encode()
        assert memo["often"] == b"often"
    assert len(memo) + len(memo.older) < 1000
