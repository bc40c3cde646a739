"""Each operator against brute force on a fixture of awkward documents."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from sitelens.llm import (fingerprints, jaccard, lm, packing, pieces, quality, suffixes, toxicity, voronoi, warc)


def model_bytes():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def word_spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def by_id(rows):
    """Rows of the fixture as the operators see them: the null id and the repeat included."""
    return [(r[0], r[1] or "") for r in rows] + [(None, "no id but text " * 20), (rows[10][0], rows[10][1] or "")]


# --- suffix arrays -----------------------------------------------------------------------------

def test_suffix_array_equals_sorting():
    r = random.Random(1)
    for k in range(400):
        d = bytes(r.choice(b"ab" if k % 2 else b"abcd") for _ in range(r.randint(0, 50))) * r.randint(1, 3)
        assert suffixes.suffix_array(d) == sorted(range(len(d)), key=lambda i: d[i:])


def test_only_windows_that_may_repeat_are_ordered(monkeypatch):
    r = random.Random(4)

    def noise(n):
        return bytes(r.choice(b"abcdefgh") for _ in range(n))

    groups = []
    for _ in range(40):
        shared, group = noise(60), {}
        for _ in range(r.randint(1, 4)):
            group[noise(r.randint(5, 30)) + (shared if r.random() < 0.5 else noise(60)) + noise(r.randint(0, 20))] = r.randint(1, 99)
        groups.append(group | {b"a" * 70: 7, b"a" * 55: 3} if r.random() < 0.2 else group)
    whole, sizes, real = [suffixes.first_owners(g) for g in groups], [], suffixes.first_owners
    monkeypatch.setattr(suffixes, "first_owners", lambda runs: sizes.append(sum(map(len, runs))) or real(runs))
    found = suffixes.contested_owners(groups)
    for group, want, got in zip(groups, whole, found):
        assert {run: got.get(run, [d] * (len(run) - 49)) for run, d in group.items()} == want
    assert 0 < sum(sizes) < sum(len(run) for g in groups for run in g) / 1.5
    assert suffixes.contested_owners([]) == []


def brute_repeats(texts, width=50):
    first = {}
    encoded = [(i, t.encode()) for i, t in texts]
    for i, b in encoded:
        if i is not None:
            for s in range(len(b) - width + 1):
                first[b[s:s + width]] = min(i, first.get(b[s:s + width], i))
    out = []
    for i, b in encoded:
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - width + 1):
                if first[b[s:s + width]] < i:
                    gone[s:s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_repeated_passages(docs, rows):
    got = [tuple(r) for r in suffixes.digests(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(by_id(rows)), key=key)
    assert sum(r[2] for r in got) > 1000


def test_hot_anchors_split_by_window(docs, rows, monkeypatch):
    # The split must not change results; both sides of the threshold occur at 1.
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", 2)
    from sitelens.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    got = [tuple(r) for r in suffixes.digests(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_repeats(by_id(rows)), key=key)


def test_deduplicated_keeps_columns(docs):
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert out.where("n_chars <> char_length(text)").count() == 0


# --- n-gram Jaccard join -----------------------------------------------------------------------

def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else \
            frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i) if i is not None else None) for i, _ in texts]


def test_components(docs, rows):
    got = [tuple(r) for r in jaccard.linked(docs).collect()]
    want = brute_components(by_id(rows))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[2] for r in want}) < len(want) - 8


def test_stars_lose_no_link(spark):
    """Families whose members link in chains, and lists shared by several families."""
    r = random.Random(4)
    texts = []
    shared = [f"s{i}" for i in range(60)]
    for family in range(6):
        words = shared + [f"f{family}w{i}" for i in range(40)]
        for member in range(12):
            own = list(words)
            for _ in range(member):
                own[r.randrange(len(own))] = f"x{r.randrange(10 ** 6)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = [tuple(x) for x in jaccard.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_keep_one(docs, rows):
    left = sorted(r[0] for r in jaccard.keep_one(docs).select("doc_id").collect() if r[0] is not None)
    assert left == sorted(i for i, _, c in brute_components(by_id(rows)) if i is not None and i == c)


# --- fingerprints ------------------------------------------------------------------------------

def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_edits(docs).collect()
    ordered = sorted(by_id(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = dict(ordered)
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) <= 12 * fingerprints.K


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([("x", a), ("x", b), ("y", a), ("z", "")], "k string, t string")
    sketched = fingerprints.with_sketch(df, "t", "s", 512)
    merged = {r.k: r.s for r in fingerprints.merge_groups(sketched, ["k"], "s", 512).collect()}
    whole = fingerprints.with_sketch(spark.createDataFrame([(a,)], "t string"), "t", "s", 512).first().s
    assert merged["y"] == whole and merged["z"] == []
    pair = sketched.where("k = 'x'").orderBy("t").select("s").collect()
    two = spark.createDataFrame([(pair[0].s, pair[1].s)], "a array<bigint>, b array<bigint>").select(
        fingerprints.merged(F.col("a"), F.col("b"), 512).alias("m"),
        fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("r"),
        fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"),
        fingerprints.distinct_shingles(F.col("a"), 512).alias("n")).first()
    assert two.m == merged["x"]
    assert abs(two.r - 1 / 3) < 0.08 and abs(two.c - 0.5) < 0.12 and abs(two.n - 1996) < 250


# --- pieces ------------------------------------------------------------------------------------

def test_pieces_equal_the_library(docs, rows):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    want = Counter()
    for i, t in by_id(rows):
        ids = library.encode(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = pieces.encoding_digests(docs, model_bytes()).collect()
    assert Counter(tuple(r)[:4] for r in got) == want


def test_byte_pieces_are_decoded_once_a_word(monkeypatch):
    """Line ends and other characters without a piece send no whole text through decode()."""
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    coder = pieces.Pieces(model_bytes())
    asked = []
    decode = coder.decode
    monkeypatch.setattr(coder, "decode", lambda ids, *more: asked.append(len(ids)) or decode(ids, *more))
    for text in ("one\ntwo\n", "\n", " \n ", "a \u2603\n b", "\u2581x \u2581", "\x00\t\ufffd", "\u65e5\u672c\u8a9e\n" * 3, "", " "):
        ids, n, begins, ends, norm = coder.encode(text.encode())
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and n == len(want)
        assert coder.decode_joined(ids, norm) == library.decode(want)
        assert norm is not None
    asked.clear()
    text = "one\n two\n " * 50
    ids, n, _, _, norm = coder.encode(text.encode())
    assert coder.decode_joined(ids, norm) == text
    assert sum(asked) < n / 10


def test_words_are_merged_part_by_part(monkeypatch):
    """Words of known parts need no merging of their own, and their pieces stay the library's."""
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    coder = pieces.Pieces(model_bytes())
    words = ["stone", "Water", "naïve", "don't", "x1y2", "a" * 40, "日本", "☃"]
    for text in (a + gap + b for a in words for b in words for gap in (".\n", "###", ",", "\n\n", "▁")):
        assert coder.encode(text.encode())[0] == ",".join(map(str, library.encode(text)))
    merged = []
    merge = coder.part_ids
    monkeypatch.setattr(coder.parts, "make", lambda part: merged.append(part) or merge(part))
    assert coder.encode("\n".join(words * 2).encode())[1] and not merged


def test_spans_cover_the_source(docs):
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    coder = pieces.load(model_bytes())
    for r in pieces.encode_texts(docs, model_bytes()).collect():
        assert r.begins[1:] == r.ends[:-1]
        if r.ids:
            assert r.begins[0] == 0 and r.ends[-1] == len(text[r.doc_id])
        for i, b, e in zip(r.ids, r.begins, r.ends):
            if coder.kinds[i] == pieces.NORMAL:
                assert text[r.doc_id][b:e].decode().replace(" ", pieces.SPACE) == \
                    coder.pieces[i] or b == 0
    back = pieces.decode_ids(pieces.encode_texts(docs, model_bytes()), model_bytes(), "doc_id", "ids").collect()
    assert all(r.text.encode() == text[r.key] for r in back)


def test_character_map_equals_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    samples = ["  ｱﾞ ① ½ Ａ　Ｂ  ", "ﬁ x", "", " ", "a  b ", "\tx\n", "é́ é", "▁ ▁"]
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        for trim in (False, True):
            proto.normalizer_spec.add_dummy_prefix = True
            proto.normalizer_spec.escape_whitespaces = True
            proto.normalizer_spec.remove_extra_whitespaces = trim
            library = sentencepiece.SentencePieceNormalizer(model_proto=proto.SerializeToString())
            mine = pieces.Normaliser(proto.normalizer_spec)
            for s in samples:
                flat, places = mine(s.encode())
                assert flat.decode() == library.normalize(s)
                assert len(places) == len(flat) + 1 and (np.diff(places) >= 0).all()


# --- packing -----------------------------------------------------------------------------------

def test_packing(docs, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(word_spec())
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in by_id(rows)}
    got = packing.packed(docs, word_spec(), window=64, stretch=64 * 40).collect()
    copies = Counter(i for i, _ in by_id(rows))
    starts = defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        starts[r.doc_id] += range(r.start, r.start + r.length)
    for i, own in starts.items():
        assert sorted(own) == sorted(list(range(len(ids[i]))) * copies[i])
    assert starts.keys() == ids.keys()
    padding = 0
    for _, own in _grouped(got, lambda r: r.sequence_id).items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        n = sum(r.length for r in own)
        assert n <= 64
        padding += 0 if n & (n - 1) == 0 else 64 - n
    assert padding == 0


def _grouped(items, by):
    out = defaultdict(list)
    for x in items:
        out[by(x)].append(x)
    return out


def test_windows_keep_the_mixture():
    lengths = np.array([70_000, 20_000, 9_000, 1_000, 3])
    given = packing.fill(lengths, 512)
    assert (given.sum(axis=1) == 512).all() and (given.sum(axis=0) <= lengths).all()
    assert np.abs(given - 512 * lengths / lengths.sum()).max() < 3


# --- language model ----------------------------------------------------------------------------

def brute_scores(texts, order, top=lm.TOP, half=lm.HALF, held=lambda i: zlib.crc32(str(i).encode()) % 10 == 0):
    counts = [Counter() for _ in range(order)]
    tokens = [(i, t.encode().lower().split() + [None]) for i, t in texts]
    for i, w in tokens:
        if i is not None and not held(i):
            w = ["<s>", *w]
            for m in range(order):
                counts[m].update(tuple(w[k:k + m + 1]) for k in range(len(w) - m))
    starts = counts[0].pop(("<s>",), 0)
    n, v = sum(counts[0].values()), len(counts[0])
    once, twice = (sum(c == k for c in counts[0].values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice) if once and twice else 0.5, 0.1), 0.9)
    counts[0]["<s>",] = starts

    def p(context, w):
        if not context:
            c = counts[0][w,]
            return (c - d) / n if c else d * v / n
        seen = counts[len(context) - 1][context]
        share = top * seen / (seen + half)
        own = counts[len(context)][context + (w,)] / seen if seen else 0
        return share * own + (1 - share) * p(context[1:], w)

    out = []
    for i, w in tokens:
        line = ["<s>", *w]
        base = sum(math.log10((counts[0][x,] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        full = sum(math.log10(p(tuple(line[max(0, k - order + 1):k]), line[k])) for k in range(1, len(line)))
        out.append((i, len(w), sum(counts[0][x,] > 0 for x in w), n, base, full))
    return out


def test_language_model(docs, rows):
    from sitelens.llm.common import fold
    for order in (2, 3):
        got = sorted((tuple(r) for r in lm.scored(docs, fold("doc_id", 10) != 0, order=order).collect()), key=key)
        want = sorted(brute_scores(by_id(rows), order), key=key)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)


# --- top-k search ------------------------------------------------------------------------------

def test_top_products(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(size=8) * (1 + i % 3)]) for i in range(400)]
    vectors += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7),
                (700, []), (750, [0.5]), (None, [1.0] * 8), (50, vectors[50][1]), (401, vectors[7][1])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id bigint, embedding array<float>, x int")
    got = sorted(tuple(x) for x in voronoi.top_products(
        df, F.pmod("vec_id", F.lit(50)) == 0, pivots=9, block=32).collect())
    good = [(i, np.floor(np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))) * 256).astype(int))
            for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in {(i, tuple(v)): (i, v) for i, v in good if i % 50 == 0}.values():
        best = sorted((-int(x @ y), j) for j, y in good if j != q)[:5]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi.top_products(df.limit(0), F.lit(True)).collect() == []


# --- archives ----------------------------------------------------------------------------------

def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "ROUTES", 3)
    big = "<p>" + "payload " * 40
    pages = [(i, f"http://www.h{i % 3}.example.org:80/p{i}?q={i}", [big, f"unique {i} " * 20, "small"][i % 3])
             for i in range(60)]
    pages += [(90, None, None), (91, "not a url\t\n", ""), (92, "http://h1.example.org/p1?q=1", big + "é日\r\n\r\nWARC/1.1\r\n"),
              (93, "http://hot/", big), (94, "http://hot/", big), (94, "http://hot/", big), (None, "http://x/", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, key int")
    got = Counter(tuple(r) for r in warc.archive_round_trip(df).collect())
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        refers = first[h] if i is not None and h in first and first[h] < i else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert got == want
    folder = f"{warc.shared_root(spark)}/archives-test-{random.random()}"
    index = warc.build_index(warc.write_archives(warc.with_references(df), folder))
    asked = spark.createDataFrame([("hot)/",), ("org,example,h1)/p1?q=1",), ("absent)/",)], "key string")
    found = warc.lookup(asked, index).collect()
    assert Counter(r.key.split(" ")[0] for r in found) == {"hot)/": 3, "org,example,h1)/p1?q=1": 2}
    assert warc.archive_round_trip(df.limit(0)).collect() == []


# --- learnt filters ----------------------------------------------------------------------------

def labelled(spark, n=240):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(30, 90))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(6):
                own[r.randrange(len(own))] = r.choice(["venomous", "hateful", "grotesque"])
        docs.append((i, " ".join(w.upper() + "!!" for w in own) if bad else " ".join(own), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "quiet words", "en", "s", 0)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int"))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, train=F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(240) if i % 4 == 2]
    right = sum(got[i].predicted == (i % 5 == 0) for i in held)
    assert right >= 0.93 * len(held)
    assert got[240].predicted == got[241].predicted == 0
    left = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}
    empty = toxicity.fit(docs.limit(0), labels)
    assert [r.score for r in toxicity.scored(docs, empty).collect()] == [0.0] * docs.count()


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.resampled(docs, labels).collect()}
    assert len(got) == docs.count()
    good = [i for i in range(240) if i % 7]
    assert sum(got[i].selected for i in good) >= 0.97 * len(good)
    assert sum(got[i].selected for i in range(0, 240, 7)) <= 6
    left = {r.doc_id for r in quality.keep_selected(docs, labels).collect()}
    assert left == {i for i, r in got.items() if r.selected}
    everything = quality.resampled(docs, labels.where("quality = 1"))
    assert everything.where("selected").count() == docs.count()


def test_kth_largest(spark):
    r = random.Random(2)
    values = [r.choice([1.5, r.gauss(0, 1e6), r.gauss(0, 1)]) for _ in range(3000)] + [float("-1e300")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1500, 3001):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


# --- empty tables ------------------------------------------------------------------------------

def test_empty_tables(nothing, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for df in (fingerprints.fingerprint_edits(nothing), suffixes.digests(nothing), suffixes.deduplicated(nothing),
               jaccard.linked(nothing), jaccard.keep_one(nothing), lm.scored(nothing, F.lit(True)),
               pieces.encoding_digests(nothing, model_bytes()), packing.packed(nothing, word_spec()),
               quality.resampled(nothing, labels), quality.keep_selected(nothing, labels),
               toxicity.scored(nothing, toxicity.fit(nothing, labels)),
               toxicity.keep_clean(nothing, toxicity.Model())):
        assert df.collect() == []


def test_toxicity_of_several_languages(spark):
    """Marks are whole words in one language and a family of beginnings, each word rare, in the others."""
    r = random.Random(7)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "fr": "eux é ê que ment aux elle ou".split(),
                 "de": "lich ch ein au tz sch keit er".split(), "es": "mente ción bo co ado rr í ñ".split()}
    families = {"en": None, "fr": "vilê", "de": "schmuz", "es": "torpe"}
    langs = list(syllables)
    docs, labels = [], []
    for i in range(1200):
        lang, toxic = langs[i % 4], i % 5 == 0
        own = ["".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(r.randint(30, 90))]
        if toxic:
            for _ in range(4):
                mark = r.choice(["venomous", "hateful", "grotesque"]) if families[lang] is None else \
                    families[lang] + "".join(r.choices(syllables[lang], k=2))
                own[r.randrange(len(own))] = mark
        docs.append((i, " ".join(own), lang))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
                         train=F.col("doc_id") % 3 != 1)
    got = toxicity.scored(docs, model).where("doc_id % 3 = 1").collect()
    for k, lang in enumerate(langs):
        toxic = [x.predicted for x in got if x.doc_id % 4 == k and x.doc_id % 5 == 0]
        assert sum(toxic) >= 0.9 * len(toxic), lang
    clean = [x.predicted for x in got if x.doc_id % 5]
    assert sum(clean) <= 0.03 * len(clean)


def test_toxicity_windows_cover_every_word():
    for text in ("", " ", "a", "one two", "x" * 500 + " tail", "y" * toxicity.WINDOW, "é" * 300, "word " * 50):
        joined = b"".join(b"".join(w.split()) for w in toxicity.windows(text))
        assert joined == b"".join(toxicity.marked_words(text))
