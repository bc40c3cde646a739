"""The pipeline stage by stage, each against brute force on what the stage before it kept."""
import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import quality, toxicity
from test_operators_llm import brute_components, word_spec


def tables(spark, folder):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(70))
    docs, labels = [], []
    for i in range(260):
        own = [r.choice(words) for _ in range(r.randint(40, 120))]
        if i % 5 == 0:
            for _ in range(6):
                own[r.randrange(len(own))] = r.choice(["venomous", "hateful", "grotesque"])
        text = " ".join(w.upper() + "!!" for w in own) if i % 7 == 0 else " ".join(own)
        if i % 11 == 1:
            text += " " + passage
        docs.append([i, text])
        if i % 2:
            labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    for i in range(0, 60, 3):  # copies and near copies
        words_ = docs[i][1].split()
        if i % 2:
            words_[len(words_) // 2] = "changed"
        docs.append([300 + i, " ".join(words_)])
    docs += [[400, ""], [401, None], [402, "short"]]
    rows = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    columns = before.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == \
        ["toxicity", "quality", "ngram_jaccard", "suffix_array", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        given = {r.doc_id: r for r in before.collect()}
        got = {r.doc_id: r for r in after.collect()} if name != "packing" else None
        if name == "toxicity":
            model = toxicity.fit(before, labels)
            assert got.keys() == {i for i, r in given.items() if toxicity.score(model, r.text or "") < toxicity.THRESHOLD}
            assert sum(i % 5 == 0 for i in got if i < 260) <= 6 and sum(i % 5 != 0 for i in got if i < 260) >= 195
        elif name == "quality":
            ratio, share = quality.fit(before, labels)
            keys = {}
            for i, r in given.items():
                data = (r.text or "").encode()
                keys[i] = quality._weights(ratio, data, np.array([0, len(data)]), [i])[1][0]
            kept = sorted(keys, key=lambda i: -keys[i])[:int(np.ceil(share * len(keys) - 1e-9))]
            assert got.keys() == set(kept)
        elif name == "ngram_jaccard":
            assert got.keys() == {i for i, _, c in brute_components([(i, r.text or "") for i, r in given.items()]) if c == i}
            assert len(got) < len(given)
        elif name == "suffix_array":
            assert {i: r.text for i, r in got.items()} == cut_by_hand({i: r.text for i, r in given.items()})
            assert any(got[i].text != given[i].text for i in got)
            assert all(r.text is None or r.n_chars == len(r.text) for r in got.values())
        if name != "packing":
            assert after.columns == columns
            if name != "suffix_array":
                assert all(given[i] == r for i, r in got.items())
        else:
            held = defaultdict(int)
            for r in after.collect():
                held[r.doc_id] += r.length
            from tokenizers import Tokenizer
            library = Tokenizer.from_str(word_spec())
            assert held == {i: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
                            for i, r in given.items()}
        before = after
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0] == sum(held.values())


def cut_by_hand(texts, width=50):
    """Texts less every byte of a 50-byte string that a smaller id has; broken characters go."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(data):
        for s in range(len(data[i]) - width + 1):
            first.setdefault(data[i][s:s + width], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s:s + width]] < i:
                gone[s:s + width] = b"\1" * width
        out[i] = None if texts[i] is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out
