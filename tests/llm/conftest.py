import random

import pytest
from pyspark.sql import types as T

# Extra columns whose names the operators use themselves.
CLASH = ["block", "bucket", "row", "class", "n", "kept", "words", "b", "part", "cell", "key", "half"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in CLASH])


def texts():
    """Prose, copies, near copies, shared passages, junk, empties, nulls, one very long text."""
    r = random.Random(7)
    syllables = "an the re ion en ti ha che éa lo mi ra so du".split()

    def prose(n):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    base = [prose(r.randint(5, 120)) for _ in range(24)]
    passage = prose(60)
    out = list(base)
    out += [base[3], base[3], base[5]]  # copies
    for t in base[:6]:  # near copies: one word changed
        words = t.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    long = prose(400).split()
    for k in range(8):  # a chain of near copies
        out.append(" ".join(long[k * 6:k * 6 + 200]))
    out += [prose(20) + " " + passage + " " + prose(20) for _ in range(5)]
    out += [base[7] + " idiot loser scum " + base[8] for _ in range(3)]
    out += ["", None, "   \n\t ", "one", "one", "two words", "a b c d", "a b c d e", "x" * 300, "ab" * 200,
            "é" * 60, "日本語" * 40, "A\x1cB <|endoftext|> It's 12", " ".join(["same"] * 80), prose(6000)]
    return out


@pytest.fixture(scope="session")
def rows():
    return [(i, t, "en", [None, "hot", "hot", "rare"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The fixture with clashing columns, a null id and a repeated row."""
    more = [*rows, (None, "no id but text " * 20, "en", "hot", 300), rows[10]]
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in more], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from sitelens.llm.common import ship
    ship(spark)
