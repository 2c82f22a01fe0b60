import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 5, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        if i % 4 == 3:  # a near copy
            words = out[rng.randrange(len(out))].split(" ")
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "\n", ".", "#"]) for _ in range(rng.randint(1, 150))))
    return out


@pytest.fixture(scope="session")
def rows():
    """Plain and odd rows: nulls everywhere, empty, blank and very long texts, ties, repeated rows."""
    made = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "é")[i % 4], len(t)) for i, t in enumerate(texts())]
    odd = [(None, None, None, None, None), (None, "some words without an id " * 4, "en", "a", 9), (100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \t\n \r", "de", None, 5), (103, "one two three", "en", "b", 13), (104, "word " * 30000, "en", "a", 150000), (105, "x" * 40000, "en", "a", 40000)]
    return made + odd + [made[7], made[7], odd[5], odd[1]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("row", "pos", "keep", "size", "g", "n", "c", "a", "b", "_id", "_row", "_keep", "_n", "key", "shard", "length", "_part", "edits_", "digest", "_gone", "_epochs", "target", "_hash", "type", "kept")})


@pytest.fixture(scope="session")
def labels(spark):
    out = [(i, i % 5 != 0, i % 6 == 0) for i in range(0, 60)]
    return spark.createDataFrame([(i, int(q), int(t)) for i, q, t in out] + [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
