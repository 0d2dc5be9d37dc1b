import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, n):
    return " ".join(rnd.choice(["The", "river", "stone", "of", "über", "maße", "1984", "quick", "fox", "ran", "home", "and", "é", "日本"]) + rnd.choice(["", ",", "", "."]) for _ in range(n))


def make_docs(seed=5, n=60):
    """Rows with nulls in every column, empty, blank and long texts, exact and near copies, repeated rows and ids."""
    rnd = random.Random(seed)
    rows = [(i, sentence(rnd, rnd.choice([1, 2, 5, 40, 60, 90, 200])), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None]), 1) for i in range(n)]
    base = sentence(rnd, 120).split()
    for k in range(25):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = f"w{rnd.randint(0, 99)}"
        rows.append((n + k, " ".join(copy), "en", "a", None))
    rows += [(200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, " \n\t ", None, None, 0), (None, sentence(rnd, 70), "en", "b", 3), (None, None, None, None, None),
             (203, "x " * 30000, "en", "a", 60000), (204, sentence(rnd, 8000), "de", "b", 1), (205, "same same\nsame same\n\nsame same\n", "en", "a", 2)]
    rows += [rows[3], rows[3], (4, "another text under a used id " * 15, "en", "a", 1), rows[-1]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="session")
def odd(docs):
    """The same documents with columns that operators might use themselves."""
    from pyspark.sql import functions as F
    names = ["row", "found", "verdict", "mix", "cls", "band", "bands", "sketch", "kept", "component_id", "size", "shard", "slot", "text_key", "_key", "_gone", "_rank", "_slice",
             "_block", "_lang", "_source", "ids", "part", "host", "job", "n_words", "base", "turns"]
    return docs.select("*", *[F.lit(f"{k}").alias(k) for k in names])
