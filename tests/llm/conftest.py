import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or add themselves.
EXTRA = ["word", "fp", "n_lines", "key", "hits", "_id", "_text", "c", "score", "length", "_row", "node", "kept"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")) + str(r.randint(0, 60)) for _ in range(n)) + "."


def odd_rows():
    rows = [
        (None, None, None, None, None),
        (None, "a text without an id. " * 20, "en", None, 1),
        (1, None, "en", "s", 0),
        (2, "", "fr", "s", 0),
        (3, " \t\n\x0b\x0c\r ", None, "s", 6),
        (4, "1234 5678 ###", "en", "s", 12),
        (5, "Ünïcödé ÀÉ 日本語 😀 it's <|endoftext|> O'Neil's", "en", "s", 40),
        (6, "\n\n\n", "en", "s", 3),
        (7, prose(300, 1), "en", "s", 1),
        (7, prose(300, 1), "en", "s", 1),
        (8, prose(300, 1), "en", "s", 1),
        (9, prose(300, 1).replace("alpha1 ", "beta9 ", 1), "de", "s", 1),
        (10, prose(30_000, 2), "en", "s", 1),
        (11, "x" * 50_000, "en", "s", 1),
        (12, "the same line\n" * 40 + "another one", "en", "s", 1),
    ]
    return rows + [(100 + k, f"Shared line of many documents\nown line {k}. {prose(60, 50 + k)}", "en" if k % 2 else "de", "s", 1) for k in range(24)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
