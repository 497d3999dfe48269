import random

import pytest

SMALL = "/root/testdata/sf0.001"
WORDS = "alder birch cedar dogwood elder fir gorse hazel ivy juniper larch maple oak pine rowan spruce thorn walnut willow yew".split()


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Null keys and texts, empty and very long texts, ties, repeated rows and columns whose names the operators use themselves."""
    long = prose(60_000, 1)
    rows = [(1, "a plain text of some words, said twice."), (1, "a plain text of some words, said twice."), (2, None), (None, "no key here"), (None, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "ß İ ǅ 漢字 \U0001f600 ñ"), (8, "x"), (9, "...!!!")]
    return [(k, t, "en", None, i, "u", 1, "r", 2, "b") for i, (k, t) in enumerate(rows)]


ODD = "doc_id bigint, text string, lang string, n_chars bigint, uid int, h string, size int, grp string, chunk int, `row.x` string"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD)
