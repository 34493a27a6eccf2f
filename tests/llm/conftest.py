import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = "fp node component_id size pattern target taken score predicted held_out h1 n_words kept found items starts n_hit part mask n good toxic digest is_first first doc row pos key keep at bits n_dropped"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING.split())


def rows(docs):
    return [(i, t, lang, source, len(t) if t is not None else None, *("x" for _ in CLASHING.split())) for i, t, lang, source in docs]


def edge_cases():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(120_000))
    plain = " ".join(rng.choice(words) for _ in range(300))
    return [
        (1, plain, "en", "a"), (2, plain, "en", "b"), (3, plain + " end", "fr", "a"), (3, plain + " end", "fr", "a"), (4, None, "en", "a"), (5, "", None, None), (6, " \t\n\x0b", "de", None),
        (7, long, "en", "c"), (None, plain, "en", "a"), (None, None, None, None), (8, "one", None, "b"), (9, "Ä ß 漢字 \U0001f600 é", "de", "b"), (10, "9 8 7 !!", "fr", "c"), (11, "x" * 100_000, "fr", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(edge_cases()), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    text = edge_cases()[0][1].split()
    items = [(1, " ".join(text[20:45])), (2, "one"), (3, None), (4, ""), (None, " ".join(text[50:62])), (5, "not there at all in any of these texts whatever it is"), (5, "漢字"), (10, " ".join(text[20:30]).upper())]
    return spark.createDataFrame(items, "item_id long, text string")
