"""Small tables that have every awkward case."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, r string"


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated ids and rows, odd characters."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "été", "ß", "omega,", "The", "end.", "x1", "日本", "zeta"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    out = [(i, text(rng.randint(1, 80)), "en", f"s{i % 4}") for i in range(40)]
    out += [(100 + i, base, "en", "s0") for i in range(6)]
    out += [(110, base.replace(" ", "\n", 7), "fr", "s1"), (111, base.upper(), "fr", "s1"), (112, base + " tail", "fr", "s1")]
    out += [(120 + i, f"{text(10)} {passage} {text(15)}", "en", "s2") for i in range(5)]
    out += [(130, None, None, None), (131, "", "en", "s9"), (132, " \t\n ", "en", None), (133, "one", "en", "s3"), (None, base, "en", "s0"), (None, None, None, None)]
    out += [(140, text(30), "en", "s1")] * 2 + [(141, "same id, one text " + text(20), "en", "s1"), (141, "same id, other text " + text(20), "en", "s1")]
    out += [(150, text(6000), "en", "s0"), (151, "nospace" * 3000, "en", "s0"), (152, "Released under the MIT License.", "en", "s0")]
    out += [(153, "Apache License, Version 2.0 under the mit license CC-BY-NC", "en", "s0"), (154, "a\x0bb\x0cc d e \U0001f600 f", "en", "s0")]
    rng.shuffle(out)
    return [(*r, len(r[1]) if r[1] is not None else None, 0.5, "clash") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    data = [(i, 1 if i % 3 else 0, 1 if i % 4 == 0 else 0) for i in range(40)]
    data += [(None, 1, 1), (5, None, None), (7, 0, 1), (7, 0, 1), (999, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
