import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def docs(spark):
    """Documents with null and empty fields, copies, near copies, shared passages, hot sources and a column that clashes with names inside operators."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, base = words(60), words(90)
    rows = [(i, words(rng.randint(0, 120)), "en", f"s{i % 3}" if i % 2 else "s0") for i in range(40)]
    rows += [(100 + i, base, "en", "s0") for i in range(6)]
    rows += [(200 + i, base.replace("w1", "v1", i + 1), "fr", "s1") for i in range(4)]
    rows += [(300 + i, f"{words(20)}\n{passage}\t{words(10)}", "en", None) for i in range(5)]
    rows += [(400, None, "en", "s1"), (401, "", None, "s1"), (402, " \n ", "en", None), (403, "one", "en", "s4"), (None, words(50), "en", "s4"), (405, "w " * 3000, "en", "s4"), (406, "a b c d e f g h i " * 5 + words(30), "en", "s0")]
    rows += [(500, "same row here", "en", "s0")] * 3
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.filter("false")


def by_id(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda t: tuple((x is not None, x) for x in t))
