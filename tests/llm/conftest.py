import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, _key string, n_words string, copies int, _id string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows, empty_ok=True):
        full = [(i, t, lang, source, "x", "y", 7, "z") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 8))) for _ in range(300)]
    some = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, base = some(60), some(220)
    near = base.split(" ")
    near[30] = "changed"
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "xx", "a"),
        (4, base, "en", "a"),
        (5, base, "en", "b"),
        (6, " ".join(near), "de", "b"),
        (None, some(40) + " " + passage + " " + some(40), "fr", "c"),
        (8, some(10) + "\n" + passage + "\x0b" + some(90), "es", None),
        (9, "one word repeated " * 3000, "en", "a"),
        (10, "été Ünïcode 日本語 " + some(30), "fr", "c"),
        (11, some(20), "en", "a"),
        (11, some(21), "en", "a"),
        (12, some(80), "en", "a"),
        (12, None, "en", "a"),
    ]
    rows += [(20 + i, some(r.randint(1, 150)), "en", "ab"[i % 2]) for i in range(40)]
    rows += [rows[12], rows[12]]
    return rows


@pytest.fixture
def collect():
    def run(df, *columns):
        return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

    return run
