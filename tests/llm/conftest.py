import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_links long"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty texts, ties, repeats, one word, white space only, and a long text."""
    rng = random.Random(5)
    words = [rng.choice("bcdfg") + "".join(rng.choice("aeioulmnr") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(90)
    near = base.split()
    near[40] = "changed"
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "One"), (8, "a b c d"), (9, text(50) + " " + passage + " " + text(40)),
        (10, passage + "\n" + text(10)), (11, "Ünïcode ßtraße 日本語 " + text(30)), (12, text(6000)), (12, text(20)), (None, base), (None, text(30)), (13, "again and again and again and again and again\n" * 40),
        (14, "x" * 1500), (15, "line one here\nline one here\nline two\n" + text(30)), (16, base), (17, "mail a.b@example.com card 4111 1111 1111 1111 ip 10.20.30.40 on 2021-02-03"),
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with what operators return."""
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None, len(t or ""), 0.5, k) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
