"""Small tables with the awkward rows every operator must stand."""

import pytest

from evidra.llm.common import bounded_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, token string, _hash string, key string, n int"


def sentence(i: int, n: int = 60) -> str:
    return " ".join(f"w{i}x{j}," if j % 9 == 8 else f"w{i}x{j}" for j in range(n)) + "."


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, blanks, copies, near copies, a long text, repeated rows, ids twice."""
    base = sentence(1)
    near = base.replace("w1x30", "changed")
    return [
        (1, base), (2, base), (3, near), (4, sentence(2)), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "only four words here"),
        (9, "only four words here"), (10, "ONLY Four words HERE"), (11, "one"), (12, "\x00 é ß 中文 😀 don't ２３ ² x" * 5), (13, sentence(3, 12_000)),
        (14, "same words " * 40), (15, "same words " * 41), (4, sentence(2)), (16, sentence(4)), (16, sentence(5)),
        (None, sentence(6)), (None, sentence(7)), (None, None), (17, "a b c　d <|endoftext|> e  f   g\n\n h \n i"), (18, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    bounded_batches(spark)
    full = [(i, t, None if i is None or i % 3 else "en", "s", len(t or ""), 7, "t", "h", "k", 1) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
