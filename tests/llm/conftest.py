import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_links long, component_id string, node string, tokens string"


def made(rows):
    """Rows with columns whose names clash with the operators' own."""
    return [(i, t, lang, src, None if t is None else len(t), 5, "x", "y", "z") for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    base, other = text(120), text(60)
    edited = base.split()
    edited[60] = "CHANGED"
    half = base.split()
    half[:40] = text(40).split()
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(edited), "en", None), (4, base.upper(), None, "b"), (5, " ".join(half), "en", "b"),
        (6, None, "en", "a"), (7, "", "de", "a"), (8, " \t\n", "de", "b"), (9, "one two", "de", "b"), (10, "one  two", "de", "b"),
        (None, other, "de", "c"), (12, other, None, "c"), (12, other, None, "c"), (13, text(4000), "fr", "c"), (14, "żółć 漢字 😀 naïve", "fr", "c"),
        (15, "x" * 5000, "fr", "c"), (None, None, None, None), (17, text(30), "fr", "a"), (18, "a@b.cd 10.0.0.1; 4111 1111 1111 1111; +1 (415) 555-0000", "en", "a"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
