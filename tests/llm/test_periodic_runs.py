"""Periodic runs: exact against brute force, appended at once or word by word."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from recallspark.llm import periodic_runs as P
from recallspark.llm.queries import repeated_words


def brute(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def made(rng, n):
    """Words of few or many kinds with planted repetitions and breaks in them."""
    w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 30 else 0):
        at = rng.randrange(n)
        p = rng.randint(1, (n - at) // 3 + 1)
        for i in range(rng.randint(0, n - at)):
            w[at + i] = w[at + i % p]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = 99
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_exact(seed):
    rng = random.Random(seed)
    cases = [made(rng, rng.randint(0, 400)) for _ in range(150)]
    arrays, want = [np.array(w, np.int64) for w in cases], [brute(w) for w in cases]
    assert sum(map(len, want)) > 20
    assert [P.runs_of(x) for x in arrays] == want == P.runs_of_many(arrays)
    for x, runs in zip(arrays, want, strict=True):
        squares, i = P.Squares(), 0
        while i < len(x):
            n = rng.choice([1, 1, 2, 5, 40])
            squares.append(x[i : i + n])
            i += n
            if rng.random() < 0.02:  # what is known at any time is what the words so far have
                assert squares.runs() == brute(x[: min(i, len(x))].tolist())
        assert squares.runs() == runs


def test_texts_of_one_word_cost_little():
    for n in (10, 24, 200_000):
        assert P.runs_of(np.zeros(n, np.int64)) == ([(0, n, 1)] if n >= 24 else [])
    a, b = "0", "01"
    while len(b) < 3000:
        a, b = b, b + a
    w = [int(c) for c in b]
    assert P.runs_of(np.array(w)) == brute(w)


def test_equal_hashes_are_not_enough():
    """The sequence of Thue and Morse gives equal sums modulo 2**64; it has no cube."""
    w = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])
    assert P.runs_of(w) == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    places = repeated_words(doc_id, len(words))
    words = words if places is None else [words[i] for i in places]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_table_against_brute_force(spark, rows):
    rng = random.Random(9)
    more = [(i, " ".join(f"w{x}" for x in made(rng, rng.randint(0, 200)))) for i in range(100, 260)]
    tie = " ".join(["a b"] * 20 + ["x y z u v"] + ["c d"] * 20)
    table = [(i, t) for i, t, *_ in rows] + more + [(300, tie), (301, "la " * 5000), (302, "\x0b a b \x1f" * 30)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = P.summarised(P.periodic_runs(df, repeated_words))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((expected(i, t) for i, t in table), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[1] > 0 for r in want) > 30


def test_long_text_in_slices(spark):
    words = [f"w{i % 5000}" for i in range(20_000)] + ["end"] * 30
    text = "  ".join(words)
    assert [w for part in P.words_of(text.encode(), 1000) for w in part] == [w.encode() for w in words]
    row = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 20_000, 5000), (20_000, 30, 1)]
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words[:5000] + ["end"]).encode()).hexdigest()


def test_empty_table_and_clashing_names(spark, empty, docs):
    assert P.summarised(P.periodic_runs(empty)).count() == 0
    clash = docs.select("doc_id", "text", docs.n_chars.alias("runs"), docs.source.alias("start"), docs.lang.alias("b"))
    assert P.summarised(P.periodic_runs(clash)).count() == docs.count()
