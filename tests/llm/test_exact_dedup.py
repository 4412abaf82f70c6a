"""Exact dedup: fingerprints against their definition, classes against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recallspark.llm import exact_dedup as E

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    flat = [(i, WHITE.sub(" ", t or "")) for i, t in rows]
    out = []
    for i, t in flat:
        ids = [j for j, u in flat if u == t]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_moduli_are_prime_and_products_fit():
    for p in E.PRIMES:
        assert p % 2 and all(p % q for q in range(3, 46342, 2)) and p * p < 2**63
    assert 255 * max(E.PRIMES) * E.BLOCK < 2**53


def test_fingerprints_compose():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.choice(b" \t\nab\xc5\x82\x00") for _ in range(rng.randint(0, 3000)))
        value = tuple(sum(c * pow(r, len(text) - 1 - i, p) for i, c in enumerate(text)) % p for r, p in zip(E.BASES, E.PRIMES, strict=True))
        cut = rng.randint(0, len(text))
        a, b, whole = E.of_pieces([text[:cut], text[cut:], text])
        assert whole == E.composed(a, b) == (len(text), value)
        assert E.composed(E.EMPTY, whole) == whole == E.composed(whole, E.EMPTY)


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_white_space_runs_across_pieces(piece):
    rng = random.Random(2)
    for _ in range(500):
        text = bytes(rng.choice(b" \t\n\x0b\x0c\rab\x1f") for _ in range(rng.randint(0, 30)))
        assert b"".join(E.normalised(text, piece)) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text)


def test_streaming_comparison():
    big = b"word \t" * 60_000
    assert E.same(big, b"word  " * 60_000) and not E.same(big, b"word " * 59_999 + b"work ")
    assert not E.same(b"a", b"a ") and not E.same(b"", b" ") and E.same(b"\n", b" \t")


def test_against_brute_force(spark, docs, rows):
    got = E.duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute([(i, t) for i, t, *_ in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == [(i, k, n, i == k, s) for i, k, n, _, s in want]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_texts_that_only_share_a_fingerprint(spark, docs, rows, bits):
    """With few bits most classes hold different texts, which go apart."""
    got = E.classes(docs, mark_bits=bits).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, k, n, s) for i, k, n, _, s in brute([(i, t) for i, t, *_ in rows])), key=repr)


def test_long_documents_are_hashed_in_pieces(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "漢字"]) for _ in range(40_000))
    texts = [(1, long), (2, long.replace(" ", "\n \t")), (3, long[:-1]), (4, long), (4, long), (5, "x" * 200_000), (6, "x" * 199_999)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, E.duplicates(df).collect()), key=repr) == brute(texts)
    marks = {r.doc_id: r.mark for r in E.fingerprinted(df).collect()}
    for i, t in texts:
        flat = WHITE.sub(" ", t).encode()
        found = E.EMPTY
        for s in range(0, len(flat), 1000):
            found = E.composed(found, E.of_pieces([flat[s : s + 1000]])[0])
        assert marks[i] == E._packed(found)


def test_a_class_of_a_third_of_all_rows(spark):
    texts = [(i, "the same  text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    got = E.duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts)


def test_one_of_each(spark, docs, rows):
    got = E.deduplicated(docs)
    assert got.columns == docs.columns
    flat = [WHITE.sub(" ", t or "") for t in got.select("text").toPandas()["text"]]
    assert len(flat) == len(set(flat)) == len({WHITE.sub(" ", t or "") for _, t, *_ in rows})
    least = {r.keep_id for r in E.duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in got.collect()} == least


def test_empty_table_and_clashing_names(spark, empty):
    assert E.duplicates(empty).count() == E.deduplicated(empty).count() == 0
    df = spark.createDataFrame([(1, "a", 1, "m", 2), (2, "a", 1, "m", 2)], "doc_id long, text string, raw int, mark string, n int")
    assert E.duplicates(df).select(F.sum("group_size")).first()[0] == 4
    assert E.deduplicated(df).collect()[0].asDict() == {"doc_id": 1, "text": "a", "raw": 1, "mark": "m", "n": 2}
