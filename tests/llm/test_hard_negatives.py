"""Hard negatives: exact against brute force, with pruning that is counted."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import hard_negatives as H

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5, positives=5, negatives=5, percent=80):
    fine = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine[i, label, tuple(math.floor(256 * x) for x in v)] = None
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, u in fine:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(u, v, strict=True)), j, other, v) for j, other, v in fine if len(v) == len(u)]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        own = [r for r in scored if r[2] == label and (r[1], r[3]) != (i, u)][:positives]
        for p in own:
            fits = [r for r in scored if r[2] != label and percent * p[0] <= 100 * r[0] <= 100 * p[0]]
            out += [(i, p[1], k + 1, n[1], p[0], n[0]) for k, n in enumerate(fits[:negatives])]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, KINDS)
    got = H.mined(df, F.col("vec_id") % 5 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


def clustered(rng, n, dim, spread=0.15, kinds=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(kinds)]
    return [(i, [x + rng.gauss(0, spread) for x in centres[rng.randrange(kinds)]], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("seed", "block"), [(0, None), (1, 40), (2, 100)])
def test_against_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = clustered(rng, 500, 6)
    rows += [(1000 + i, [float(rng.randint(-2, 2)) / 256 for _ in range(6)], rng.randrange(2)) for i in range(150)]  # many ties
    want = brute(rows)
    assert len(want) > 500
    assert found(spark, rows, block=block) == want


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = clustered(rng, 80, 4)
    same = [0.5, 0.25, -0.5, 1.0]
    rows += [(100 + i, same, i % 2) for i in range(60)]  # equal vectors: far more than results hold
    rows += [rows[3], rows[90], rows[90], (5, same, 0), (5, [0.0] * 4, 0), (10, [0.0] * 4, 1), (None, same, 1), (None, same, 0)]
    rows += [(200, None, 1), (205, same, None), (210, [1.0, None, 1.0, 1.0], 1), (215, [float("nan")] * 4, 1), (220, [float("inf")] * 4, 1), (225, [], 1)]
    rows += [(300 + i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(40)]
    assert found(spark, rows, block=16) == brute(rows)


def test_more_anchors_of_one_vector_than_rows_kept(spark):
    rows = [(5 * i, [1.0, 0.5], 1) for i in range(300)] + [(i, [0.9, 0.4 + i / 1000], 2) for i in range(1, 60, 2)]
    assert found(spark, rows) == brute(rows)


def test_crowded_blocks_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(H, "CROWD", 3)
    monkeypatch.setattr(H, "VISITORS", 2)
    rows = clustered(random.Random(6), 300, 5)
    assert found(spark, rows, block=30) == brute(rows)


def test_other_numbers(spark):
    rows = clustered(random.Random(7), 200, 5)
    assert found(spark, rows, positives=2, negatives=7, percent=60) == brute(rows, positives=2, negatives=7, percent=60)


def test_ranges_eliminate_subtrees():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 200
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 10)
    norm = float(np.sqrt((x * x).sum(axis=1).max()))
    block = H.Block(np.arange(4000), np.zeros(4000, np.int64), x, norm)
    u, seen = x[:50], np.zeros(50, np.int64)
    scores = u @ x.T
    low, high = np.sort(scores, axis=1)[:, -60].astype(float), scores.max(axis=1).astype(float)

    def take(who, rows, got):
        np.add.at(seen, who, ((got >= low[who][:, None]) & (got <= high[who][:, None])).sum(axis=1))

    block.search(u, *H.annuli(u, low, high, norm), take)
    assert (seen == (scores >= low[:, None]).sum(axis=1)).all()  # nothing within the windows is missed
    assert block.compared < 0.25 * scores.size


def test_windows_are_annuli_whatever_the_norms():
    rng = np.random.default_rng(9)
    x, u = np.floor(rng.normal(size=(500, 5)) * 100), np.floor(rng.normal(size=(20, 5)) * 300)
    norm = float(np.sqrt((x * x).sum(axis=1).max()))
    d = H.distances(np.concatenate([u, np.zeros((20, 1))], axis=1), H.raised(x, norm))
    score = u @ x.T
    for q in (10, 250, 490):
        low, high = np.sort(score, axis=1)[:, q - 5].copy(), np.sort(score, axis=1)[:, q].copy()
        near, far = H.annuli(u, low, high, norm)
        inside = (score >= low[:, None]) & (score <= high[:, None])
        assert ((d >= near[:, None]) & (d <= far[:, None]))[inside].all()


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], KINDS)
    assert H.mined(none, F.col("vec_id") % 5 == 0).count() == 0
    rows = clustered(random.Random(10), 40, 3)
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit("x") for c in ("key", "block", "score", "dim", "id", "u", "place")})
    assert sorted(map(tuple, H.mined(df, F.col("vec_id") % 5 == 0).collect()), key=repr) == brute(rows)
    assert H.mined(df, F.lit(False)).count() == 0
