import math

import numpy as np

from recallspark.llm import cover_tree as C


def brute(rows):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, label = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = rows[i][1], rows[j][1]
            if fine[i] and fine[j] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                n[i] += 1
                n[j] += 1
                a, b = label[i], label[j]
                label = [b if k == a else k for k in label]
    least = {}
    for k, (i, _) in zip(label, rows, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted(((i, c, least[k]) for (i, _), c, k in zip(rows, n, label, strict=True)), key=repr)


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for _ in range(12):
        base = rng.normal(size=6)
        out += [(base + rng.normal(size=6) * s).tolist() for s in (0.0, 0.01, 0.1, 0.3, 0.3, 1.0)]
    out += out[:9] + [None, [], [0.0] * 6, [float("nan")] * 6, [1.0, None] * 3, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(out))
    return [*rows, (3, out[3]), (None, out[5])]


def test_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, component_id int")
    for block in (20, 8192):
        got = C.near_duplicates(df, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert C.near_duplicates(df.limit(0)).count() == 0


def tree(x, weight=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return C.Tree(x, np.ones(len(x), np.int64) if weight is None else weight)


def test_levels_cover():
    t = tree(np.random.default_rng(4).normal(size=(300, 5)))
    below = None
    for r, level in zip(reversed(C.RADII), reversed(t.levels), strict=True):
        assert (level.radius <= 2 * r).all() and len(level.children) == (300 if below is None else len(below.centres))
        assert (np.linalg.norm(t.x - t.x[level.centres[level.node]], axis=1) <= level.radius[level.node] + 1e-7).all()
        assert below is None or set(level.centres) <= set(below.centres)  # nested
        below = level


def pairs_of(a, b, same):
    hit = a.x @ b.x.T >= 0.95
    if same:
        np.fill_diagonal(hit, False)
    return hit


def test_dual_counts_all_links_and_connects_no_others():
    rng = np.random.default_rng(6)
    near = lambda k, n, s: np.repeat(rng.normal(size=(k, 16)), n, axis=0) + rng.normal(size=(k * n, 16)) * s
    x = np.concatenate([near(5, 60, 0.02), near(5, 60, 0.15), near(20, 3, 0.25)])
    y = np.concatenate([x[::3] + rng.normal(size=x[::3].shape) * 0.01, rng.normal(size=(50, 16))])
    a, b = tree(x, rng.integers(1, 5, len(x))), tree(y, rng.integers(1, 5, len(y)))
    for p, q in ((a, a), (a, b)):
        found, hit = C.dual(p, q, 0.95), pairs_of(p, q, p is q)
        want = hit @ q.weight if p is q else np.concatenate([hit @ q.weight, p.weight @ hit])
        assert (found.weight == want).all()
        shift = 0 if p is q else len(p.x)
        label = C.roots(shift + len(q.x), np.concatenate(found.edges, axis=1))
        assert (label == C.roots(shift + len(q.x), np.stack(np.nonzero(hit)) + np.array([[0], [shift]]))).all()


def test_dense_groups_cost_their_nodes():
    rng = np.random.default_rng(1)
    t = tree(rng.normal(size=16) + rng.normal(size=(3000, 16)) * 0.01)
    found = C.dual(t, t, 0.95)
    assert (found.weight == 2999).all() and found.compared < 10


def test_unstructured_vectors_meet_no_pair_of_points():
    t = tree(np.random.default_rng(2).normal(size=(4000, 64)))
    found = C.dual(t, t, 0.95)
    tops = len(t.levels[0].centres)
    assert found.weight.sum() == 0 and found.compared <= tops * (tops + 2) // 2


def test_cells_prune_visits(spark):
    """Tight groups far apart: no vector visits another cell's block."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(8, 32)), 50, axis=0) + rng.normal(size=(400, 32)) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = C.near_duplicates(df, block=50).collect()
    assert len(got) == 400 and all(r.n_links == 49 and r.component_id == r.vec_id // 50 * 50 for r in got)


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-300, 1e-300]), (3, [1.0, -1.0]), (None, [3.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), None: (2, 1)}


def test_number_of_blocks_is_bounded(spark):
    """A vector is sent to no more blocks as the table grows, and singles stay singles."""
    n = [10_000, 200_000, 600_000, 1_500_000]
    assert [C.block_size(x, 64) for x in n[:2]] == [4096, 4167]
    assert max(-(-x // C.block_size(x, 64)) for x in n) <= C.BLOCKS
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[1::3] = x[::3] + np.float32(0.05) * rng.normal(size=(100, 8)).astype(np.float32)
    singles, doubles = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{k}>") for k in ("float", "double"))
    got = sorted(map(tuple, C.near_duplicates(singles, block=64).collect()))
    assert got == sorted(map(tuple, C.near_duplicates(doubles, block=64).collect()))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [r[1] for r in got] == ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()
