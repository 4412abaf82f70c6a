from recallspark.llm import near_dedup as N


def brute(rows):
    sets = []
    for _, t, _, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for k, (i, *_) in zip(label, rows, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted(((i, len(s), least[k]) for (i, *_), s, k in zip(rows, sets, label, strict=True)), key=repr)


def test_against_brute_force(docs, rows):
    got = N.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_a_group_of_near_copies_with_outsiders(spark):
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(160):
        own = list(base)
        for k in range(n % 9):
            own[(n * 7 + k * 17) % 150] = f"e{n}_{k}"
        rows.append((n, " ".join(own), "en", "a"))
    got = N.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_one_of_each(docs, rows):
    got = sorted((r.doc_id for r in N.one_of_each(docs).collect()), key=repr)
    kept = [i for (i, _, c) in brute(rows) if i == c]
    assert len(got) == len({i for i in kept if i is not None}) + 1  # and the row without id or text
    assert N.one_of_each(docs).columns == docs.columns


def test_the_stage_takes_five_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(40)]
    one, other = " ".join(words), " ".join([*words[:20], "changed", *words[21:]])  # 33 of 41 shingles of four words, 31 of 41 of five
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 2]
    assert [r.doc_id for r in N.one_of_each(df).collect()] == [1]


def test_empty(empty):
    assert N.near_duplicates(empty).count() == 0


def test_estimate(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    bits = [N.packed_bits(N.minima(np.unique(np.concatenate([common, x])))).tolist() for x in (a, b)]
    got = spark.createDataFrame([bits], "x array<long>, y array<long>").select(N.estimated_similarity(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - 0.8) < 0.15


def test_links_of_members_in_parts(spark, monkeypatch):
    """Against all pairs, where a leader's members apart are held in many parts."""
    import random

    rng = random.Random(5)
    rows = []
    for lead in (b"l", b"m"):
        for n in range(60):
            size, delta = rng.randint(20, 30), sorted(rng.sample(range(-30, 30), rng.randint(8, 14)))
            rows.append((lead, b"%d" % n, size, delta, b"%d" % (n % 7), b"0"))
            if n % 3 == 0:  # one more that differs by little
                rows.append((lead, b"%d'" % n, size, sorted({*delta[1:], 40 + n}), b"%d" % ((n + 3) % 7), b"0"))
    where = spark.createDataFrame(rows, "lead binary, node binary, size long, delta array<long>, component binary, main binary")
    monkeypatch.setattr(N, "HELD", 100)
    got = {(bytes(r.lead), bytes(r.node)) for r in N._links_of_members(where, 80).collect()}
    component = {(k, x): c for k, x, _, _, c, _ in rows}
    every = set()
    for k, x, sx, dx, cx, main in rows:
        for j, y, sy, dy, cy, _ in rows:
            apart = len({*dx} ^ {*dy})
            if k == j and cx != main and cx != cy and 100 * (sx + sy - apart) >= 80 * (sx + sy + apart):
                every.add((k, x, y))
    assert len(every) > 20 and got <= {(x, y) for _, x, y in every}
    assert {(component[k, x], y) for k, x, y in every} == {(component[k, x], y) for k, x, y in every if (x, y) in got}


def test_a_large_group_apart_from_its_leader(spark):
    """Members that link with no other cost no exact comparison by pairs: these took minutes."""
    import random
    import time

    rng = random.Random(11)
    base = [f"w{i}" for i in range(130)]
    rows = [(0, " ".join(base))]
    for n in range(1, 4001):
        own = list(base)
        for k in range(5):
            own[26 * k + rng.randrange(26)] = f"e{n % 3000}_{k}"
        rows.append((n, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    df.count()
    began = time.time()
    got = N.near_duplicates(df).select("component_id").distinct().count()
    assert time.time() - began < 45 and got > 3000
