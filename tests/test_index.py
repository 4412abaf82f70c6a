"""The stored index: exact search, measured recall, and the files that are read."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark.operators import search
from recallspark.sources import index as I
from recallspark.sources import views

DATA = "/root/testdata/sf0.01"
KINDS = "doc_id long, user_id string, embedding array<float>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Vectors in groups, a third of them at one place."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    x[::3] = x[0] + rng.normal(size=(1000, 16)) * 1e-3
    rows = [(i, f"u{i % 4}", v.tolist()) for i, v in enumerate(x)]
    rows += [(4000, "u1", None), (4001, "u1", [1.0, None] * 8), (4002, "u1", [1.0, 2.0]), (4003, "u2", rows[5][2]), (4004, "u2", rows[5][2])]
    df = spark.createDataFrame(rows, KINDS)
    return df, I.Index.build(df, str(tmp_path_factory.mktemp("index") / "i"), 40)


def asked(df, every=60):
    return df.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("qid"), "user_id", "embedding")


@pytest.mark.parametrize("own_user", [False, True])
@pytest.mark.parametrize("k", [1, 7])
def test_exact_search_is_brute_force(spark, made, own_user, k):
    df, index = made
    got = {(r.qid, r.knn_rank): (r.doc_id, r.distance) for r in index.search(asked(df), k, 2, True, own_user).collect()}
    rows = [r for r in df.collect() if r.embedding and len(r.embedding) == 16 and None not in r.embedding]
    ids, users, x = np.array([r.doc_id for r in rows]), np.array([r.user_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = {}
    for i in np.flatnonzero(ids % 60 == 0):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 6)
        d[(users != users[i]) & own_user] = np.inf
        for n, j in enumerate(np.lexsort((ids, d))[:k]):
            want[int(ids[i]), n + 1] = (int(ids[j]), d[j])
    assert got.keys() == want.keys()
    assert all(got[q][1] == pytest.approx(want[q][1], abs=2e-6) for q in want)
    assert sum(got[q][0] == want[q][0] for q in want) > 0.98 * len(want)  # rounding may swap equal ones


def test_a_large_cell_is_several_blocks(spark, made, monkeypatch, tmp_path):
    df, index = made
    monkeypatch.setattr(I, "BLOCK", 100)
    again = I.Index.build(df, str(tmp_path / "i"), 3)
    assert again.parts.max() > 8 and (I.Index.open(spark, again.path).parts == again.parts).all()
    both = [sorted(map(tuple, x.search(asked(df), 5).select("qid", "knn_rank", "distance").collect())) for x in (index, again)]
    assert both[0] == both[1]


def test_only_needed_cells_are_read(spark, made):
    df, index = made
    one = asked(df, 3000)
    cells = {r.cell for r in index._visits(one.where("qid = 0"), 2, False).collect()}
    assert len(cells) == 2
    files = index.vectors(sorted(cells)).inputFiles()
    assert {int(f.split("cell=")[1].split("/")[0]) for f in files} <= cells
    assert len(files) < 0.3 * len(spark.read.parquet(f"{index.path}/vectors").inputFiles())


def test_recall_over_all_queries(spark, tmp_path):
    memories = views.memories(spark, DATA)
    index = I.Index.build(memories, str(tmp_path / "i"))
    queries = views.queries(spark, DATA)
    truth = search.knn(memories, queries, 10)
    few, most = (I.recall(index.search(queries, 10, probes, False), truth).agg(F.avg("recall")).first()[0] for probes in (1, len(index.sizes) // 2))
    assert few <= most and most >= 0.9
    assert I.recall(index.search(queries, 10), truth).agg(F.min("recall")).first()[0] == 1.0


def test_empty_and_odd_tables(spark, tmp_path, made):
    df, index = made
    none = df.where("false")
    empty = I.Index.build(none, str(tmp_path / "e"))
    assert empty.search(asked(df), 3).count() == 0
    assert index.search(asked(none), 3).count() == 0
    odd = df.where("doc_id in (4000, 4001, 4002)").withColumn("doc_id", F.lit(0).cast("long"))
    assert index.search(asked(odd), 3).count() == 0


def test_smallest_breaks_ties_by_id():
    d = np.array([[1.0, 0.0, 1.0, 1.0, 2.0] * 4, [np.inf] * 20])
    values, ids = I.smallest(d, np.arange(20)[::-1], 6)
    assert values[0].tolist() == [0.0] * 4 + [1.0] * 2 and ids[0].tolist() == [3, 8, 13, 18, 1, 2]
    assert np.isinf(values[1]).all()


def test_batches_are_compared_in_slices():
    """What a task compares at a time is bounded, and no row or vector shifts."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([[float(i), 1.0] for i in range(10)])], ["id", "v"])
    parts = list(I.sliced(iter([batch]), 4))
    assert [len(p) for p in parts] == [4, 4, 2]
    assert np.concatenate([I.matrix(p.column(1)) for p in parts])[:, 0].tolist() == list(range(10))
    assert [np.diff(p.column(1).offsets.to_numpy()).tolist() for p in parts] == [[2] * 4, [2] * 4, [2] * 2]
