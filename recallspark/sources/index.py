"""A stored index of vectors: cells around centres, with radii that allow exact search.

Centres come from a bounded sample by k-means; every vector goes to its nearest
centre's cell, a folder of the table, and each cell keeps its radius, the greatest
distance of its vectors from the centre. A search reads a query's nearest cells
first; where it must be exact, it then reads every cell that may hold a nearer
vector than the k-th found, by the radius. Only the folders of cells that some
query needs are read.

Within a cell, vectors stand in blocks of at most about ``BLOCK``, so a cell with a
third of all rows is as many tasks; a block's distances to the queries that visit
it are matrix products, and it passes on each query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

MAX_CELLS, BLOCK, ROUNDS = 1024, 16_384, 8
#: Vectors of the sample for each centre.
SAMPLE = 64
#: Queries that a block takes at a time.
VISITORS = 1024
#: Vectors that are compared with a block or with all centres at a time.
_ROWS = 128
#: More than the rounding of distances.
SLACK = 1e-5


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, with six decimals."""
    return np.round(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0.0), 6)


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k least values and their ids, by value and then id; fewer where
    a row has fewer finite ones, which then has infinite values at its end. ``ids``
    is a row of them, or one for each row of ``d``."""
    ids = np.broadcast_to(ids, d.shape)
    if d.shape[1] > 4 * k:
        # All up to the k-th value: more than k only where values are equal.
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        width = max(k, int((d <= limit).sum(axis=1).max()))
        if width < d.shape[1]:
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            d, ids = np.take_along_axis(d, near, axis=1), np.take_along_axis(ids, near, axis=1)
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(ids, order, axis=1)


def sliced(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``n``."""
    return (b.slice(i, n) for b in batches for i in range(0, len(b), n))


def k_means(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample, from n of its rows at even steps; one without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x[i : i + 8192], centres).argmin(axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=n)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def whole() -> F.Column:
    """Whether an embedding is there and has no null component."""
    return F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())


class Index:
    """An index below a path; made by :meth:`build`, found by :meth:`open`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MAX_CELLS rows
        self.centres = np.array([r["centre"] for r in found], float).reshape(len(found), -1)
        self.radius, self.sizes = (np.array([r[c] for r in found]) for c in ("radius", "n"))
        self.parts = np.maximum(1, -(-self.sizes // BLOCK)).astype(np.int64)

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    @classmethod
    def build(cls, memories: DataFrame, path: str, cells: int | None = None) -> Index:
        """Indexes ``memories`` (doc_id, user_id, embedding). The length of most
        vectors is the index's; others, and those that are null or hold nulls,
        take no part. About a root of their number are the cells."""
        spark = memories.sparkSession
        rows = written(memories.where(whole()).select("doc_id", "user_id", "embedding"))
        sizes = {r[0]: r[1] for r in rows.groupBy(F.size("embedding")).count().collect()}
        dim, n = max(sizes.items(), key=lambda s: (s[1], s[0])) if sizes else (1, 0)
        want = max(1, min(cells or int(np.sqrt(n)), MAX_CELLS))
        rows = rows.where(F.size("embedding") == dim)
        drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE * want / max(n, 1)) * 2**30))
        sample = rows.where(drawn).select("doc_id", "embedding").toArrow().sort_by("doc_id")
        x = matrix(sample.column("embedding")) if len(sample) else np.zeros((1, dim))
        centres = k_means(x, min(want, len(x)))
        sent = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, VISITORS):
                d = squared(matrix(batch.column(2)), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(np.sqrt(d.min(axis=1)))], ["doc_id", "user_id", "embedding", "cell", "away"])

        kind = dict(rows.dtypes)
        placed = rows.mapInArrow(place, f"doc_id long, user_id {kind['user_id']}, embedding {kind['embedding']}, cell int, away double")
        # By cell and a hash, so that a large cell is written by several tasks.
        placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (want * BLOCK) + 1)))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        found = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")) if n else spark.createDataFrame([], "cell int, n long, radius double")
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        table.join(found, "cell", "left").na.fill({"n": 0, "radius": 0.0}).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def vectors(self, cells: list[int]) -> DataFrame:
        """The rows of some cells; no other folder is read."""
        paths = [f"{self.path}/vectors/cell={c}" for c in cells if self.sizes[c]]
        if not paths:
            return self.spark.createDataFrame([], "doc_id long, user_id string, embedding array<float>, away double, cell int")
        return self.spark.read.option("basePath", f"{self.path}/vectors").parquet(*paths)

    def _visits(self, queries: DataFrame, probes: int, bounded: bool) -> DataFrame:
        """(qid, user_id, embedding, cell, part) of the blocks that queries visit:
        of their nearest ``probes`` cells, or, where ``bounded``, of all further
        cells that may hold a vector as near as ``bound``."""
        sent = self.spark.sparkContext.broadcast((self.centres, self.radius, self.sizes, self.parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, sizes, parts = sent.value
            for batch in sliced(batches, VISITORS):
                own = np.flatnonzero(np.diff(batch.column(2).offsets.to_numpy()) == centres.shape[1])
                d = np.sqrt(squared(matrix(batch.column(2).take(pa.array(own))), centres)) if len(own) else np.zeros((0, len(centres)))
                nearest = np.zeros(d.shape, bool)
                np.put_along_axis(nearest, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
                if bounded:
                    bound = np.sqrt(batch.column(3).take(pa.array(own)).to_numpy(zero_copy_only=False))
                    reach = np.where(np.isnan(bound), np.inf, bound)[:, None] + SLACK
                    nearest = ~nearest & (d - radius <= reach)
                i, c = np.nonzero(nearest & (sizes > 0))
                i, c = np.repeat(i, parts[c]), np.repeat(c, parts[c])
                first = np.flatnonzero(np.diff(np.concatenate([[-1], i * len(centres) + c])))
                part = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
                for s in range(0, len(i), VISITORS):
                    rows = pa.array(own[i[s : s + VISITORS]])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), pa.array(c[s : s + VISITORS].astype(np.int32)), pa.array(part[s : s + VISITORS])], ["qid", "user_id", "embedding", "cell", "part"])

        kind = dict(queries.dtypes)
        columns = ["qid", "user_id", "embedding", *(["bound"] if bounded else [])]
        return written(queries.select(*columns).mapInArrow(run, f"qid long, user_id {kind['user_id']}, embedding {kind['embedding']}, cell int, part long"))

    def _found(self, visits: DataFrame, k: int, own_user: bool) -> DataFrame:
        """(qid, doc_id, distance): each block's k best for its visitors."""
        cells = sorted(r[0] for r in visits.select("cell").distinct().collect())  # at most MAX_CELLS numbers
        parts = F.element_at(F.array(*(F.lit(int(p)) for p in self.parts)), F.col("cell") + 1)
        rows = self.vectors(cells).withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))
        shape = lambda df, guest, key: df.select("cell", "part", F.lit(guest).alias("guest"), F.col(key).alias("id"), "user_id", "embedding")
        both = shape(rows, 0, "doc_id").union(shape(visits, 1, "qid"))
        dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "guest", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, block = None, [], None

            def settled() -> Iterator[pa.RecordBatch]:
                nonlocal block
                t = pa.Table.from_batches(held)
                held.clear()
                ids, users, x = t.column("id").to_numpy(), np.array(t.column("user_id").to_pylist(), object), matrix(t.column("embedding"))
                if not at[2]:
                    block = (ids, users, x)
                    return
                if block is None:
                    return
                for i in range(0, len(ids), _ROWS):
                    d = squared(x[i : i + _ROWS], block[2])
                    if own_user:
                        d[users[i : i + _ROWS, None] != block[1][None, :]] = np.inf
                    best, other = smallest(d, block[0], k)
                    real = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + _ROWS], real.sum(axis=1))), pa.array(other[real]), pa.array(best[real])], ["qid", "doc_id", "distance"])

            for batch in batches:
                places = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
                cuts = (np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist()
                for s, e in zip([0, *cuts], [*cuts, len(places)], strict=True):
                    if s == e:
                        continue
                    here = tuple(places[s].tolist())
                    if held and here != at:
                        yield from settled()
                    if at is None or here[:2] != at[:2]:
                        block = None
                    at = here
                    for i in range(s, e, VISITORS):
                        held.append(batch.slice(i, min(VISITORS, e - i)))
                        if at[2] and sum(map(len, held)) >= VISITORS:
                            yield from settled()
            if held and at[2]:
                yield from settled()

        return dealt.mapInArrow(run, "qid long, doc_id long, distance double")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, own_user: bool = False) -> DataFrame:
        """(qid, doc_id, distance, knn_rank) as ``operators.search.knn`` gives them,
        for ``queries`` (qid, user_id, embedding); without ``exact`` from the
        nearest ``probes`` cells alone. A query without a vector, or of another
        length than the index's, has no rows."""
        asked = written(queries.where(whole()).select("qid", "user_id", "embedding"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "doc_id"))
        best = lambda rows: rows.withColumn("knn_rank", rank).where(F.col("knn_rank") <= k)
        found = written(self._found(self._visits(asked, probes, False), k, own_user))
        if not exact:
            return best(found)
        bound = best(found).groupBy("qid").agg(F.when(F.count("*") == k, F.max("distance")).alias("bound"))
        more = self._found(self._visits(asked.join(bound, "qid", "left"), probes, True), k, own_user)
        return best(found.union(more))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): the share of each query's true neighbours (qid, doc_id) that
    were found; queries without true ones have no row."""
    hits = found.select("qid", "doc_id", F.lit(1).alias("hit")).distinct()
    return truth.select("qid", "doc_id").join(hits, ["qid", "doc_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
