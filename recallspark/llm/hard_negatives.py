"""Hard negatives by a GNAT-style multiway hyperplane tree.

Scores are inner products of integer vectors. With M the greatest norm, a row x
stands at (x, sqrt(M M - x.x)), on a sphere, and an anchor u at (u, 0): their
squared distance is u.u + M M - 2 u.x, so a window of scores is an annulus of
distances around the anchor, exactly, whatever the norms.

The tree's top level are at most ``MAX_CELLS`` split points, far from each other,
from a bounded sample; every row goes to the nearest one (hyperplanes between
split points divide the space). Each split point stores the range of its
distances to the rows of every sibling subtree; a sibling is eliminated where no
row at a distance of that range can lie in the annulus. Cells are dealt into
blocks of about the root of the number of rows, and a block is a subtree of
``DEGREE`` split points a node with the same ranges, down to leaves of ``LEAF``
rows, whose scores are computed exactly.

A query first visits one block near it, whose same-label rows give a bound; then
every block that the ball of this bound can reach, for positives; then every
block that the windows of its positives can reach, for negatives. A block passes
on a bounded number of rows for each visitor, and one with many visitors is dealt
to several tasks.

Equal vectors of one label are told apart by their ids alone, and no result holds
more than the first few of them: only those enter the tree, cut in each task
before they move, and equal anchors are one query. So a vector that a third of
all rows share is a few rows until its anchors take the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key128, stored

POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
MAX_CELLS, SAMPLE, LEAST_BLOCK = 256, 4096, 1024
DEGREE, LEAF = 16, 64
#: More than the rounding of distances, as a share of M.
SLACK = 1e-6
#: Visitors that a block takes at a time, and in one task.
VISITORS, CROWD = 2048, 1 << 16
#: Queries that are joined to their anchors by broadcast at most.
HOT = 1000
#: Stands for a null id, which comes last among equal scores.
_NO_ID = 2**63 - 1


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x that are far from each other: each the farthest from those before."""
    picked, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(most, len(x)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


def raised(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the coordinate that puts them on the sphere of the greatest norm."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)))


def within_reach(d: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whether each visitor's annulus [near, far] can meet each subtree. ``d`` has
    visitors' distances to split points, ``low`` and ``high`` (split point,
    subtree) the ranges."""
    alive = np.ones((len(d), low.shape[1]), bool)
    for i in range(d.shape[1]):
        own = d[:, i : i + 1]
        alive &= (own + high[i] >= near[:, None]) & (np.maximum(own - high[i], low[i] - own) <= far[:, None])
    return alive


@dataclass
class Node:
    """A subtree: its rows (from ``start`` to ``end`` of the block's order), and
    for an inner node split points, ranges and children."""

    start: int
    end: int
    points: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: tuple[Node, ...] = ()


class Block:
    """Rows of one block as a tree; ``compared`` counts exact scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: float) -> None:
        self.norm, self.compared = norm, 0
        at = raised(x, norm)
        self.order = np.arange(len(x))
        self.root = self._built(at, 0, len(x))
        self.ids, self.labels, self.x = ids[self.order], labels[self.order], x[self.order]

    def _built(self, at: np.ndarray, start: int, end: int) -> Node:
        own = at[self.order[start:end]]
        points = own[spread(own, DEGREE)] if end - start > LEAF else own[:1]
        if len(points) < 2:
            return Node(start, end)
        d = distances(own, points)
        side = d.argmin(axis=1)
        by_side = np.argsort(side, kind="stable")
        self.order[start:end] = self.order[start:end][by_side]
        d, cuts = d[by_side], np.searchsorted(side[by_side], np.arange(len(points) + 1))
        low, high = (np.stack([f(d[a:b], axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1) for f in (np.min, np.max))
        return Node(start, end, points, low, high, tuple(self._built(at, start + a, start + b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)))

    def search(self, u: np.ndarray, near: np.ndarray, far: np.ndarray, take: Callable[[np.ndarray, slice, np.ndarray], None]) -> None:
        """Calls ``take`` with visitors, the rows of a leaf, and their scores, for
        all leaves that the annuli of the visitors ``u`` reach."""
        at, room = np.concatenate([u, np.zeros((len(u), 1))], axis=1), SLACK * max(self.norm, 1.0)
        near, far = near - room, far + room
        todo = [(self.root, np.arange(len(u)))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            if not node.children:
                rows = slice(node.start, node.end)
                self.compared += len(who) * (node.end - node.start)
                take(who, rows, u[who] @ self.x[rows].T)
                continue
            alive = within_reach(distances(at[who], node.points), node.low, node.high, near[who], far[who])
            todo += [(child, who[alive[:, j]]) for j, child in enumerate(node.children)]


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of each group's first n by greatest score and least id, in order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.searchsorted(g, g)
    return order[np.arange(len(g)) - begin < n]


def annuli(u: np.ndarray, low: np.ndarray, high: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distances of rows whose scores are from ``low`` to
    ``high`` (NaN: no limit), with room for rounding."""
    own, room = (u * u).sum(axis=1) + norm * norm, SLACK * max(norm, 1.0)
    near, far = (np.sqrt(np.maximum(0.0, own - 2 * x)) for x in (high, low))
    return np.where(np.isnan(near), 0.0, near - room), np.where(np.isnan(far), np.inf, far + room)


def least_negative(score: Column, percent: int) -> Column:
    """The least integer that is ``percent`` percent of a score from 0 on, or more."""
    return F.ceil((score * percent).cast("decimal(38,0)") / 100).cast("long")


def taking_part(vectors: DataFrame, anchors: Column) -> DataFrame:
    """(id, label, dim, u, asks, key) of the rows of ``vectors`` that take part, each
    once: the vector as whole doubles, and whether the row is an anchor. ``key``
    stands for the vector."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**26)) & (F.size(v) > 0)
    rows = vectors.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x * 256).cast("double"))
    asks = F.coalesce(anchors, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.size(v).alias("dim"), whole.alias("u"), asks.alias("asks"))
    rows = rows.where(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x) < 2.0**52)
    return rows.withColumn("key", key128("u")).dropDuplicates(["key", "label", "id"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


@dataclass
class Top:
    """The top level: split points with their lengths of vector, the greatest norm
    of each length, ranges (split point, cell), and each cell's first block and
    number of blocks. As large as ``MAX_CELLS`` squared, whatever the rows."""

    dims: np.ndarray
    points: list[np.ndarray]
    norms: dict[int, float]
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def cells(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of vectors of a length, and their split points."""
        own = np.flatnonzero(self.dims == dim)
        return own, np.array([self.points[c] for c in own]).reshape(len(own), dim + 1)


def _split_points(rows: DataFrame, block: int | None) -> tuple[Top, dict[int, int]]:
    """Split points for each length of vector, and the rows of a block."""
    dims, points, norms, sizes = [], [], {}, {}
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    for dim, n, norm in sorted(map(tuple, rows.groupBy("dim").agg(F.count("*"), F.max(length)).collect())):
        norms[dim], sizes[dim] = norm, block or max(LEAST_BLOCK, int(np.ceil(np.sqrt(n))))
        want = min(MAX_CELLS, -(-n // sizes[dim]))
        own = np.eye(1, dim + 1)
        if want > 1:
            drawn = F.pmod(F.xxhash64(F.lit(9), "key", "id", "label"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * 2**30))
            found = rows.where((F.col("dim") == dim) & drawn).select("key", "id", "label", "u").toArrow().sort_by([(c, "ascending") for c in ("key", "id", "label")])
            if len(found):
                x = raised(_matrix(found.column("u")), norm)
                own = x[spread(x, want)]
        dims += [dim] * len(own)
        points += list(own)
    m = len(dims)
    return Top(np.array(dims, np.int64), points, norms, np.zeros((m, m)), np.full((m, m), -1.0), np.zeros(m, np.int64), np.ones(m, np.int64)), sizes


def planted(rows: DataFrame, block: int | None = None) -> tuple[DataFrame, Top]:
    """(block, id, label, u) for each of ``rows`` (id, label, dim, u, key), and the
    top level of the tree over them."""
    spark = rows.sparkSession
    top, sizes = _split_points(rows, block)
    sent = spark.sparkContext.broadcast(top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(len(batch), np.int32)
            for dim in np.unique(dims).tolist():
                mine, (cells, points) = np.flatnonzero(dims == dim), sent.value.cells(dim)
                x = raised(_matrix(batch.column(3).take(pa.array(mine))), sent.value.norms[dim])
                cell[mine] = cells[distances(x, points).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "label", "dim", "u", "cell"])

    placed = stored(rows.select("id", "label", "dim", "u").mapInArrow(place, "id long, label long, dim int, u array<double>, cell int"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task's rows of each cell, the least and greatest distances."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell = batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                dim = int(sent.value.dims[c])
                x = raised(_matrix(batch.column(0).take(pa.array(np.flatnonzero(cell == c)))), sent.value.norms[dim])
                d = distances(x, sent.value.cells(dim)[1])
                low, high = d.min(axis=0), d.max(axis=0)
                found[c] = (np.minimum(low, found[c][0]), np.maximum(high, found[c][1])) if c in found else (low, high)
        for c, (low, high) in found.items():
            points = sent.value.cells(int(sent.value.dims[c]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), c, np.int32)), pa.array(points.astype(np.int32)), pa.array(low), pa.array(high)], ["cell", "point", "low", "high"])

    found = placed.select("u", "cell").mapInArrow(ranges, "cell int, point int, low double, high double")
    for r in found.groupBy("cell", "point").agg(F.min("low"), F.max("high")).collect():
        top.low[r[1], r[0]], top.high[r[1], r[0]] = r[2], r[3]
    for r in placed.groupBy("cell", "dim").count().collect():
        top.parts[r["cell"]] = -(-r["count"] // sizes[r["dim"]])
    top.first[:] = np.cumsum(top.parts) - top.parts
    cells = F.broadcast(spark.createDataFrame(list(enumerate(zip(top.first.tolist(), top.parts.tolist(), strict=True))), "cell int, b struct<first:long,parts:long>"))
    part = F.pmod(F.xxhash64("id", "label", "u"), F.col("b.parts"))
    return placed.join(cells, "cell").select((F.col("b.first") + part).alias("block"), "id", "label", "u"), top


QUERY = "key binary, label long, u array<double>, low double, high double, scores array<long>"
_COLUMNS = [x.split()[0] for x in QUERY.split(", ")]


def visits(queries: DataFrame, top: Top, home: bool) -> DataFrame:
    """``queries`` (key, label, u, low, high, scores), a row for each ``block`` that
    they visit: one near them, or all that their windows of scores, from ``low``
    to ``high``, can reach."""
    sent = queries.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        for batch in batches:
            dims, row, to = np.diff(batch.column(2).offsets.to_numpy()), [], []
            for dim in np.unique(dims).tolist():
                mine, (cells, points) = np.flatnonzero(dims == dim), top.cells(dim)
                if not len(cells):
                    continue
                u = _matrix(batch.column(2).take(pa.array(mine)))
                d = distances(np.concatenate([u, np.zeros((len(u), 1))], axis=1), points)
                if home:
                    cell = cells[d.argmin(axis=1)]
                    part = np.array([int.from_bytes(k[:4]) for k in batch.column(0).take(pa.array(mine)).to_pylist()], np.int64)
                    row.append(mine)
                    to.append(top.first[cell] + part % top.parts[cell])
                    continue
                low, high = (batch.column(k).take(pa.array(mine)).to_numpy(zero_copy_only=False) for k in (3, 4))
                i, c = np.nonzero(within_reach(d, top.low[np.ix_(cells, cells)], top.high[np.ix_(cells, cells)], *annuli(u, low, high, top.norms[dim])))
                n = top.parts[cells[c]]
                i, c = np.repeat(i, n), np.repeat(c, n)
                row.append(mine[i])
                to.append(top.first[cells[c]] + np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n))
            rows, to = (np.concatenate([np.empty(0, np.int64), *x]) for x in (row, to))
            for s in range(0, len(rows), VISITORS):
                own = pa.array(rows[s : s + VISITORS])
                yield pa.RecordBatch.from_arrays([pa.array(to[s : s + VISITORS]), *(c.take(own) for c in batch.columns)], ["block", *_COLUMNS])

    return stored(queries.select(*_COLUMNS).mapInArrow(run, f"block long, {QUERY}"))


def dealt(rows: DataFrame, guests: DataFrame) -> DataFrame:
    """Blocks' rows, each before the guests of its block. A block of more than
    ``CROWD`` guests stands in several slots, each with a part of them."""
    spark = rows.sparkSession
    crowded = guests.groupBy("block").count().where(F.col("count") > CROWD)
    slots = F.broadcast(crowded.select("block", F.ceil(F.col("count") / CROWD).alias("slots")))  # as many as blocks, at most
    spread_over = F.coalesce("slots", F.lit(1))
    own = rows.join(slots, "block", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), (spread_over - 1).cast("int"))))
    own = own.select("block", "slot", F.lit(0).alias("guest"), "id", *(F.col(c) if c in ("label", "u") else F.lit(None).cast(k.split()[1]).alias(c) for c, k in zip(_COLUMNS, QUERY.split(", "), strict=True)))
    theirs = guests.join(slots, "block", "left").withColumn("slot", F.pmod(F.xxhash64("key"), spread_over).cast("int"))
    theirs = theirs.select("block", "slot", F.lit(1).alias("guest"), F.lit(None).cast("long").alias("id"), *_COLUMNS)
    return own.union(theirs).repartition("block", "slot").sortWithinPartitions("block", "slot", "guest")


class Found:
    """Scores that leaves gave: visitor, score and id of each."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, hit: np.ndarray) -> None:
        i, j = np.nonzero(hit)
        self.parts.append((who[i], score[i, j].astype(np.int64), ids[j]))

    def all(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts, strict=True)]


def positives_in(block: Block, labels: np.ndarray, u: np.ndarray, low: np.ndarray, n: int) -> list[np.ndarray]:
    """(visitor, score, id): the first n rows of each visitor's label, from its
    bound ``low`` on."""
    found, least = Found(), np.where(np.isnan(low), -np.inf, low)

    def take(who: np.ndarray, rows: slice, score: np.ndarray) -> None:
        found.add(who, score, block.ids[rows], (score >= least[who][:, None]) & (labels[who][:, None] == block.labels[rows][None, :]))

    block.search(u, *annuli(u, low, np.full(len(u), np.nan), block.norm), take)
    who, score, ids = found.all()
    first = first_of(who, score, ids, n)
    return [who[first], score[first], ids[first]]


def negatives_in(block: Block, labels: np.ndarray, u: np.ndarray, low: np.ndarray, high: np.ndarray, scores: list[list[int]], n: int, percent: int) -> list[np.ndarray]:
    """(visitor, place of the positive, score, id): for each of a visitor's
    positives the first n rows of other labels in its window."""
    found = Found()

    def take(who: np.ndarray, rows: slice, score: np.ndarray) -> None:
        found.add(who, score, block.ids[rows], (score <= high[who][:, None]) & (score >= low[who][:, None]) & (labels[who][:, None] != block.labels[rows][None, :]))

    block.search(u, *annuli(u, low, high, block.norm), take)
    who, score, ids = found.all()
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    starts, out = np.searchsorted(who, np.arange(len(u) + 1)), [(np.empty(0, np.int64),) * 4]
    for i in np.unique(who).tolist():
        own = slice(starts[i], starts[i + 1])
        falling = -score[own]
        p = np.array(scores[i], np.int64)
        begin = np.searchsorted(falling, -p)
        end = np.minimum(begin + n, np.searchsorted(100 * falling, -percent * p, "right"))
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            if a < b:
                out.append((np.full(b - a, i), np.full(b - a, k), score[own][a:b], ids[own][a:b]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _visited(rows: DataFrame, guests: DataFrame, norms: dict[int, float], answer: Callable[..., list[np.ndarray]]) -> DataFrame:
    """(key, place, score, other): what ``answer(block, labels, u, low, high,
    scores)`` gives for the guests of each block, ``VISITORS`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held = None, None, []

        def settled() -> Iterator[pa.RecordBatch]:
            """Makes a block of the rows that stand in ``held``, or answers guests."""
            nonlocal block
            t = pa.Table.from_batches(held)
            held.clear()
            u, labels = _matrix(t.column("u")), t.column("label").to_numpy()
            if not at[2]:
                block = Block(t.column("id").to_numpy(), labels, u, norms[u.shape[1]])
                return
            if block is None:
                return
            low, high = (t.column(c).to_numpy() for c in ("low", "high"))
            who, place, score, other = answer(block, labels, u, low, high, t.column("scores").to_pylist())
            keys = t.column("key").combine_chunks().take(pa.array(who))
            yield pa.RecordBatch.from_arrays([keys, pa.array(place.astype(np.int32)), pa.array(score), pa.array(other)], ["key", "place", "score", "other"])

        for batch in batches:
            places = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
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

    return dealt(rows, guests).mapInArrow(run, "key binary, place int, score long, other long")


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    for the rows of ``vectors`` (vec_id, embedding, label) that ``anchors``, a
    condition on them, names.

    A row's score is the inner product of its vector's integers floor(256 x) with
    the anchor's; rows come by greatest score, ties by least id, null ids last. An
    anchor's positives are its first ``positives`` other rows of its label. A
    positive's hard negatives are the first ``negatives`` rows of other labels
    whose scores are at least ``percent`` percent of the positive's and at most
    the positive's, so none where the positive's is under 0.

    Null labels and vectors, empty ones and those with null or non-finite
    components take no part, nor do components of 2**26 or more in size or
    vectors whose integers have a squared norm of 2**52 or more, whose scores
    might not be exact. Vectors of another length than the anchor's are not
    compared with it. Rows of equal id, label and integers are one row; zero
    vectors are rows like others; a row without an id is no anchor. An empty
    table, or one without anchors, gives an empty result; other columns are not
    read.
    """
    every = stored(taking_part(vectors, anchors))
    # The first of equal vectors of a label; one more than results hold, as an anchor is not its own positive.
    nth = F.row_number().over(Window.partitionBy("key", "label").orderBy("id"))
    own = every.withColumn("nth", nth).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth", "asks")
    rows, top = planted(stored(own), block)
    rows = stored(rows)

    named = F.unhex(F.concat(F.hex("key"), F.lpad(F.hex("label"), 16, "0"))).alias("key")
    asked = every.where("asks").select(named, "id", "label", "u")
    limit = F.lit(None).cast("double")
    queries = asked.select("key", "label", "u", limit.alias("low"), limit.alias("high"), F.lit(None).cast("array<long>").alias("scores"))
    queries = stored(queries.dropDuplicates(["key"]))
    most = positives + 1

    def first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
        return found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < n)

    def best(block: Block, labels: np.ndarray, u: np.ndarray, low: np.ndarray, high: np.ndarray, scores: list) -> list[np.ndarray]:
        who, score, ids = positives_in(block, labels, u, low, most)
        return [who, np.zeros(len(who), np.int64), score, ids]

    near = _visited(rows, visits(queries, top, True), top.norms, best)
    bounds = near.groupBy("key").agg(F.when(F.count("*") >= most, F.min("score").cast("double")).alias("low"))
    bounded = stored(queries.drop("low").join(bounds, "key", "left").select(*_COLUMNS))
    found = stored(_visited(rows, visits(bounded, top, False), top.norms, best))
    own = stored(first(found, ["key"], most).select("key", F.col("nth").alias("place"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id")))

    listed = own.where("positive_score >= 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("l"))
    scores = F.transform("l", lambda x: x["positive_score"])
    window = [least_negative(F.array_min(scores), percent).cast("double").alias("low"), F.array_max(scores).cast("double").alias("high"), scores.alias("scores")]
    windows = stored(queries.select("key", "label", "u").join(listed.select("key", *window), "key").select(*_COLUMNS))

    def hard(block: Block, labels: np.ndarray, u: np.ndarray, low: np.ndarray, high: np.ndarray, scores: list) -> list[np.ndarray]:
        return negatives_in(block, labels, u, low, high, scores, negatives, percent)

    found = stored(_visited(rows, visits(windows, top, False), top.norms, hard))
    found = first(found, ["key", "place"], negatives).select("key", "place", F.struct((F.col("nth") + 1).cast("int").alias("rank"), F.col("other").alias("id"), "score").alias("n"))
    pairs = found.join(own, ["key", "place"]).groupBy("key", "place", "positive_id", "positive_score").agg(F.collect_list("n").alias("n"))
    results = stored(pairs.groupBy("key").agg(F.collect_list(F.struct("place", "positive_id", "positive_score", "n")).alias("p")))

    # Each anchor takes its query's results, but for itself. Queries of a share of
    # 1 / HOT of all anchors or more are HOT at most and are broadcast.
    listed = own.groupBy("key").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("all"))
    results = results.join(listed, "key")
    square = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x).cast("long")
    takers = stored(asked.select("key", F.col("id").alias("anchor_id"), square.alias("square")))
    counts, total = takers.groupBy("key").agg(F.count("*").alias("n")), takers.count()
    hot = F.broadcast(stored(counts.where(F.col("n") * HOT >= total).select("key")))
    taken = takers.join(F.broadcast(results.join(hot, "key", "left_semi")), "key").union(takers.join(hot, "key", "left_anti").join(results, "key"))
    # Its own place among the positives, where it has one, is not counted.
    itself = F.filter("all", lambda x: (x["positive_id"] == F.col("anchor_id")) & (x["positive_score"] == F.col("square")))
    itself = F.coalesce(F.array_min(F.transform(itself, lambda x: x["place"])), F.lit(most))
    taken = taken.withColumn("self", itself).select("anchor_id", "self", F.explode("p").alias("p"))
    taken = taken.where((F.col("p.place") != F.col("self")) & (F.col("p.place") - (F.col("self") < F.col("p.place")).cast("int") < positives))
    real = lambda x: F.when(x < _NO_ID, x)
    taken = taken.select("anchor_id", real(F.col("p.positive_id")).alias("positive_id"), F.col("p.positive_score").alias("positive_score"), F.explode("p.n").alias("n"))
    return taken.select("anchor_id", "positive_id", "n.rank", real(F.col("n.id")).alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
