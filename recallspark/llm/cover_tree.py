"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors are compared by chord length: cosine 0.95 is a chord tau of
sqrt(0.1). The tree's upper levels are centres from a bounded sample, at most
``MAX_CELLS``, by a greedy net whose radius is halved from 2 on; every vector
goes to its nearest centre's cell, and large cells are dealt into blocks. A block
has ``BLOCK`` vectors, and more where they would be over ``BLOCKS``: without
structure a vector visits half of all blocks, and so their number, not the
table's size, says how often it is sent, up to blocks of ``MOST`` components.
A vector visits another cell only where two lower bounds
allow a partner there: the cell's covering radius, and the plane between the two
centres, on whose other side all of the cell lies. So of two cells only the
vectors near their border meet, and each pair of cells at one of them only.

A task holds one block as nested levels of radii ``RADII`` and takes its visitors
in chunks of bounded size, as trees too. Pairs of nodes are pruned where their
centres are farther apart than tau and both covering radii; nodes that lie
wholly within tau of each other count their links at once, so a dense group
costs its nodes and not its pairs. What remains is compared exactly in double
precision. Coarser levels than these prune nothing on a sphere: two nodes of
radius 1 always reach each other.

Vectors without structure (far from all others, in many dimensions) leave every
tree little to prune; then a block and its visitors are compared by one matrix
product of node centres, in single precision with ``ROOM`` for its rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, decoded_id, id_label, key128, stored

COSINE, BLOCK, MAX_CELLS, SAMPLE = 0.95, 4096, 1024, 4096
BLOCKS, MOST = 48, 1 << 21
RADII = (0.5, 0.25, 0.125)
#: More than the rounding of single-precision products, and of double-precision chords.
ROOM, SLACK = 1e-4, 1e-7
#: Candidate pairs that are looked at together.
_PAIRS = 1 << 17


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def greedy_net(x: np.ndarray, radius: float, first: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres (``first`` and then points farther than ``radius`` from all
    others), and the centre that covers each point; -1 beyond ``most`` centres."""
    n, need = len(x), 1 - radius * radius / 2
    centres = list(first)
    owner = np.full(n, -1)
    owner[first] = first
    for at in range(0, n, 512):
        own = np.arange(at, min(n, at + 512))
        own = own[owner[own] < 0]
        if not len(own):
            continue
        if centres:
            near = x[own] @ x[centres].T
            best = near.argmax(axis=1)
            covered = near[np.arange(len(own)), best] >= need
            owner[own[covered]] = np.array(centres)[best[covered]]
            own = own[~covered]
        inner = x[own] @ x[own].T >= need
        for i, p in enumerate(own):
            if owner[p] < 0 and (most is None or len(centres) < most):
                centres.append(p)
                fresh = own[inner[i] & (owner[own] < 0)]
                owner[fresh] = p
                owner[p] = p
    return np.array(centres, np.int64), owner


def build(x: np.ndarray) -> np.ndarray:
    """For each point its ancestors' rows, a column a radius, coarse to fine."""
    levels, first = [], np.empty(0, np.int64)
    for r in RADII:
        first, owner = greedy_net(x, r, first)
        levels.append(owner)
    path = np.empty((len(x), len(RADII)), np.int64)
    path[:, -1] = levels[-1]
    for k in range(len(RADII) - 2, -1, -1):
        path[:, k] = levels[k][path[:, k + 1]]
    return path


class Level:
    """Nodes of one level: centres (rows), covering radii, the node of each
    point, and children (nodes of the next level, or points) one after the other."""

    def __init__(self, x: np.ndarray, centre_of: np.ndarray, below: np.ndarray) -> None:
        self.centres, self.node = np.unique(centre_of, return_inverse=True)
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[self.centres[self.node]])))
        self.radius = np.zeros(len(self.centres))
        np.maximum.at(self.radius, self.node, away)
        parent = np.empty(below.max() + 1 if len(below) else 0, np.int64)
        parent[below] = self.node
        self.children = np.argsort(parent, kind="stable")
        self.starts = np.searchsorted(parent[self.children], np.arange(len(self.centres) + 1))


class Tree:
    """Points and their levels, coarse to fine; ``weight`` counts equal vectors."""

    def __init__(self, x: np.ndarray, weight: np.ndarray) -> None:
        self.x, self.weight, self.single = x, weight, x.astype(np.float32)
        path, below, self.levels = build(self.single), np.arange(len(x)), []
        for k in range(len(RADII) - 1, -1, -1):
            self.levels.insert(0, Level(x, path[:, k], below))
            below = self.levels[0].node


class Links:
    """What a traversal finds: linked weight of the points of both trees, edges
    that connect what the links connect, and how many pairs were looked at."""

    def __init__(self, a: Tree, b: Tree) -> None:
        self.same, self.shift = a is b, 0 if a is b else len(a.x)
        self.weight = np.zeros(self.shift + len(b.x), np.int64)
        self.edges, self.compared = [np.empty((2, 0), np.int64)], 0

    def add(self, place: np.ndarray, weight: np.ndarray) -> None:
        self.weight += np.bincount(place, weights=weight, minlength=len(self.weight)).astype(np.int64)


def _top_pairs(a: Tree, b: Tree, tau: float, links: Links) -> np.ndarray:
    """Pairs of coarsest nodes within reach. With A = tau + ra + ROOM, chord <=
    A + rb is x.y + A rb + A A / 2 + rb rb / 2 >= 1: one product and one limit."""
    la, lb = a.levels[0], b.levels[0]
    reach, rb = np.minimum(tau + la.radius + ROOM, 2.0), lb.radius
    one = np.ones
    left = np.concatenate([a.single[la.centres], np.stack([reach, reach**2 / 2, one(len(reach))], 1).astype(np.float32)], 1)
    right = np.concatenate([b.single[lb.centres], np.stack([rb, one(len(rb)), rb**2 / 2], 1).astype(np.float32)], 1)
    found = []
    for i in range(0, len(left), 256):
        for j in range(i if links.same else 0, len(right), 2048):
            p, q = np.nonzero(left[i : i + 256] @ right[j : j + 2048].T >= np.float32(1 - ROOM))
            found.append(np.stack([p + i, q + j]))
    links.compared += len(left) * len(right) // (1 + links.same)
    pairs = np.concatenate(found, axis=1)
    return pairs[:, pairs[0] <= pairs[1]] if links.same else pairs


def _children(la: Level, lb: Level, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of each pair of nodes, and which pair's they are."""
    na, nb = la.starts[p + 1] - la.starts[p], lb.starts[q + 1] - lb.starts[q]
    whose = np.repeat(np.arange(len(p)), na * nb)
    inside = np.arange(len(whose)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    return la.children[la.starts[p][whose] + inside // nb[whose]], lb.children[lb.starts[q][whose] + inside % nb[whose]], whose


def _batches(sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of pairs whose children are about ``_PAIRS`` pairs, or one pair."""
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // _PAIRS)) + 1).tolist()
    for s, e in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        yield slice(s, e)


def dual(a: Tree, b: Tree, cosine: float) -> Links:
    """Traverses both trees, or one against itself."""
    tau, links = np.sqrt(2 - 2 * cosine), Links(a, b)
    same, shift = links.same, links.shift
    p, q = _top_pairs(a, b, tau, links)
    for k in range(len(RADII)):
        la, lb, last = a.levels[k], b.levels[k], k == len(RADII) - 1
        ra, rb, twin = la.radius[p], lb.radius[q], (p == q) & same
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.x[la.centres[p]], b.x[lb.centres[q]])))
        # All within reach: count, connect, and go no deeper.
        whole = np.where(twin, 2 * ra, d + ra + rb) <= tau - SLACK
        if whole.any():
            wa, wb = (np.bincount(x.node, weights=t.weight, minlength=len(x.centres)) for x, t in ((la, a), (lb, b)))
            i, j = p[whole & ~twin], q[whole & ~twin]
            to_a = np.bincount(i, weights=wb[j], minlength=len(la.centres))
            to_b = np.bincount(j, weights=wa[i], minlength=len(lb.centres))
            links.add(np.arange(len(a.x)), to_a[la.node])
            links.add(shift + np.arange(len(b.x)), to_b[lb.node])
            links.edges.append(np.stack([la.centres[i], shift + lb.centres[j]]))
            own = np.zeros(len(la.centres), bool)
            own[p[whole & twin]] = True
            points = np.flatnonzero(own[la.node])
            links.add(points, wa[la.node[points]] - a.weight[points])
            own[i] = True
            points = np.flatnonzero(own[la.node])
            links.edges.append(np.stack([points, la.centres[la.node[points]]]))
            used = np.zeros(len(lb.centres), bool)
            used[j] = True
            points = np.flatnonzero(used[lb.node])
            links.edges.append(np.stack([points, lb.centres[lb.node[points]]]) + shift)
        near = ~whole & (d <= tau + ra + rb + SLACK)
        p, q = p[near], q[near]
        sizes = (la.starts[p + 1] - la.starts[p]) * (lb.starts[q + 1] - lb.starts[q])
        links.compared += len(d) + (int(sizes.sum()) if last else 0)
        deeper = [np.empty((2, 0), np.int64)]
        for part in _batches(sizes) if len(p) else ():
            big = sizes[part][0] > _PAIRS
            if last and big:  # one pair of large nodes
                ca, cb = (x.children[x.starts[n] : x.starts[n + 1]] for x, n in ((la, p[part][0]), (lb, q[part][0])))
                hit = [np.nonzero(a.x[ca[i : i + 256]] @ b.x[cb].T >= cosine) for i in range(0, len(ca), 256)]
                ca = np.concatenate([ca[i * 256 + h[0]] for i, h in enumerate(hit)])
                cb = cb[np.concatenate([h[1] for h in hit])]
                keep = (ca < cb) if same and p[part][0] == q[part][0] else np.ones(len(ca), bool)
            else:
                ca, cb, whose = _children(la, lb, p[part], q[part])
                mine = same & (p[part] == q[part])[whose]
                keep = ~mine | ((ca < cb) if last else (ca <= cb))
                if last:
                    keep[keep] = np.einsum("ij,ij->i", a.x[ca[keep]], b.x[cb[keep]]) >= cosine
            ca, cb = ca[keep], cb[keep]
            if last:
                links.add(ca, b.weight[cb])
                links.add(shift + cb, a.weight[ca])
                links.edges.append(np.stack([ca, shift + cb]))
            else:
                deeper.append(np.stack([ca, cb]))
        p, q = np.concatenate(deeper, axis=1)
    return links


def roots(n: int, edges: np.ndarray) -> np.ndarray:
    """The least point that edges reach, for each of n points."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[edges[0]], label[edges[1]])
        new = label.copy()
        np.minimum.at(new, edges[0], least)
        np.minimum.at(new, edges[1], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors; scaled first, so that squares fit."""
    return _scaled(column.flatten().to_numpy().reshape(len(column), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, rows: np.ndarray, kind: type) -> np.ndarray:
    """Unit vectors, in double precision, from the bytes of vectors of one length."""
    return _scaled(np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), kind).astype(float).reshape(len(rows), -1))


def block_size(n: int, dim: int) -> int:
    """How many of ``n`` vectors a block has."""
    return max(BLOCK, min(-(-n // BLOCKS), MOST // max(dim, 1)))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors of a cosine of at least ``cosine`` are linked. Null, zero and empty
    vectors and those with null or non-finite components link with nothing, nor
    do vectors of different lengths. Repeated rows and equal vectors are linked.
    A null vec_id links too; a component's id is its least non-null one. An
    empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    # Vectors travel as they are, singles as singles, and become units of doubles in the tasks.
    number = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), key128("v")))
    nodes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("id"), F.first("v").alias("v"))
    nodes = stored(nodes.select("key", id_label("id", "key").alias("label"), "m", F.size("v").alias("dim"), "v"))

    # The upper levels: centres for each length of vector, from a bounded sample.
    dims, points, sizes = [], [], {}
    for dim, n in sorted(map(tuple, nodes.groupBy("dim").count().collect())):
        sizes[dim] = block or block_size(n, dim)
        want = min(MAX_CELLS, -(-n // sizes[dim]))
        drawn = F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * 2**30))
        sample = nodes.where((F.col("dim") == dim) & drawn).select("key", "v").toArrow().sort_by("key") if want > 1 else None
        x = _unit(sample.column("v").combine_chunks()) if want > 1 and len(sample) else np.eye(1, dim)
        own, radius = np.empty(0, np.int64), 2.0
        while len(own) < min(want, len(x)) and radius > 1e-3:
            own, _ = greedy_net(x, radius, own, want)
            radius /= 2
        dims += [dim] * len(own)
        points += [x[i] for i in own]
    cells = np.array(dims, np.int64)
    sent = spark.sparkContext.broadcast((cells, points))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, points = sent.value
        for batch in batches:
            at, cell, away = batch.column(2).to_numpy(), np.zeros(len(batch), np.int32), np.zeros(len(batch))
            raw = np.empty(len(batch), object)
            for dim in np.unique(at):
                own, mine = np.flatnonzero(at == dim), np.flatnonzero(dims == dim)
                x = batch.column(3).take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)
                d = chords(_scaled(x), np.array([points[c] for c in mine]))
                cell[own], away[own] = mine[d.argmin(axis=1)], d.min(axis=1)
                raw[own] = [row.tobytes() for row in x.astype(number)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(away), pa.array(raw, pa.binary())], ["label", "m", "cell", "away", "u"])

    placed = stored(nodes.select("label", "m", "dim", "v").mapInArrow(place, "label binary, m long, cell int, away double, u binary"))
    radius, parts = np.zeros(len(cells)), np.ones(len(cells), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        radius[r["cell"]], parts[r["cell"]] = r["r"], -(-r["n"] // sizes[dims[r["cell"]]])
    tau, first = float(np.sqrt(2 - 2 * cosine)), np.cumsum(parts) - parts
    sent_cells = spark.sparkContext.broadcast((cells, points, radius, parts, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its block, and as a visitor to others. Of two blocks
        the one that takes visitors changes with the sum of their numbers."""
        dims, points, radius, parts, first = sent_cells.value
        hosts = lambda i, j: ((i + j) % 2 == 0) == (i < j)  # noqa: E731  whether block j hosts block i
        for batch in batches:
            cell, row, to, guest = batch.column(2).to_numpy(), [], [], []
            mix = np.array([int.from_bytes(x[-8:]) for x in batch.column(0).to_pylist()], np.uint64)
            part = (mix % parts[cell].astype(np.uint64)).astype(np.int64)
            at = first[cell] + part
            row.append(np.arange(len(batch)))
            to.append(at)
            guest.append(np.zeros(len(batch), np.int32))
            for dim in np.unique(dims[cell]):
                mine = np.flatnonzero(dims == dim)
                centres = np.array([points[c] for c in mine])
                own = np.flatnonzero(dims[cell] == dim)
                local = np.searchsorted(mine, cell[own])
                x = _vectors(batch.column(4), own, number)
                d, between = chords(x, centres), chords(centres, centres)
                planes = d**2 - d[np.arange(len(own)), local][:, None] ** 2
                visits = (d <= tau + radius[mine] + 1e-6) & (planes <= 2 * (tau + 1e-6) * between[local] + 1e-6)
                i, c = np.nonzero(visits)
                n = parts[mine[c]]
                i, c = np.repeat(i, n), np.repeat(c, n)
                block_to = first[mine[c]] + np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
                home = at[own[i]]
                keep = (block_to != home) & hosts(home, block_to)
                row.append(own[i[keep]])
                to.append(block_to[keep])
                guest.append(np.ones(keep.sum(), np.int32))
            rows, to, guest = (np.concatenate(x) for x in (row, to, guest))
            for s in range(0, len(rows), 8192):
                own = pa.array(rows[s : s + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(to[s : s + 8192]), pa.array(guest[s : s + 8192]), *(batch.column(k).take(own) for k in (2, 0, 1, 4))], names)

    names = ["block", "guest", "cell", "label", "m", "u"]
    dealt = placed.mapInArrow(deal, "block long, guest int, cell int, label binary, m long, u binary")
    blocks, most = int(parts.sum()), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionById(max(1, min(blocks, most)), (F.col("block") % max(1, min(blocks, most))).cast("int"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, None

        def rows_of(parts: list[pa.RecordBatch]) -> tuple[list[bytes], Tree]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            x = _vectors(whole.column("u").combine_chunks(), np.arange(len(whole)), number)
            return whole.column("label").to_pylist(), Tree(x, whole.column("m").to_numpy())

        def out(labels: list[bytes], links: np.ndarray, root: list[bytes]) -> pa.RecordBatch:
            used = np.flatnonzero(links)
            kept = [[x[i] for i in used] for x in (labels, root)]
            return pa.RecordBatch.from_arrays([pa.array(kept[0], pa.binary()), pa.array(links[used]), pa.array(kept[1], pa.binary())], ["label", "links", "root"])

        class Home:
            def __init__(self, parts: list[pa.RecordBatch]) -> None:
                self.labels, self.tree = rows_of(parts)
                found = dual(self.tree, self.tree, cosine)
                self.links, self.root = found.weight, roots(len(self.labels), np.concatenate(found.edges, axis=1))

            def visited(self, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
                labels, tree = rows_of(parts)
                found, n = dual(self.tree, tree, cosine), len(self.labels)
                self.links += found.weight[:n]
                root = roots(n + len(labels), np.concatenate([np.stack([np.arange(n), self.root]), *found.edges], axis=1))
                self.root = root[:n]
                # A linked visitor's root is one of the block's vectors, as these come first.
                return out(labels, found.weight[n:], [self.labels[i] if i < n else b"" for i in root[n:]])

            def done(self) -> pa.RecordBatch:
                return out(self.labels, self.links, [self.labels[i] for i in self.root])

        held, kind = [], 0
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if s == e:
                    continue
                if at is not None and key[s] != at * 2 + kind:
                    if kind == 0:
                        home, held = Home(held), []
                    if key[s] >> 1 != at:
                        if held:
                            yield home.visited(held)
                        yield home.done()
                        held = []
                at, kind = int(key[s] >> 1), int(key[s] & 1)
                held.append(batch.slice(s, e - s))
                while kind and sum(map(len, held)) >= BLOCK:
                    yield home.visited(held)
                    held = []
        if at is not None:
            if kind == 0:
                home, held = Home(held), []
            if held:
                yield home.visited(held)
            yield home.done()

    found = stored(dealt.sortWithinPartitions("block", "guest", "cell").mapInArrow(traverse, "label binary, links long, root binary"))
    links = found.groupBy("label").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("label", "root"), "label", "root").withColumnRenamed("node", "label")
    known = nodes.select("key", "label", "m").join(links, "label", "left").join(groups, "label", "left")
    known = known.select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), decoded_id(F.coalesce("component", "label")).alias("component_id"))
    alone = F.col("key").isNull()
    out = rows.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
