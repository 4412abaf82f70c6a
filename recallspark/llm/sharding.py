"""Sharding by sampled splitters, under the law of near-equal bytes.

Records are ordered by a pair of hashes: of the text, then of the record. A
bounded, size-weighted sample of these pairs gives splitters; records fall into
the ranges between them. Exact bytes and rows of each range then give each
record its exact place in the whole order, and the place gives the shard.
Ranges that turn out overfull are subdivided by further samples. Equal texts
are neighbours and stay in one shard, unless their group is so large that it
holds splitters inside or fills more than two ranges; then it is cut, as no law
of equal bytes can keep it. Records equal in id and text are one pair with their
number until all places are known, so that no task holds their copies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ranges a shard, and samples a range: the sample has about 16 shards * 64 * 16 pairs.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 16
#: Copies of a record that one row stands for when they are dealt out, and rounds of subdividing.
COPIES, ROUNDS = 4096, 40
LAW = "bytes"
_LEAST = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    """The narrow pairs that are ordered, with ``n`` records and ``bytes`` in all;
    texts are read once and not moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(17), "doc_id").alias("k2"),
    )
    pairs = rows.groupBy("k1", "k2", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    return pairs.withColumn("bytes", F.col("n") * F.col("size"))


def _sample(rows: DataFrame, n: int, seed: int) -> list[tuple[int, int]]:
    """About ``n`` pairs (k1, k2), drawn with weight by size: each record by
    itself, from a hash, so that a rerun draws the same."""
    total = rows.agg(F.sum("bytes")).first()[0] or 1
    point = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "size"), F.lit(2**40)) / float(2**40)
    drawn = rows.where(point < 1 - F.exp(-F.col("bytes") * F.lit(n / total)))
    return [tuple(r) for r in drawn.select("k1", "k2").collect()]


def _splitters(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """Quantiles of the sample. A splitter moves to the start of its group of
    equal texts, unless the group holds further ones: it's cut at those."""
    points = sorted(sample)
    picked = sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else []
    seen: set[int] = set()
    out = []
    for k1, k2 in picked:
        out.append((k1, k2) if k1 in seen else (k1, _LEAST))
        seen.add(k1)
    return sorted(set(out))


def _finer(splitters: list[tuple[int, int]], sample: list[tuple[int, int]], pieces: int = 8) -> list[tuple[int, int]]:
    """Quantiles of the sample of each range, past its least pair, as further splitters."""
    own, of_range = {a for a, _ in splitters}, {}
    for pair in sorted(set(sample)):
        of_range.setdefault(bisect_right(splitters, pair), []).append(pair)
    inner = [x[i * len(x) // pieces] for x in of_range.values() for i in range(1, pieces + 1) if 0 < i * len(x) // pieces < len(x)]
    inner += [x[1] for x in of_range.values() if len(x) > 1]
    return sorted({*splitters, *((a, b if a in own else _LEAST) for a, b in inner)})


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: how many splitters are at or before the record's pair."""
    sent = rows.sparkSession.sparkContext.broadcast(splitters)
    names = [*rows.columns, "range"]
    a, b = names.index("k1"), names.index("k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [("a", np.int64), ("b", np.int64)]
        cuts = np.array(sent.value, pair)
        first, starts = np.unique(cuts["a"], return_index=True)
        hot = {int(k): cuts["b"][s:e] for k, s, e in zip(first, starts, [*starts[1:], len(cuts)], strict=False) if e - s > 1}
        for batch in batches:
            x, y = batch.column(a).to_numpy(), batch.column(b).to_numpy()
            at = np.searchsorted(cuts["a"], x, "right")  # right for all but groups that are cut
            for k, inner in hot.items():
                own = np.flatnonzero(x == k)
                if len(own):
                    at[own] += np.searchsorted(inner, y[own], "right") - len(inner)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, range int")


def shards(docs: DataFrame, count: int = 16, ranges_per_shard: int = RANGES_PER_SHARD, samples_per_range: int = SAMPLES_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    ``size`` is the text's UTF-8 bytes plus one; a null text is as an empty
    one. ``slot`` counts from 0 in each shard without gaps. ``grown_shard`` is
    null under this law. Repeated rows and null ids are records like others;
    among rows equal in text and id any order serves. An empty table gives an
    empty result; columns other than doc_id and text are not read.
    """
    rows = stored(_keyed(docs))
    ranges = count * ranges_per_shard
    splitters = _splitters(_sample(rows, ranges * samples_per_range, 1), ranges)
    for seed in range(2, ROUNDS):
        placed = _ranged(rows, splitters)
        stats = {r["range"]: r for r in placed.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("top"), F.count("*").alias("pairs")).collect()}
        total = sum(r["bytes"] for r in stats.values())
        over = [k for k, r in stats.items() if r["bytes"] > 2 * max(total / ranges, r["top"]) and r["pairs"] > 1]
        if not over:
            break
        parts = _sample(placed.where(F.col("range").isin(over)), len(over) * samples_per_range * 4, seed)
        splitters = _finer(splitters, parts)
    else:
        raise RuntimeError("ranges stay overfull")
    placed = stored(_ranged(rows, splitters))

    # Exact bytes and rows before each range: two numbers a range.
    at_byte, at_row, starts = 0, 0, []
    for k in range(len(splitters) + 1):
        starts.append((at_byte, at_row))
        at_byte, at_row = at_byte + (stats[k]["bytes"] if k in stats else 0), at_row + (stats[k]["n"] if k in stats else 0)
    order = Window.partitionBy("range").orderBy("k1", "k2", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    first = [F.element_at(F.array(*map(F.lit, x)), F.col("range") + 1) for x in zip(*starts, strict=True)]
    placed = placed.withColumns({"at": first[0] + F.sum("bytes").over(order) - F.col("bytes"), "row": first[1] + F.sum("n").over(order) - F.col("n")})
    # A group inside a range goes where its middle lies; one that is cut, or fills ranges, goes row by row.
    cut_groups = sorted({a for a, b in splitters if b != _LEAST})
    group = Window.partitionBy("range", "k1")
    placed = placed.withColumns({"group_at": F.min("at").over(group), "group_bytes": F.sum("bytes").over(group)})
    whole = F.col("group_bytes") <= F.lit(2 * total / ranges)
    whole = whole & ~F.col("k1").isin(cut_groups) if cut_groups else whole

    # The copies of each pair, in parts first.
    dealt = placed.withColumn("whole", whole).withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {COPIES} as int)"))))
    if any(r["n"] > COPIES for r in stats.values()):
        dealt = dealt.repartition("k1", "k2", "part")
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("part") * F.lit(COPIES), F.least(F.col("n"), (F.col("part") + 1) * F.lit(COPIES)) - 1)))
    mid = F.when(F.col("whole"), F.col("group_at") + F.col("group_bytes") / 2).otherwise(F.col("at") + (F.col("copy") + 0.5) * F.col("size"))
    shard = F.least(F.floor(mid * count / F.lit(max(total, 1))), F.lit(count - 1)).cast("int")
    dealt = stored(dealt.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row") + F.col("copy")).alias("row")))

    # Shards follow the order, so a record's slot is its row less its shard's first.
    of_shard = {r["shard"]: r["first"] for r in dealt.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    begins = F.element_at(F.array(*(F.lit(of_shard.get(k, 0)).cast("long") for k in range(count))), F.col("shard") + 1)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("row") - begins).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
