"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that Spark hands to a Python worker at a time; whole texts make Spark's 10,000 tens of MB, held on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session to hand workers at most ``BATCH_ROWS`` rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, whose texts go to workers in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset and Spark runs in one process
    a folder below Spark's own temporary one takes its place; on a cluster the
    setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="recallspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a Parquet table: compressed, and read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key128(value: str | Column) -> Column:
    """A binary key of 128 bits, from two hashes with seeds of their own."""
    halves = (F.lpad(F.hex(F.xxhash64(F.lit(seed), value)), 16, "0") for seed in (1, 2))
    return F.unhex(F.concat(*halves))


def id_label(number: str, key: str) -> Column:
    """A binary label of a row that sorts by its id, null last, and then its key."""
    shifted = F.lpad(F.hex(F.col(number).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.when(F.col(number).isNull(), F.concat(F.unhex(F.lit("FF" * 9)), F.col(key))).otherwise(F.concat(F.unhex(F.concat(F.lit("00"), shifted)), F.col(key)))


def decoded_id(label: Column) -> Column:
    """The id in a label of :func:`id_label`."""
    number = F.conv(F.hex(F.substring(label, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    return F.when(F.substring(label, 1, 1) == F.unhex(F.lit("00")), number.cast("long"))


def arrow_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes in one column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if e > s:
                yield batch.slice(s, e - s)


def give_back() -> None:
    """Hands this process's free memory back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], every: int = 32) -> Callable[[Iterator], Iterator]:
    """``run``, whose worker gives its free memory back after each ``every``
    batches and at the end, when its caches have gone: workers stay for later
    tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        for i, batch in enumerate(run(batches)):
            yield batch
            if i % every == 0:
                give_back()
        give_back()

    return wrapped


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``fold``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of ``pairs``; component is the least node
    that links reach. Alternating large-star and small-star rounds: each is two
    keyed aggregations and joins, so no task holds a component, and the number
    of rounds grows with the logarithm of the longest path."""
    u, v = F.least(a, b), F.greatest(a, b)
    edges = cut(pairs.select(v.alias("u"), u.alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        star = large.join(small, large.u == small.k).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(small.select("k", "m")).where("u <> v")
        edges = cut(star.distinct())
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, whatever lambdas read it."""
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _ends(widths: Column) -> Column:
    """Running sums, in blocks of about the root of the count: 1.5 powers of it."""

    def blocked(w: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(w))).cast("int"), F.lit(1))
        numbers = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / side).cast("int"))
        return F.transform(numbers, lambda b: F.slice(w, b * side + 1, side))

    def inner(block: Column, before: Column) -> Column:
        return F.transform(block, lambda v, i: before + _sum(F.slice(block, 1, i + 1)))

    def outer(blocks: Column) -> Column:
        sums = F.transform(blocks, _sum)
        return let(sums, lambda t: F.flatten(F.transform(blocks, lambda b, i: let(_sum(F.slice(t, 1, i)), lambda o: inner(b, o)))))

    return F.when(F.size(widths) > 0, let(blocked(widths), outer)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value): the leftmost non-overlapping matches. The
    positions come from the pieces between them, split by the same pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(found, F.split(text, pattern, -1), lambda m, b: F.struct(m.alias("value"), (F.length(b) + F.length(m)).alias("width")))

    def spans(p: Column) -> Column:
        ends = _ends(F.transform(p, lambda x: x["width"]))
        span = lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value"))
        return F.zip_with(p, ends, span)

    return let(F.filter(pieces, lambda x: x["value"].isNotNull()), spans)
