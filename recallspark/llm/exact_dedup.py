"""Exact deduplication by composable polynomial fingerprints.

A text's normalised bytes b0 ... b(n-1) have the fingerprint sum(b_i r**(n-1-i))
modulo four primes, with its length n. Fingerprints compose: that of two pieces
one after the other is ``first * r**len(second) + second``. Blocks of a piece
are rows of one matrix product with the powers of r, exact in double precision,
and are then shifted by their lengths and added. A document of more than one
piece is dealt out: its pieces are hashed in as many tasks and composed by the
same rule.

Equal fingerprints are candidates only. The members of a class are compared with
its first document, piece by piece as both texts stream past, in groups of at
most ``MEMBERS`` that each get that document once. Members that differ form
classes of their own in a further round, until none is left over.

A class may hold a third of all rows: counts and least ids are summed in each
task before they move, classes of more than a thousandth of all rows, of which
there are at most ``HOT``, are joined by broadcast, and comparisons are dealt by
class and group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, free_name, stored, tidy

#: Bytes of a block (a row of the matrix product) and of a piece. A block's sums
#: stay under 2**53: 255 * 2**31 * 1024 < 2**49.
BLOCK, PIECE = 1 << 10, 1 << 16
#: Primes under 2**31, so that products of two residues fit a signed long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_rng = np.random.default_rng(20240513)
BASES = tuple(int(_rng.integers(1 << 16, p - 1)) for p in PRIMES)
#: Members of a class that one group compares with its first document.
MEMBERS = 256
#: Classes that are joined by broadcast at most: those of a share of 1 / HOT or more.
HOT = 1000
_WHITE = b" \t\n\x0b\x0c\r"
_P = np.array(PRIMES, np.int64)

Fingerprint = tuple[int, tuple[int, ...]]
EMPTY: Fingerprint = (0, (0,) * len(PRIMES))


def _powers(step: int, n: int) -> np.ndarray:
    """r**(step * i) for i of 0 ... n-1, a column a prime."""
    out = np.ones((n, len(PRIMES)), np.int64)
    for k, (r, p) in enumerate(zip(BASES, PRIMES, strict=True)):
        unit, x = pow(r, step, p), 1
        for i in range(n):
            out[i, k], x = x, x * unit % p
    return out


_WITHIN = _powers(1, BLOCK)[::-1].astype(float)
_SHIFTS = _powers(BLOCK, PIECE // BLOCK + 1)


def composed(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    """The fingerprint of what ``a`` and then ``b`` are fingerprints of."""
    return a[0] + b[0], tuple((x * pow(r, b[0], p) + y) % p for x, y, r, p in zip(a[1], b[1], BASES, PRIMES, strict=True))


def of_pieces(pieces: list[bytes]) -> list[Fingerprint]:
    """The fingerprints of pieces of at most ``PIECE`` bytes, all at once."""
    counts = np.array([-(-len(x) // BLOCK) for x in pieces], np.int64)
    rows = np.zeros((int(counts.sum()), BLOCK), np.uint8)
    flat, at = rows.reshape(-1), 0
    for x, n in zip(pieces, counts.tolist(), strict=True):
        # Zeros before the first byte add nothing.
        flat[(at + n) * BLOCK - len(x) : (at + n) * BLOCK] = np.frombuffer(x, np.uint8)
        at += n
    hashed = np.empty((len(rows), len(PRIMES)), np.int64)
    for i in range(0, len(rows), 4096):
        hashed[i : i + 4096] = (rows[i : i + 4096].astype(float) @ _WITHIN).astype(np.int64) % _P
    last = np.repeat(np.cumsum(counts), counts) - 1
    shifted = hashed * _SHIFTS[last - np.arange(len(rows))] % _P
    ends = np.cumsum(counts)
    sums = np.concatenate([np.zeros((1, len(PRIMES)), np.int64), np.cumsum(shifted, axis=0)])
    found = (sums[ends] - sums[ends - counts]) % _P
    return [(len(x), tuple(v)) for x, v in zip(pieces, found.tolist(), strict=True)]


def normalised(data: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The text with each run of white space as one space, in pieces of at most
    ``piece`` bytes; a run that crosses pieces is one run."""
    within = False  # whether what came before ends in white space
    for s in range(0, len(data), piece):
        raw = data[s : s + piece]
        out = b" ".join(raw.split())
        if out and raw[0] in _WHITE and not within:
            out = b" " + out
        if out and raw[-1] in _WHITE:
            out += b" "
        if not out and not within:
            out = b" "
        within = raw[-1] in _WHITE
        if out:
            yield out


def same(a: bytes, b: bytes) -> bool:
    """Whether two texts are equal once normalised: their pieces stream past each
    other up to the first difference."""
    if a == b:
        return True
    left, right = normalised(a), normalised(b)
    x = y = b""
    while True:
        x, y = x or next(left, b""), y or next(right, b"")
        n = min(len(x), len(y))
        if not n:
            return not x and not y
        if x[:n] != y[:n]:
            return False
        x, y = x[n:], y[n:]


def _packed(found: Fingerprint) -> bytes:
    return b"".join(x.to_bytes(8, "big") for x in (found[0], *found[1]))


def _of_short(rows: DataFrame) -> DataFrame:
    """(doc_id, raw, text_sha256, mark) of texts (doc_id, raw, text) of one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, 2):
            texts = [b"".join(normalised(x.as_py())) for x in batch.column(2)]
            digests = [hashlib.sha256(x).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests), pa.array(map(_packed, of_pieces(texts)), pa.binary())], ["doc_id", "raw", "text_sha256", "mark"])

    return rows.mapInArrow(tidy(run), "doc_id long, raw long, text_sha256 string, mark binary")


def _of_long(rows: DataFrame) -> DataFrame:
    """As :func:`_of_short` for longer texts, whose pieces are hashed apart. The
    pieces are written once, so that a row's mark for them stays when a lost task
    runs again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                row, whole, at = uuid.uuid4().bytes, hashlib.sha256(), -1
                for at, piece in enumerate(normalised(text.as_py())):
                    whole.update(piece)
                    yield pa.RecordBatch.from_pydict({"row": [row], "at": pa.array([at], pa.int32()), "piece": [piece], "doc_id": pa.array([None], pa.int64()), "raw": pa.array([None], pa.int64()), "text_sha256": pa.array([None], pa.string())})
                yield pa.RecordBatch.from_pydict({"row": [row], "at": pa.array([at + 1], pa.int32()), "piece": [b""], "doc_id": pa.array([doc_id.as_py()], pa.int64()), "raw": pa.array([raw.as_py()], pa.int64()), "text_sha256": [whole.hexdigest()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, 2):
            found = of_pieces(batch.column(2).to_pylist())
            shifts = [[pow(r, n, p) for r, p in zip(BASES, PRIMES, strict=True)] for n, _ in found]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array([n for n, _ in found], pa.int64()), pa.array([list(v) for _, v in found], longs), pa.array(shifts, longs)], ["row", "at", "doc_id", "raw", "text_sha256", "n", "value", "shift"])

    kinds = "doc_id long, raw long, text_sha256 string"
    pieces = stored(rows.mapInArrow(cut, f"row binary, at int, piece binary, {kinds}"))
    hashed = pieces.repartition("row", "at").mapInArrow(run, f"row binary, at int, {kinds}, n long, value array<long>, shift array<long>")
    listed = hashed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "value", "shift"))).alias("parts"), *(F.max(c).alias(c) for c in ("doc_id", "raw", "text_sha256")))
    start = F.array(*(F.lit(0).cast("long") for _ in PRIMES))

    def step(a: Column, x: Column) -> Column:
        return F.array(*((a[k] * x["shift"][k] + x["value"][k]) % p for k, p in enumerate(PRIMES)))

    value = F.aggregate("parts", start, step)
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    listed = listed.select("doc_id", "raw", "text_sha256", size.alias("n"), value.alias("value"))
    hexed = (F.lpad(F.hex(x), 16, "0") for x in (F.col("n"), *(F.col("value")[k] for k in range(len(PRIMES)))))
    return listed.select("doc_id", "raw", "text_sha256", F.unhex(F.concat(*hexed)).alias("mark"))


def fingerprinted(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, raw, text_sha256, mark) for each row of ``docs``: a hash of the
    text as it is, and the digest and fingerprint of its normalised bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("raw"), F.encode("t", "UTF-8").alias("text"))
    short = F.length("text") <= piece
    return _of_short(rows.where(short)).union(_of_long(rows.where(~short)))


def _joined(rows: DataFrame, classes: DataFrame, total: int, how: str) -> DataFrame:
    """``rows`` with the columns of ``classes`` (mark, n, ...): by broadcast for
    classes of at least a share of 1 / ``HOT`` of all rows, which are ``HOT`` at
    most, so that no task of the other join meets a greater one."""
    large = F.col("n") * HOT >= total
    hot = F.broadcast(classes.where(large))
    rest = rows.join(hot.select("mark"), "mark", "left_anti").join(classes.where(~large), "mark", how)
    return rows.join(hot, "mark").unionByName(rest)


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, raw, mark) of those of ``members`` (doc_id, raw, mark, n, lead)
    whose texts differ from their class's first document."""
    own = members.select("doc_id", "raw", "mark", "n", ((F.col("lead.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("lead.raw") == F.col("raw"))).alias("leads")).distinct()
    groups = F.ceil(F.col("n") / MEMBERS).cast("int")
    group = F.pmod(F.xxhash64("doc_id", "raw"), groups).cast("int")
    # The first document goes to all groups of its class, the others to one.
    to = F.when(F.col("leads"), F.sequence(F.lit(0), groups - 1)).otherwise(F.array(group))
    own = stored(own.select("mark", "leads", to.alias("to"), F.col("doc_id").alias("want"), F.col("raw").alias("key")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Always by shuffle, so that what moves grows with the texts alone.
    found = texts.join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("want")) & (F.xxhash64("text") == F.col("key")))
    found = found.select("mark", F.explode("to").alias("to"), "leads", "doc_id", F.col("key").alias("raw"), F.encode("text", "UTF-8").alias("text"))
    dealt = found.repartition("mark", "to").sortWithinPartitions("mark", "to", F.desc("leads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, b""
        for batch in arrow_slices(batches, 5):
            keep = []
            marks, groups, leads = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(batch.column(5)):
                here = (marks[i], groups[i])
                if leads[i]:
                    at, first = here, text.as_py()
                    continue
                assert at == here, "a class's first document must come before the others"
                if not same(first, text.as_py()):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (3, 4, 0)], ["doc_id", "raw", "mark"])

    return dealt.mapInArrow(tidy(run), "doc_id long, raw long, mark binary")


def _least() -> Column:
    """The first document of a class: that of the least id, null last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("raw"))).alias("lead")


def classes(docs: DataFrame, mark_bits: int | None = None, piece: int = PIECE) -> DataFrame:
    """(doc_id, raw, text_sha256, mark, keep_id, group_size) for each row of
    ``docs``; rows of equal ``mark`` are exact copies of each other once
    normalised. ``mark_bits`` shortens fingerprints, for tests of what happens
    to texts that only share one."""
    rows = fingerprinted(docs, piece)
    if mark_bits is not None:
        rows = rows.withColumn("mark", F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("mark"), F.lit(1 << mark_bits))), 16, "0")))
    rows = stored(rows)
    total, left = rows.count(), None
    while True:
        candidates = rows if left is None else left
        shared = candidates.groupBy("mark").agg(F.count("*").alias("n"), _least()).where("n > 1")
        members = _joined(candidates.select("doc_id", "raw", "mark"), stored(shared), total, "inner")
        apart = stored(_differing(docs, members))
        if apart.isEmpty():
            break
        # What differs from its first document gets a class of its own.
        fresh = apart.distinct().withColumn("new", F.unhex(F.concat(F.hex("mark"), F.lit("00"))))
        keys = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.raw") == F.col("b.raw"), F.col("a.mark") == F.col("b.mark")]
        moved = rows.alias("a").join(fresh.alias("b"), keys[0] & keys[1] & keys[2], "left")
        rows = stored(moved.select("a.doc_id", "a.raw", "a.text_sha256", F.coalesce("b.new", "a.mark").alias("mark")))
        left = rows.join(fresh.select(F.col("new").alias("mark")).distinct(), "mark", "left_semi")
    sizes = stored(rows.groupBy("mark").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id")).where("n > 1"))
    out = _joined(rows, sizes, total, "left").withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return out.withColumn("group_size", F.coalesce("n", F.lit(1)).cast("long")).drop("n")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of
    ``docs``: the least doc_id of its equal texts, and their number.

    Texts are equal when they are once each run of spaces, tabs and line ends is
    one space; runs at either end stay as one space. A null text is an empty one,
    and empty texts are equal. Repeated rows are copies of each other; all rows
    that have the least id are ``kept`` (:func:`deduplicated` leaves one). A null
    doc_id takes part: a group's keep_id is its least non-null one, and null,
    with all its rows kept, if there is none. An empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return classes(docs).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts: that of the least
    doc_id, null last; among repeated rows any may stay. Columns of any name
    pass; an empty table gives an empty result."""
    first = classes(docs).groupBy("mark").agg(_least()).select(F.col("lead.doc_id").alias("id"), F.col("lead.raw").alias("raw"))
    name = free_name(docs.columns, "raw")
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same_row = keyed["doc_id"].cast("long").eqNullSafe(first["id"]) & (keyed[name] == first["raw"])
    return keyed.join(first, same_row, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
