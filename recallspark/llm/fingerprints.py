"""Document fingerprints by closed syncmers.

A k-mer of code points is an anchor when the least of its hashed inner s-mers
is its first or last one: a choice that needs no context, so the same passage
has the same anchors wherever it stands. The fingerprint has every anchor in
order, its distance from the one before and its hash. Two fingerprints are
matched by position: equal anchors whose places differ by one shift, two or more
of them, stand for a common passage; likeness is the share of all anchors that
lie in such passages.

Documents and the next ones in descending doc_id meet by a range partitioning on
doc_id and the text's hash: texts move once, and documents of one id are not kept
together. What crosses a border is one row a partition, which also goes to the
partition before it. Repeated rows, of one id and text, are interchangeable and
stay in one partition, where they stream past: nothing hangs on the order in which
a table is read, which may change when a lost task runs again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices

K, S = 32, 8
#: Rows of the sample for each border between partitions.
SAMPLE = 50
_P = np.uint64(0x9E3779B97F4A7C15)
_LEAST = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def closed_syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the anchors of a text. A non-empty text
    without any, as one of fewer than k code points, is one anchor as a whole;
    an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    at = np.empty(0, np.int64)
    if len(c) >= k:
        small = np.zeros(len(c) - s + 1, np.uint64)
        for i in range(s):
            small = small * _P + c[i : len(c) - s + 1 + i]
        small = _mix(small)
        span, least, wide = k - s + 1, small, 1
        while wide * 2 <= span:
            least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
        n = len(small) - span + 1
        least = np.minimum(least[:n], least[span - wide :][:n])
        at = np.flatnonzero((least == small[:n]) | (least == small[span - 1 :]))
    if not len(at):
        whole = hashlib.blake2b(text.encode("utf-32-le"), digest_size=4).digest()
        return np.zeros(1, np.int64), np.frombuffer(whole, np.uint32)
    # The k-mer's hash, from its inner s-mers a step of s apart and its last.
    h = np.zeros(len(at), np.uint64)
    for i in (*range(0, k - s, s), k - s):
        h = h * _P + small[at + i]
    return at, (_mix(h) >> np.uint64(32)).astype(np.uint32)


Anchors = tuple[np.ndarray, np.ndarray]


def shown(anchors: Anchors) -> str:
    """Ten hexadecimal digits an anchor: two of the distance from the one before
    (at most k - s, as every window of so many k-mers has one; from 0 for the
    first), eight of the hash."""
    at, h = anchors
    out = np.empty((len(at), 5), np.uint8)
    out[:, 0] = np.minimum(np.diff(at, prepend=0), 255)
    out[:, 1:] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def read(fingerprint: str) -> Anchors:
    """The anchors of a shown fingerprint."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 0], dtype=np.int64), np.ascontiguousarray(raw[:, 1:]).view(">u4").ravel().astype(np.uint32)


def _numbered(anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Hash and occurrence of each anchor as one number, sorted, and positions."""
    at, h = anchors
    order = np.argsort(h, kind="stable")
    sorted_h = h[order].astype(np.uint64)
    starts = np.flatnonzero(np.diff(sorted_h, prepend=sorted_h[:1] + np.uint64(1)))
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return sorted_h << np.uint64(32) | nth.astype(np.uint64), at[order]


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of all anchors of both that lie in common passages; the n-th of
    equal anchors meets the n-th. Two texts without anchors are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (x, at_x), (y, at_y) = _numbered(a), _numbered(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shifts, n = np.unique(at_x[i] - at_y[j], return_counts=True)
    return float(2 * n[n >= min(2, len(x), len(y))].sum() / (len(x) + len(y)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows of (pid, guest, r, key, doc_id, text), dealt by ranges of descending
    doc_id and sorted; a partition's last row is its guest, the next one's first."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.bitwise_not(F.coalesce("doc_id", F.lit(_LEAST)))
    rows = rows.withColumns({"r": rank, "key": F.xxhash64("text")})
    places = ["r", "key"]
    drawn = F.pmod(F.xxhash64(*places), F.lit(1 << 30)) < F.lit(min(1 << 30, int(SAMPLE * parts / max(rows.count(), 1) * 2**30)))
    sample = sorted(map(tuple, rows.where(drawn).select(*places).distinct().collect())) if parts > 1 else []
    borders = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    @F.pandas_udf("int")
    def part(r: pd.Series, key: pd.Series) -> pd.Series:
        first = np.array([x[0] for x in borders], np.int64)
        at, after = (np.searchsorted(first, r.to_numpy(np.int64), side) for side in ("left", "right"))
        for i in np.flatnonzero(at < after):  # rows whose id is a border's
            at[i] = bisect_left(borders, (r[i], key[i]))
        return pd.Series(at.astype(np.int32))

    pid = part(*places)
    firsts = rows.select(*places, pid.alias("pid")).groupBy("pid").agg(F.min(F.struct(*places)).alias("f")).collect()
    found = sorted((x["pid"], *x["f"]) for x in firsts)
    guests = [(*own, found[i - 1][0]) for i, (_, *own) in enumerate(found)]  # the first goes to the last partition
    sent = F.broadcast(spark.createDataFrame(guests, "r long, key long, pid int"))
    own = rows.withColumn("pid", pid).withColumn("guest", F.lit(0))
    # Of repeated rows that are a guest any one will do.
    more = rows.join(sent, places).groupBy("pid", *places, "doc_id").agg(F.first("text").alias("text")).withColumn("guest", F.lit(1))
    names = ["pid", "guest", *places, "doc_id", "text"]
    dealt = own.select(*names).union(more.select(*names)).repartitionById(parts, F.col("pid"))
    return dealt.sortWithinPartitions("pid", "guest", *places)


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for each row.

    A null text is an empty one. Documents follow each other by descending
    doc_id, null ids last, rows of one id by a hash of the text; after the last comes the first, so a
    single document follows itself. An empty table gives an empty result; columns other than doc_id and text are not read.
    """

    def one(doc_id: int, text: str, own: Anchors, following: str, its: Anchors) -> tuple:
        new = edited(text, following)
        mine = closed_syncmers(new)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(own), shown(mine), likeness(own, mine), likeness(own, its)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in arrow_slices(batches, 5):
            out = []
            for row in zip(*(batch.column(i) for i in (0, 1, 4, 5)), strict=True):
                pid, guest, doc_id, text = (x.as_py() for x in row)
                if held is not None and held[0] != pid:
                    held = None
                own = closed_syncmers(text)
                if held is not None:
                    out.append(one(held[1], held[2], held[3], text, own))
                held = (pid, doc_id, text, own)
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return _with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
