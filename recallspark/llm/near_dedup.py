"""MinHash near-duplicate detection with b-bit signatures.

One Arrow pass turns every whole text into its set of four-word shingles, 128
minima, 32 band keys of four minima each, and the low four bits of each minimum
packed into eight longs. At a similarity of 0.8 a pair shares a band with
probability 1 - (1 - 0.8**4)**32, over 0.9999999. Candidates from the bands are
estimated from the packed bits (equal nibbles counted with ``bit_count``,
corrected for the 1/16 of chance collisions), those far below the threshold go,
and the rest are confirmed on full sets.

Hot groups. Equal sets are one node before anything is paired. A bucket pairs
its members with its leader only (a star). Members of one leader that this
leaves in different components are compared exactly, by their differences to the
leader's set: an index of the differences that some hold counts what each other
shares with all of them at once. No link between components is lost, and only
links come out, one of a member to a component, not a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, decoded_id, free_name, id_label, stored, tidy

HASHES, ROWS, LOW_BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Estimates are let through from six standard deviations below the threshold.
SLACK = 0.22
#: Members that one group of the verification stage compares with a leader.
CHUNK = 256
#: Differences of members apart from a leader that a group of the last comparison holds.
HELD = 1 << 18

_rng = np.random.default_rng(20240131)
_MUL = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 400_000


class _Words(dict):
    """64-bit hashes of words; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: dict, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _P + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each hash function over the set."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(best, (s[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=best)
    return best >> np.uint64(32)


_BAND_SALT = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P)


def band_keys(m: np.ndarray) -> np.ndarray:
    out = _BAND_SALT.copy()
    for i in range(ROWS):
        out = _mix(out * _P + m.reshape(BANDS, ROWS)[:, i])
    return out.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, sixteen to a long."""
    low = (m & np.uint64(2**LOW_BITS - 1)).reshape(-1, 64 // LOW_BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=1).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands, bits): ``node``, of 128 bits,
    is equal for equal shingle sets and null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n, node, bands, bits = [], [], [], []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py(), words, width)
                n.append(len(s))
                if len(s):
                    m = minima(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(m))
                    bits.append(packed_bits(m))
                else:
                    for x in (node, bands, bits):
                        x.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)],
                ["doc_id", "text_key", "n_shingles", "node", "bands", "bits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, node binary, bands array<long>, bits array<long>")


def estimated_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity from two packed signatures: the share of equal
    nibbles, less what b-bit values collide by chance."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    count = sum((unequal(a[i], b[i]) for i in range(HASHES * LOW_BITS // 64)), F.lit(0))
    chance = 1.0 / 2**LOW_BITS
    return (1 - count / F.lit(float(HASHES)) - chance) / (1 - chance)


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(lead, node, size, linked, delta) for each of ``pairs`` (lead, node, n),
    from full sets; n is the leader's number of members. ``delta`` has what is
    in one of the two sets only, where the leader has further members.

    A leader's text goes once to each chunk of its members and is the only set
    kept between rows; members stream past it."""
    sized = pairs.withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)))
    leaders = sized.select("lead", "chunk").distinct().join(texts, F.col("lead") == texts.node)
    leaders = leaders.select("lead", "chunk", F.lit(None).cast("binary").alias("member"), "text", F.lit(0).cast("long").alias("n"))
    members = sized.join(texts, "node").select("lead", "chunk", F.col("node").alias("member"), "text", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, own = _Words(), None, None
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                k, c, member = (x.as_py() for x in row[:3])
                s = shingle_hashes(row[3].as_py(), words, width)
                if member is None:
                    at, own = (k, c), s
                    continue
                assert at == (k, c), "a leader's text must come before its members"
                apart = np.setxor1d(s, own, assume_unique=True)
                both = len(s) + len(own)
                linked = 100 * (both - len(apart)) >= percent * (both + len(apart))
                rows.append((k, member, len(s), linked, apart.view(np.int64) if row[4].as_py() > 1 else None))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["lead", "node", "size", "linked", "delta"])

    dealt = leaders.union(members).repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", F.col("member").asc_nulls_first())
    return dealt.mapInArrow(tidy(run), "lead binary, node binary, size long, linked boolean, delta array<long>")


class _Held:
    """Members with their differences to one leader, found by what these share."""

    def __init__(self, rows: list[tuple[bytes, int, bytes, np.ndarray]]) -> None:
        self.nodes, sizes, components, deltas = zip(*rows, strict=True)
        self.sizes, self.widths = np.array(sizes, np.int64), np.array([len(d) for d in deltas], np.int64)
        self.codes = {c: i for i, c in enumerate(dict.fromkeys(components))}
        self.component = np.array([self.codes[c] for c in components], np.int64)
        values = np.concatenate(deltas)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), self.widths)[order]
        self.values, self.start = np.unique(values[order], return_index=True)
        self.end = np.append(self.start, len(values))[1:]

    def linked(self, size: int, component: bytes, delta: np.ndarray, percent: int) -> list[bytes]:
        """Of each component but the given one, a member that links, if any does."""
        at = np.minimum(np.searchsorted(self.values, delta), len(self.values) - 1)
        at = at[self.values[at] == delta]
        n = self.end[at] - self.start[at]
        places = np.repeat(self.end[at] - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.nodes))
        apart, both = self.widths + len(delta) - 2 * shared, self.sizes + size
        fits = (100 * (both - apart) >= percent * (both + apart)) & (self.component != self.codes.get(component, -1))
        found = np.flatnonzero(fits)
        return [self.nodes[i] for i in found[np.unique(self.component[found], return_index=True)[1]]]


def _links_of_members(where: DataFrame, percent: int) -> DataFrame:
    """(lead, node): links between the rows of ``where`` (lead, node, size, delta,
    component, main) of one leader in different components, one of them not the
    leader's; of those from a member to a component at least one.

    The members apart are held, dealt to parts by the size of their differences,
    and all members stream past each part, so no task has all of a group's pairs."""
    apart = where.where("component <> main")
    parts = apart.groupBy("lead").agg(F.ceil((F.sum(F.size("delta")) + 1) / HELD).cast("int").alias("parts"))
    shown = ["lead", "part", "held", "node", "size", "component", "delta"]
    held = apart.join(parts, "lead").withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "held": F.lit(True)})
    past = where.join(parts, "lead").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "held": F.lit(False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, index = None, [], None
        for batch in batches:
            links = []
            for row in zip(*batch.columns, strict=True):
                k, part, first, node, size, component = (x.as_py() for x in row[:6])
                delta = row[6].values.to_numpy()
                if at != (k, part):
                    at, own, index = (k, part), [], None
                if first:
                    assert index is None, "held members must come before the others"
                    own.append((node, size, component, delta.copy()))
                elif own:
                    index = index or _Held(own)
                    links += [(x, node) for x in index.linked(size, component, delta, percent)]
            leads, nodes = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.binary()), pa.array(nodes, pa.binary())], ["lead", "node"])

    dealt = held.select(shown).union(past.select(shown)).repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("held"))
    return dealt.mapInArrow(tidy(run), "lead binary, node binary")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component) for each row; component is null
    for texts without words, else a label (of :func:`id_label`) that linked rows
    share, with the least doc_id of them."""
    signed = stored(signatures(docs, id_col, text_col, width))
    # From here on a node is a label that sorts by its least doc_id, so that the
    # least label of a component gives the component's id.
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = stored(nodes.select(F.col("node").alias("key"), id_label("id", "node").alias("node"), "bands", "bits"))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(banded.join(sizes, "bucket"))
    # A bucket's leader is its node with most company in all: an unchanged
    # original has more of it than its edited copies.
    company = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    leads = shared.join(company, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))
    stars = stored(shared.join(leads, "bucket").where("node <> lead").select("lead", "node").distinct())
    stars = stars.join(stars.groupBy("lead").agg(F.count("*").alias("n")), "lead")
    # A leader with one member is compared only if the packed bits allow it.
    mine = nodes.select("node", F.col("bits").alias("x"))
    theirs = nodes.select(F.col("node").alias("lead"), F.col("bits").alias("y"))
    estimate = estimated_similarity(F.col("x"), F.col("y"))
    stars = stars.join(mine, "node").join(theirs, "lead").where((F.col("n") > 1) | (estimate >= percent / 100 - SLACK)).select("lead", "node", "n", "x")
    stars = stored(stars)

    # One text for each node that is compared.
    wanted = stars.select("node").union(stars.select("lead")).distinct().join(nodes.select("node", "key"), "node")
    chosen = signed.select("doc_id", "text_key", F.col("node").alias("key")).join(wanted, "key").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    chosen = chosen.select("node", F.col("r.doc_id").alias("want"), F.col("r.text_key").alias("key"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = source.join(chosen, source.doc_id.eqNullSafe(chosen.want) & (F.xxhash64("text") == chosen.key))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]))
    compared = stored(_compared(stars.select("lead", "node", "n"), texts, width, percent))
    links = compared.where("linked").select("lead", "node")
    groups = cut(connected_components(links, "lead", "node"))

    # Members of one leader that are still apart are compared with its others.
    where = compared.where("delta is not null").join(groups, "node", "left")
    leading = groups.select(F.col("node").alias("lead"), F.col("component").alias("main"))
    where = where.withColumn("component", F.coalesce("component", "node")).join(leading, "lead", "left")
    where = stored(where.select("lead", "node", "size", "delta", "component", F.coalesce("main", "lead").alias("main")))
    more = _links_of_members(where, percent)
    groups = connected_components(links.union(cut(more)), "lead", "node")

    known = nodes.select("key", "node").join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    placed = signed.select("doc_id", "text_key", "n_shingles", F.col("node").alias("key"))
    return placed.join(known, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked where 100 * intersection >= percent * union of their
    shingle sets; ``component_id`` is the least doc_id that links reach.

    A null or empty text has no shingles, links with nothing and keeps its own
    doc_id. Repeated rows are linked copies. A null doc_id takes part in links;
    its group's id is the least non-null one, and null (not kept) if all are.
    An empty table gives an empty result; other columns are not read.
    """
    placed = components(docs, id_col, text_col, width, percent)
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(decoded_id(F.col("component")))
    out = placed.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with the least doc_id of each
    group, one row a group, and all rows whose texts have no words, null ones
    too. Ids that are null come last; among rows of one id and text any may
    stay. Columns of any name pass; an empty table gives an empty result."""
    placed = stored(components(docs, width=width, percent=percent))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    chosen = placed.where("component is not null").groupBy("component").agg(F.min(order).alias("r"))
    name = free_name(docs.columns, "key")
    chosen = chosen.select(F.col("r.b").alias("id"), F.col("r.c").alias("text_key"))
    keyed = docs.withColumn(name, F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(chosen["id"]) & (keyed[name] == chosen["text_key"])
    picked = keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    return picked.union(docs.where(blank))
