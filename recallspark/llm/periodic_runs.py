"""Periodic runs of words, by online catching of squares in dyadic blocks.

Words are appended in order. Each completed block of s = 2**j words, from a on,
gets a catcher: for every word appended later, the suffix of s words that it
completes, from x on, is compared with the block while s <= x - a < 2 s, so that
each word advances one comparison a level. (The least level, of ``LEAST`` words,
takes all distances under 2 s.) Equal stretches at distance q are a square once
they are q words long; the catch is extended to both sides, word by word, and
overlapping squares of a period are merged into one run. A run that ends with
the last word so far stays open and is extended by the words appended next.

A run of period q and at least max(24, 3 q) words has max(24 - q, 2 q) words or
more that equal those q before, and so holds a whole block of the level of q: none
is missed. A catch that lies in a known run whose period divides its distance
tells nothing new and is left out, so that highly periodic texts cost no more.

Suffixes and blocks are compared by differences of prefix sums modulo 2**64, all
suffixes of the appended words at once; words are numbered exactly, and every run
is extended on these numbers, so equal hashes alone never make one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, tidy

#: Words of the least blocks; the least length of a run, and its least exponent.
LEAST, SHORTEST, EXPONENT = 8, 24, 3
#: Words appended at a time, and bytes of text that are split into words at a time.
CHUNK, SLICE = 1 << 16, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Squares:
    """Catchers over the words (numbers) appended so far; ``runs`` gives the runs.

    ``longest`` bounds the texts among the words, where several that are divided
    by words of their own are appended one after the other: no run is longer."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest, self.n = longest, 0
        self.ids, self.sums, self.powers = np.empty(0, np.int64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
        self.done: dict[int, int] = {}  # of each block size, blocks whose catcher has seen all its words
        self.found: list[list[int]] = []  # start, end, period
        self.reach, self.owner = np.empty(0, np.int64), np.empty(0, np.int64)  # the farthest end of a run over a word, and its period

    def _grow(self, n: int) -> None:
        if n <= len(self.ids):
            return
        room = n if not len(self.ids) else max(n, 2 * len(self.ids))
        more = lambda x, size, fill: np.concatenate([x, np.full(size - len(x), fill, x.dtype)])
        self.ids, self.reach, self.owner = (more(x, room, f) for x, f in ((self.ids, 0), (self.reach, 0), (self.owner, 1)))
        self.sums = more(self.sums, room + 1, 0)
        powers = np.full(room + 1, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)

    def append(self, ids: np.ndarray) -> None:
        """Takes further words: runs at the end so far go on, then the catchers
        of each level look at the new suffixes, short periods first."""
        if not len(ids):
            return
        old, self.n = self.n, self.n + len(ids)
        self._grow(self.n)
        self.ids[old : self.n] = ids
        terms = _mixed(np.asarray(ids, np.int64)) * self.powers[old : self.n]
        self.sums[old + 1 : self.n + 1] = self.sums[old] + np.cumsum(terms, dtype=np.uint64)
        for run in self.found:
            if run[1] == old:
                run[1] = self._right(run[1], run[2])
                self._cover(run)
        size, most = LEAST, self.n if self.longest is None else self.longest
        while size == LEAST or EXPONENT * size <= most:
            if self.n >= 2 * size:
                self._catch(size)
            size *= 2

    def _catch(self, s: int) -> None:
        """Compares suffixes of s words with the blocks that wait for them. A
        block whose words are not all there yet is looked at again later."""
        first = self.done.get(s, 0)
        starts = np.arange(first * s, self.n - s + 1, s)
        whole = (self.n - 3 * s + 1) // s + 1 if self.n >= 3 * s else 0  # blocks that have seen all their suffixes
        self.done[s] = max(first, whole)
        window = self.sums[first * s + s : self.n + 1] - self.sums[first * s : self.n + 1 - s]
        rows = -(-len(window) // s)
        window = np.concatenate([window, np.zeros((rows + 2) * s - len(window), np.uint64)]).reshape(-1, s)
        own, limit = window[: len(starts), :1], self.n - s
        caught = []
        if s == LEAST:
            block, t = np.nonzero(window[: len(starts), 1:] == own * self.powers[1:s])
            caught.append((block, t + 1))
        block, t = np.nonzero(window[1 : len(starts) + 1] == own * self.powers[s : 2 * s] if self.n >= 2 * s else np.zeros((0, s), bool))
        caught.append((block, t + s))
        a, q = starts[np.concatenate([c[0] for c in caught])], np.concatenate([c[1] for c in caught])
        real = a + q <= limit
        a, q = a[real], q[real]
        known = (self.reach[a] >= a + q + s) & (q % self.owner[a] == 0)
        a, q = a[~known], q[~known]
        order = np.lexsort((a, q))
        ends: dict[int, int] = {}
        for at, period in zip(a[order].tolist(), q[order].tolist(), strict=True):
            if at + s + period <= ends.get(period, -1) or (self.reach[at] >= at + period + s and period % self.owner[at] == 0):
                continue  # of a stretch that has been extended, or of a run found meanwhile
            ends[period] = self._extended(at, s, period)

    def _right(self, end: int, q: int) -> int:
        """Where the words from ``end`` on stop equalling those q before."""
        step = 16
        while end < self.n:
            n = min(step, self.n - end)
            apart = np.flatnonzero(self.ids[end : end + n] != self.ids[end - q : end - q + n])
            if len(apart):
                return end + int(apart[0])
            end, step = end + n, min(step * 2, CHUNK)
        return end

    def _left(self, start: int, q: int) -> int:
        """Where the words before ``start`` begin to equal those q after."""
        step = 16
        while start > 0:
            n = min(step, start)
            apart = np.flatnonzero(self.ids[start - n : start] != self.ids[start - n + q : start + q])
            if len(apart):
                return start - n + int(apart[-1]) + 1
            start, step = start - n, min(step * 2, CHUNK)
        return start

    def _extended(self, at: int, s: int, q: int) -> int:
        """Extends a catch on the words themselves; the end of its stretch."""
        if (self.ids[at : at + s] != self.ids[at + q : at + q + s]).any():
            return at  # hashes only
        start, end = self._left(at, q), self._right(at + q + s, q)
        if end - start >= 2 * q:
            run = [start, end, q]
            self.found.append(run)
            self._cover(run)
        return end

    def _cover(self, run: list[int]) -> None:
        start, end, q = run
        part = self.reach[start:end]
        farther = part < end
        part[farther] = end
        self.owner[start:end][farther] = q

    def runs(self) -> list[Run]:
        """(start, length, period) of the runs of at least max(24, 3 periods)
        words, by start and period; periods are the least ones."""
        best: dict[tuple[int, int], int] = {}
        for start, end, q in self.found:
            if end - start >= max(SHORTEST, EXPONENT * q):
                best[start, end] = min(q, best.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in best.items())


def words_of(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists; a slice ends before a word's end never."""
    at, white = 0, b" \t\n\x0b\x0c\r"
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in white:
            end += 1
        yield data[at:end].split()
        at = end


def numbered(data: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; equal words have equal ones."""
    parts = [np.empty(0, np.int64)]
    for words in words_of(data):
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts)


def runs_of(ids: np.ndarray) -> list[Run]:
    """The runs of one text's numbered words."""
    squares = Squares()
    for s in range(0, len(ids), CHUNK):
        squares.append(ids[s : s + CHUNK])
    return squares.runs()


def runs_of_many(texts: list[np.ndarray]) -> list[list[Run]]:
    """As :func:`runs_of` for several texts, appended one after the other with a
    word of its own after each, which no run can hold: one pass over them all."""
    if not texts:
        return []
    squares, starts = Squares(max(map(len, texts))), np.cumsum([0] + [len(t) + 1 for t in texts])
    whole = np.full(starts[-1], -1, np.int64)
    for i, (at, t) in enumerate(zip(starts.tolist(), texts, strict=False)):
        whole[at : at + len(t)] = t
        whole[at + len(t)] = -2 - i
    squares.append(whole)
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, q in squares.runs():
        i = int(np.searchsorted(starts, start, "right")) - 1
        out[i].append((start - int(starts[i]), length, q))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words are kept: those in no run after its first period."""
    kept = np.ones(n, bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return kept


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; the first, then the shorter
    period, among equals."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


#: From n words of a document, which word stands at each place; None: as they are.
Order = Callable[[int | None, int], np.ndarray | None]
KINDS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256) for each row of ``docs``: all runs
    (start, length, period) of its whole text by start and period, and the digest
    of the text's words without what runs repeat, joined by single spaces.

    A null text is an empty one, without words and runs. Repeated rows have equal
    results; a null doc_id stays null. An empty table gives an empty result;
    columns other than doc_id and text are not read. ``order`` puts other words
    of a document in the places of its words, before runs are sought.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in arrow_slices(batches, 1, 1 << 20):
            ids = batch.column(0).to_pylist()
            data = [x.as_py() for x in batch.column(1)]
            numbers: dict[bytes, int] = {}
            texts = [numbered(x, numbers) for x in data]
            places = [order(i, len(t)) if order and len(t) else None for i, t in zip(ids, texts, strict=True)]
            texts = [t if p is None else t[p] for t, p in zip(texts, places, strict=True)]
            if sum(map(len, texts)) > 4 * CHUNK:  # a long text: by itself
                found = [runs_of(t) for t in texts]
            else:
                found = runs_of_many(texts)
            names = list(numbers) if any(p is not None for p in places) else None
            digests = []
            for x, t, p, own in zip(data, texts, places, found, strict=True):
                kept, digest, at = kept_words(len(t), own), hashlib.sha256(), 0
                parts = words_of(x) if p is None else ([names[i] for i in t[s : s + CHUNK].tolist()] for s in range(0, len(t), CHUNK))
                lead = b""
                for words in parts:
                    if own:
                        words_kept = [w for w, k in zip(words, kept[at : at + len(words)].tolist(), strict=True) if k]
                    else:
                        words_kept = words
                    at += len(words)
                    if words_kept:
                        digest.update(lead + b" ".join(words_kept))
                        lead = b" "
                digests.append(digest.hexdigest())
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, runs_type), pa.array(digests)], ["doc_id", "n_words", "runs", "collapsed_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return rows.mapInArrow(tidy(run), KINDS)


def summarised(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) of the rows of :func:`periodic_runs`: the run of the
    greatest length / period (compared exactly, as products), the first and then
    the shorter period among equals; nulls without runs."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | (
        (a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])))
    )
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), lambda b, r: F.when(better(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("b", best)
    exponent = F.expr("1000 * b.length div b.period").cast("long")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", exponent.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256",
    )
