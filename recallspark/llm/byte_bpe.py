"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file (token bytes and rank a line) becomes a vocabulary and merges of
the ``tokenizers`` library: bytes are written as the printable characters of
the byte table, and a token's merges are all its splits into two tokens. Texts
are split by the given pattern, each piece is encoded alone (equal pieces of a
task once, in a bounded cache), and ids, offsets and decoded bytes are columns.
The rank file is read on the driver; its fixed size bounds what is sent.
"""

from __future__ import annotations

import base64
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_slices, free_name, give_back, tidy

#: Pieces whose ids a task keeps, and those not kept; bytes encoded and rows decoded at a time.
_CACHE_PIECES, _LONG_PIECE, _SLICE, _ROWS = 100_000, 64, 1 << 19, 100


def byte_table() -> dict[int, str]:
    """Byte to printable character: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


@dataclass(frozen=True)
class Vocabulary:
    """A serialised tokenizer, the bytes of each id, and the split pattern."""

    model: str
    pieces: tuple[bytes, ...]
    pattern: str

    @staticmethod
    def from_ranks(path: str, pattern: str) -> Vocabulary:
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        table = byte_table()
        shown = {t: "".join(map(table.__getitem__, t)) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.__getitem__):
            halves = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(halves, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
        own = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            pieces[r] = t
        return Vocabulary(own.to_str(), tuple(pieces), pattern)

    def parts(self) -> tuple[str, tuple[bytes, ...], str]:
        """What tasks get: plain values, which need no import there."""
        return self.model, self.pieces, self.pattern


class _Pieces(dict):
    """Ids of pieces, as the bytes of 32-bit numbers, by the model alone on their
    mapped bytes. Emptied when full; long pieces are not kept."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model).model
        self.table = byte_table()

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]).tobytes()
        if len(piece) <= _LONG_PIECE:
            if len(self) >= _CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int32)))


def character_offsets(data: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Start and end (exclusive) of each token in characters, and how many token
    borders lie inside a character; such a character belongs to both tokens."""
    raw = np.frombuffer(data, np.uint8)
    lead = (raw & 0xC0) != 0x80
    char = np.cumsum(lead, dtype=np.int32) - 1
    ends = np.cumsum(widths)
    if not len(ends):
        return ends.astype(np.int32), ends.astype(np.int32), 0
    return char[ends - widths], char[ends - 1] + 1, int((~lead[ends[:-1]]).sum())


def _encoder(sent: Broadcast, keep: list[str], at: int, offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the kept columns and a text in column ``at`` to those with ids."""
    names = [*keep, "ids", "n_split", *(["starts", "ends"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, tokens, pattern = sent.value
        width = np.array([len(p) for p in tokens], np.int64)
        find, pieces = regex.compile(pattern).findall, _Pieces(model)
        give_back()  # reading the model takes twice what it holds
        for batch in arrow_slices(batches, at, _SLICE):
            ids, starts, ends, split = [], [], [], []
            for text in batch.column(at).to_pylist():
                own = np.frombuffer(b"".join(map(pieces.__getitem__, find(text or ""))), np.int32)
                a, b, n = character_offsets((text or "").encode(), width[own])
                ids.append(own)
                split.append(n)
                if offsets:
                    starts.append(a)
                    ends.append(b)
            made = [_lists(ids), pa.array(split, pa.int64()), *([_lists(starts), _lists(ends)] if offsets else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names)

    return run


def _decoder(sent: Broadcast, names: list[str], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with ids in column ``at`` to those with ``decoded`` at their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces, _ = sent.value
        flat, width = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(width) - width
        for batch in (x.slice(i, _ROWS) for x in batches for i in range(0, len(x), _ROWS)):
            lists = batch.column(at)
            ids = lists.flatten().to_numpy()
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            ends = np.cumsum(width[ids])
            # Each byte's place in the table: its token's start and its place in the token.
            own = np.repeat(start[ids] - ends + width[ids], width[ids]) + np.arange(ends[-1] if len(ends) else 0)
            borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            done = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(flat[own].tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, done.cast(pa.binary())], [*names, "decoded"])

    return run


def _digester(sent: Broadcast, names: list[str], with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the kept columns, ids, n_split and decoded to those with digests:
    hashed where they are made, so that no decoded text goes back to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        shown = [str(i) for i in range(len(sent.value[1]))]
        for batch in batches:
            *kept, ids, split, decoded = batch.columns
            lists = (x.values.to_numpy().tolist() for x in ids)
            made = [
                pc.list_value_length(ids).cast(pa.int64()),
                pa.array([sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in lists], pa.string()),
                pa.array([sha256(x.as_buffer()).hexdigest() for x in decoded], pa.string()),
                split,
            ]
            yield pa.RecordBatch.from_arrays([*kept, *made, *([ids] if with_ids else [])], names)

    return run


def _once(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives a row for each row, where rows equal to the one before
    in every column, as the copies of a mixture are, are worked out with it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: deque[int] = deque()

        def firsts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = np.ones(len(batch), bool)
                if len(batch) > 1 and not any(pa.types.is_nested(c.type) for c in batch.columns):
                    equal = (pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False) for c in batch.columns)
                    new[1:] = ~np.logical_and.reduce([x.to_numpy(zero_copy_only=False) for x in equal])
                at = np.flatnonzero(new)
                times.extend(np.diff(np.append(at, len(batch))).tolist())
                yield batch if new.all() else batch.take(pa.array(at))

        for out in run(firsts()):
            n = [times.popleft() for _ in range(len(out))]
            yield out if sum(n) == len(n) else out.take(pa.array(np.repeat(np.arange(len(n)), n)))

    return wrapped


def _with_text(df: DataFrame, keep: tuple[str, ...], text_col: str) -> tuple[DataFrame, int]:
    """The kept columns and the text, once, and the text's place."""
    if text_col in keep:
        return df.select(*keep), keep.index(text_col)
    return df.select(*keep, F.col(text_col).alias(free_name(keep, "text"))), len(keep)


_IDS = [StructField("ids", ArrayType(IntegerType())), StructField("n_split", LongType())]
_PLACES = [StructField(x, ArrayType(IntegerType())) for x in ("starts", "ends")]
_DECODED = StructField("decoded", BinaryType())
_DIGESTS = [StructField("n_tokens", LongType()), *(StructField(x, StringType()) for x in ("ids_sha256", "decoded_sha256")), _IDS[1]]


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int>), ``n_split`` (token borders inside a
    character) and, if asked, ``starts`` and ``ends`` in characters.

    Whole texts, without special tokens. Null is the empty text: no ids. Rows
    are independent, so ties, repeats and other columns need no care; an empty
    table gives an empty result.
    """
    rows, at = _with_text(df, keep, text_col)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary.parts())
    kinds = [*rows.schema.fields[: len(keep)], *_IDS, *(_PLACES if offsets else [])]
    return rows.mapInArrow(tidy(_encoder(sent, list(keep), at, offsets)), StructType(kinds))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` with ``decoded`` (binary) in place of any of that
    name: the bytes of the ids one after the other. Tokens that hold parts of a
    character are joined as bytes first, so a split character comes back whole.
    Null ids give no bytes."""
    rows = df.drop("decoded")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary.parts())
    return rows.mapInArrow(_decoder(sent, rows.columns, rows.columns.index(ids_col)), StructType([*rows.schema.fields, _DECODED]))


def round_trip_digests(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and n_split of
    encoding and decoding again, both in one task; with ``ids`` if asked."""
    rows, at = _with_text(docs, keep, "text")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.parts())
    kinds = [*rows.schema.fields[: len(keep)], *_DIGESTS, *(_IDS[:1] if with_ids else [])]
    there, back = _encoder(sent, list(keep), at, False), _decoder(sent, [*keep, "ids", "n_split"], len(keep))
    digests = _digester(sent, [x.name for x in kinds], with_ids)
    return rows.mapInArrow(tidy(_once(lambda batches: digests(back(there(batches))))), StructType(kinds))
