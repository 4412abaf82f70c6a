"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, by the
scaled forward recursion, whatever its length; a text's is the product over its
words, as pieces do not cross white space. Piece probabilities are fitted by expectation maximisation:
expected piece counts of words (forward and backward) are computed in Spark
tasks and summed by (language, piece). Fitting takes a bounded sample of
``SAMPLE_DOCS`` labelled documents a language, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_slices, cut, free_name, held_out, tidy

#: Labelled documents a language that the fit reads, at most about.
SAMPLE_DOCS = 600
ROUNDS = 2
UNDETERMINED = "und"
#: Probability of a character that no piece covers, and counts added to each piece.
UNSEEN, PRIOR = 1e-7, 0.05
_CACHE_WORDS, _CACHE_CHARS = 200_000, 8_000_000
#: Places between two scalings, and characters that one run of the recursions takes, unless one word has more.
_SCALE, _BLOCK = 16, 1 << 17


def public_pieces(model_file: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece model, lower-cased, word start as a space."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = (m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))
    return tuple(sorted({p.lower().replace("▁", " ") for p in own}))


_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20


class Segmenter:
    """Sums over all segmentations of many words at once.

    Words stand in one array of code points, with zeros between. Every substring
    of up to the longest piece's length is looked up by a rolling hash, which a
    table maps to piece numbers; the recursions then take one position of all
    words at a time."""

    def __init__(self, pieces: tuple[str, ...], table: np.ndarray) -> None:
        """table: a row of probabilities (one a language) for each piece."""
        self.longest = max(map(len, pieces), default=1)
        self.n, self.pieces = table.shape[1], len(pieces)
        # After the pieces: an uncovered character, and no piece.
        self.table = np.concatenate([table, np.full((1, self.n), UNSEEN), np.zeros((1, self.n))])
        hashes = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            for c in p:
                hashes[i : i + 1] = hashes[i : i + 1] * _P + np.uint64(ord(c) + 1)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts and lengths of the words, and by length the piece at each place."""
        flat = "\0".join(words) + "\0"
        c = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 1) - sizes - 1
        code = np.where(c > 0, c + np.uint64(1), np.uint64(0))
        clear = np.cumsum(c == 0)
        found, h = [], np.zeros(len(c), np.uint64)
        for size in range(1, self.longest + 1):
            m = len(c) - size + 1
            if m <= 0:
                break
            h = h[:m] * _P + code[size - 1 :]
            at = np.full(len(c), self.pieces + 1, np.int32)
            may = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)] & (clear[:m] == clear[size - 1 :]) & (c[:m] > 0))
            if len(may) and self.pieces:
                spot = np.minimum(np.searchsorted(self.sorted, h[may]), self.pieces - 1)
                hit = self.sorted[spot] == h[may]
                at[may[hit]] = self.number[spot[hit]]
            if size == 1:
                at[(at > self.pieces) & (c > 0)] = self.pieces
            found.append(at)
        return starts, sizes, found

    def _sums(self, starts: np.ndarray, sizes: np.ndarray, found: list[np.ndarray], table: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums at each place (before its character), or backward ones,
        as numbers and the logarithms of their scales. ``sizes`` must descend.
        Every ``_SCALE`` places, the sums that later ones read are divided by
        the newest, so that a word of any length is summed whole."""
        out = np.zeros((len(found[0]) + 1, table.shape[1]))
        log, scale = np.zeros_like(out), np.zeros((len(sizes), table.shape[1]))
        out[starts + (sizes if back else 0)] = 1.0
        for i in range(1, int(sizes.max()) + 1):
            own = np.searchsorted(-sizes, -i, "right")
            s, e = starts[:own], sizes[:own]
            here = s + (e - i if back else i)
            log[here] = scale[:own]
            for size in range(1, min(i, len(found)) + 1):
                first = here if back else here - size
                piece = found[size - 1][first]
                use = np.flatnonzero(piece <= self.pieces)
                if len(use):
                    out[here[use]] += out[(here + size if back else first)[use]] * table[piece[use]]
            if i % _SCALE == 0:
                read = here[:, None] + np.arange(min(i + 1, len(found))) * (1 if back else -1)
                newest = out[here]
                out[read] /= newest[:, None]
                scale[:own] += np.log(newest)
                log[read] = scale[:own, None]
        return out, log

    def _blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """The words in descending length, in blocks of about ``_BLOCK`` characters."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        block = np.cumsum(sizes[order]) // _BLOCK
        for own in np.split(order, np.flatnonzero(np.diff(block)) + 1):
            yield own, [words[i] for i in own]

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """A row a word of any length, a column a language."""
        out = np.empty((len(words), self.n))
        for own, block in self._blocks(words):
            starts, sizes, found = self._found(block)
            a, log = self._sums(starts, sizes, found, self.table, False)
            with np.errstate(divide="ignore"):
                out[own] = np.log(a[starts + sizes]) + log[starts + sizes]
        return out

    def expected(self, words: list[str], weights: np.ndarray, k: int) -> np.ndarray:
        """Expected count of each piece in the words for language ``k``."""
        own = np.ascontiguousarray(self.table[:, k : k + 1])
        out = np.zeros(self.pieces + 2)
        for chosen, block in self._blocks(words):
            starts, sizes, found = self._found(block)
            (a, at), (b, bt) = self._sums(starts, sizes, found, own, False), self._sums(starts, sizes, found, own, True)
            end = starts + sizes
            z, whole = np.zeros(len(a)), np.zeros(len(a))
            word = np.repeat(np.arange(len(block)), sizes + 1)
            z[: len(word)] = (weights[chosen] / a[end, 0])[word]
            whole[: len(word)] = at[end, 0][word]
            for size, piece in enumerate(found, 1):
                j = np.flatnonzero(piece <= self.pieces)
                scale = np.exp(at[j, 0] + bt[j + size, 0] - whole[j])
                out += np.bincount(piece[j], weights=z[j] * (a[j, 0] * scale) * own[piece[j], 0] * b[j + size, 0], minlength=len(out))
        return out[: self.pieces]


def letters(word: str) -> str:
    """The letters of a lower-cased word, led by a space; empty without a letter."""
    own = "".join(filter(str.isalpha, word))
    return f" {own}" if own else ""


def _table(pieces: tuple[str, ...], langs: list[str], counts: list[tuple[int, int, float]] | None) -> np.ndarray:
    """Row a piece, column a language; at first by length alone."""
    if counts is None:
        t = np.array([[0.05 ** len(p)] * len(langs) for p in pieces]).reshape(len(pieces), len(langs))
    else:
        t = np.full((len(pieces), len(langs)), PRIOR)
        for k, piece, n in counts:
            t[piece, k] += n
    return t / t.sum(axis=0, keepdims=True)


def fit(labelled: DataFrame, pieces: tuple[str, ...], sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their piece probabilities, and log priors, from (doc_id, text,
    lang). Null texts and languages are left out. Without labelled rows the
    list is empty."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null")
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs, total = [x for x, _ in sizes], sum(n for _, n in sizes)
    if not langs:
        return [], np.empty((len(pieces), 0)), np.empty(0)
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample_docs / n))))
    point = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_003)) / 1_000_003
    words = rows.where(point < share[F.col("lang")]).select("lang", F.explode(F.split(F.lower("text"), "\\s+")).alias("w"))
    counts = cut(words.where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n")))

    table = _table(pieces, langs, None)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, langs, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, langs, table = sent.value
            seg, got = Segmenter(pieces, table), np.zeros((len(langs), len(pieces)))
            for batch in batches:
                lang, words, n = (c.to_pylist() for c in batch.columns)
                for k, x in enumerate(langs):
                    own = [(s, c) for y, w, c in zip(lang, words, n, strict=True) if y == x and (s := letters(w))]
                    if own:
                        got[k] += seg.expected([s for s, _ in own], np.array([c for _, c in own], float), k)
            k, piece = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(got[k, piece])], ["lang", "piece", "n"])

        made = counts.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        table = _table(pieces, langs, [tuple(r) for r in made.collect()])
    return langs, table, np.log([n / total for _, n in sizes])


def predict(docs: DataFrame, pieces: tuple[str, ...], model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and the two of ``names``: language and score, from whole
    texts alone. ``keep`` may have no column of those names.

    The score is the posterior probability of the language. A text that is null
    or has no letter, or any text when nothing was learned, is ``und`` with
    score 0. Ties go to the language first in the alphabet. Rows are
    independent, so repeats need no care; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((pieces, *model))
    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias(free_name(keep, "text"))]))
    at = rows.columns.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, table, prior = sent.value
        seg, known, chars = Segmenter(pieces, table), {}, 0
        vectors = np.zeros((1, len(langs)))  # row 0 is for words without letters
        for batch in arrow_slices(batches, at, 1 << 20):
            lang, score = [], []
            texts = [(x or "").lower().split() for x in batch.column(at).to_pylist()]
            if langs:
                new = set(chain.from_iterable(texts)).difference(known)
                if len(known) + len(new) > _CACHE_WORDS or chars > _CACHE_CHARS:
                    known, vectors, new, chars = {}, vectors[:1], set(chain.from_iterable(texts)), 0
                chars += sum(map(len, new))
                spelt = [(w, s) for w in new if (s := letters(w))]
                known |= dict.fromkeys(new, 0) | {w: len(vectors) + i for i, (w, _) in enumerate(spelt)}
                if spelt:
                    vectors = np.concatenate([vectors, seg.log_likelihoods([s for _, s in spelt])])
            for words in texts:
                own = np.fromiter(map(known.__getitem__, words), np.int64, len(words)) if langs else np.zeros(0, int)
                if not own.any():
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                x = vectors[own].sum(axis=0) + prior
                best = int(x.argmax())
                lang.append(langs[best])
                score.append(float(1 / np.exp(x - x[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    kinds = StructType([*rows.schema.fields[: len(keep)], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return rows.mapInArrow(tidy(run), kinds)


def identify(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), sample_docs: int = SAMPLE_DOCS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Fits on the documents outside the held-out fold and predicts for all, as
    :func:`predict`. Repeated rows and null ids are rows like others."""
    pieces = public_pieces(model_file)
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(4, 2)), pieces, sample_docs)
    return predict(docs, pieces, model, keep, names)
