"""Scoring texts with a hidden Markov language model.

Tokens are words and one end a text. Baum-Welch: each task runs scaled forward
and backward recursions over its documents, many at a time, and returns expected
counts, which Spark sums by symbol. The score is the exact likelihood of the
whole text by the scaled forward recursion.

Symbols. The ``WORDS`` most frequent training words have emissions of their own,
which bounds what is sent to tasks. Every other word emits by the class of its
ending, learned like a word, and within the class by its own smoothed count, of
which the corpus gives one for every word: these counts stay in a table and are
joined, never sent whole. A task numbers its rarer words (at most about
``CHUNK_WORDS`` a chunk), so what is joined and shuffled is one narrow row a
chunk and word, and a chunk's texts meet its counts by the chunk's number.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, stored, tidy

WORDS, CLASSES, STATES, ROUNDS = 65_536, 1024, 6, 3
#: Bytes of a word's ending that give its class.
ENDING = 3
#: Words held by a counting task before it passes its counts on; rarer words of a chunk, but for its last text.
_COUNTER_WORDS, CHUNK_WORDS = 250_000, 250_000
#: Tokens that one run of the recursions takes, unless one text has more, and
#: tokens whose forward values are kept at a time.
_CHUNK_TOKENS, _SEGMENT_TOKENS = 250_000, 500_000
#: Bits of a word's count where its place and count are one number.
_COUNT_BITS = 42
STAY, SMOOTH = 0.9, 200.0


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as bytes (the end is not among them)."""
    return text.encode().lower().split() if text else []


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column of texts; each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"])
            own.clear()
            return made

        for batch in batches:
            for value in batch.column(0):
                own.update(tokens(value.as_py()))
                if len(own) > _COUNTER_WORDS:
                    yield out()
        yield out()

    return texts.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLASSES


def class_of(word: Column) -> Column:
    """As :func:`word_class`, of a binary column."""
    ending = F.when(F.length(word) <= ENDING, word).otherwise(F.substring(word, -ENDING, ENDING))
    return (F.crc32(ending) % CLASSES).cast("int")


class _Numbers(dict):
    """Numbers of words: the frequent ones' own, then others in order of
    appearance, with the classes of those."""

    def __init__(self, frequent: dict[bytes, int]) -> None:
        super().__init__(frequent)
        self.base, self.rare, self.classes = len(frequent), [], array("i")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.base + len(self.rare)
        self.rare.append(word)
        self.classes.append(word_class(word))
        return n


_ENCODED = "chunk long, doc_id long, held_out boolean, symbols array<int>, rare array<int>, words array<binary>"


def encoded(docs: DataFrame, frequent: list[bytes]) -> DataFrame:
    """Rows (chunk, doc_id, held_out, symbols, rare) of texts and (chunk, words)
    of chunks. ``symbols`` are frequent words' numbers, the end's, and classes;
    ``rare`` has, for each class in order, the word's place in ``words``."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})
    names = [x.split()[0] for x in _ENCODED.split(", ")]
    ints, lexicon = pa.list_(pa.int32()), pa.list_(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, chunk, own = len(sent.value), TaskContext.get().partitionId() << 24, _Numbers(sent.value)
        for batch in arrow_slices(batches, 2):
            at, symbols, rare, closed = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = tokens(text)
                x = np.fromiter(map(own.__getitem__, words), np.int32, len(words))
                odd = np.flatnonzero(x >= end)
                few = x[odd] - np.int32(end)
                if len(few):
                    x[odd] = np.frombuffer(own.classes, np.int32)[few] + (end + 1)
                at.append(chunk)
                symbols.append(np.append(x, np.int32(end)))
                rare.append(few)
                if len(own.rare) > CHUNK_WORDS:
                    closed.append((chunk, own.rare))
                    chunk, own = chunk + 1, _Numbers(sent.value)
            made = [pa.array(at, pa.int64()), batch.column(0), batch.column(1), pa.array(symbols, ints), pa.array(rare, ints), pa.nulls(len(at), lexicon)]
            yield pa.RecordBatch.from_arrays(made, names)
            yield from map(of_chunk, closed)
        yield of_chunk((chunk, own.rare))

    def of_chunk(x: tuple[int, list[bytes]]) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), ints, ints)]
        return pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), *none, pa.array([x[1]], lexicon)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(tidy(run), _ENCODED)


class _Sequences:
    """Sequences, longest first, as one array in order of time."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in sequences])
        #: How many sequences have a symbol at each time, and where those begin.
        self.alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        self.at = np.concatenate([[0], np.cumsum(self.alive)])
        time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whose = np.repeat(np.arange(len(lengths)), lengths)
        place = self.at[time] + whose
        self.x, self.whose = np.empty(len(place), np.int32), np.empty(len(place), np.int32)
        self.x[place], self.whose[place] = np.concatenate(sequences), whose

    def segments(self) -> list[tuple[int, int]]:
        """Ranges of times of about ``_SEGMENT_TOKENS`` symbols each."""
        cuts = np.flatnonzero(np.diff((self.at[1:] - 1) // _SEGMENT_TOKENS)) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.alive)], strict=True))


class Model:
    """Start, transition and emission probabilities (emissions: a row a symbol)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
        """Sticky states whose emissions are the words' shares, unevenly."""
        uneven = share[:, None] * (0.5 + np.random.default_rng(seed).random((len(share), states)))
        move = np.full((states, states), (1 - STAY) / max(1, states - 1))
        np.fill_diagonal(move, STAY if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, uneven / uneven.sum(axis=0))

    def single(self) -> Model:
        """In single precision, for counting."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    def _forward(self, seqs: _Sequences, first: int, last: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values and scales of the times first to last; ``before``
        has the values of the time before them."""
        begin = seqs.at[first]
        a = self.emit[seqs.x[begin : seqs.at[last]]]
        scale, ones = np.empty(len(a), a.dtype), np.ones(a.shape[1], a.dtype)
        for t in range(first, last):
            m, o = seqs.alive[t], seqs.at[t] - begin
            here = a[o : o + m]
            here *= self.start if before is None else before[:m] @ self.move
            here.dot(ones, out=scale[o : o + m])
            here /= scale[o : o + m, None]
            before = here
        return a, scale

    def likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log-likelihood of each sequence, longest first; of the forward
        values only a segment's are kept."""
        seqs = _Sequences(sequences)
        before, score = None, np.zeros(len(sequences))
        for first, last in seqs.segments():
            a, scale = self._forward(seqs, first, last, before)
            before = a[seqs.at[last - 1] - seqs.at[first] :]
            score += np.bincount(seqs.whose[seqs.at[first] : seqs.at[last]], weights=np.log(scale), minlength=len(score))
        return score

    def expected(self, sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Adds the expected counts of the sequences, longest first. Where they
        have several segments, each one's forward values are computed again
        from those kept at its border."""
        seqs = _Sequences(sequences)
        parts, borders, kept = seqs.segments(), [None], None
        for first, last in parts:
            kept = self._forward(seqs, first, last, borders[-1])
            borders.append(kept[0][seqs.at[last - 1] - seqs.at[first] :].copy())
        later = None
        for (first, last), before in zip(reversed(parts), reversed(borders[:-1]), strict=True):
            begin, end = seqs.at[first], seqs.at[last]
            a, scale = kept if last == len(seqs.alive) else self._forward(seqs, first, last, before)
            x = seqs.x[begin:end]
            # Backward values, and emissions times them over the scale.
            b, ahead = np.ones_like(a), self.emit[x] / scale[:, None]
            for t in range(last - 1, first - 1, -1):
                m, o = seqs.alive[t], seqs.at[t] - begin
                if later is not None:
                    np.matmul(later, self.move.T, out=b[o : o + len(later)])
                later = ahead[o : o + m]
                later *= b[o : o + m]
            # What stood one time before each symbol, where something did.
            own = seqs.alive[first] if before is None else 0
            times = np.repeat(np.arange(first, last), seqs.alive[first:last])[own:]
            place = seqs.at[times - 1] + seqs.whose[begin + own : end]
            if before is None:
                past = a[place]
            else:
                past = np.concatenate([before, a])[place - (begin - len(before))]
            move += (past.T @ ahead[own:]) * self.move
            later = later.copy()
            a *= b
            if first == 0:
                start += a[: seqs.alive[0]].sum(axis=0)
            for k in range(a.shape[1]):
                emit[:, k] += np.bincount(x, weights=a[:, k], minlength=len(emit))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their symbols, longest first, in chunks of bounded tokens. Each
    chunk has texts of about one length, so that a long text doesn't make the
    recursions of short ones run on."""
    held: dict[int, tuple[list, list[np.ndarray]]] = {}
    tokens: Counter = Counter()

    def ordered(k: int) -> tuple[list, list[np.ndarray]]:
        rows, seqs = held.pop(k)
        tokens.pop(k)
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        return [rows[i] for i in order], [seqs[i] for i in order]

    for batch in batches:
        others = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != column]
        lists = batch.column(column)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i in range(len(lists)):
            x = flat[ends[i] : ends[i + 1]].copy()
            k = len(x).bit_length()
            rows, seqs = held.setdefault(k, ([], []))
            rows.append(tuple(o[i] for o in others))
            seqs.append(x)
            tokens[k] += len(x)
            if tokens[k] >= _CHUNK_TOKENS:
                yield ordered(k)
    for k in list(held):
        yield ordered(k)


def trained(table: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training rows of an encoded table."""
    spark, model = table.sparkSession, Model.initial(share, states)
    rows = table.where("not held_out and symbols is not null").select("symbols")
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Model(*sent.value).single()
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape)
            for _, seqs in _chunks(batches, 0):
                m.expected(seqs, start, move, emit)
            used = np.flatnonzero(emit.any(axis=1))
            kind = np.concatenate([[-1], np.arange(-2, -2 - states, -1), used])
            both = np.concatenate([start[None], move, emit[used]])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(both[:, k]) for k in range(states))], ["symbol", *names])

        summed = rows.mapInArrow(tidy(count), ", ".join(["symbol int", *(f"{x} double" for x in names)])).groupBy("symbol").agg(*(F.sum(x).alias(x) for x in names)).collect()
        got = {r[0]: np.array(r[1:]) for r in summed}
        emit = np.zeros_like(model.emit)
        for k, x in got.items():
            if k >= 0:
                emit[k] = x
        move = np.array([got[-2 - k] for k in range(states)]) + 0.1
        start = got[-1] + 0.1
        emit = (emit + SMOOTH * share[:, None]) / (emit.sum(axis=0) + SMOOTH)
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
        sent.unpersist()
    return model


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words (word, n) of the greatest counts: all whose count
    reaches a border, which a histogram of sixteenths of powers of two gives."""
    step = F.floor(F.log2("n") * 16)
    total, border = 0, None
    for k, n in sorted(map(tuple, counts.groupBy(step.alias("k")).count().collect()), reverse=True):
        if total + n > most:
            break
        total, border = total + n, k
    if border is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(step >= border).collect()), key=lambda x: (-x[1], x[0]))


def scored(docs: DataFrame, words: int = WORDS, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for
    each row of ``docs`` (doc_id, text, held_out); rows held out teach nothing.

    A null text is an empty one: one token, the end. A null ``held_out`` counts
    as false. Words of one count are frequent together or not at all. Repeated
    rows count each. Without training rows every probability is that of the
    base formula, and ``score`` equals ``base_score``. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    training = rows.where("not held_out")
    counts = stored(word_counts(training.select("text")))
    ends = training.count()
    all_n, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = all_n + ends, kinds + (ends > 0)
    top = frequent(counts, words)
    table = stored(encoded(rows, [w for w, _ in top]))

    # Tokens and words of each class, of all words but the frequent: at most CLASSES rows.
    of_class = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy(class_of(F.col("word")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    sizes = np.array([of_class.get(k, (0, 0)) for k in range(CLASSES)], float)
    for w, n in top:
        sizes[word_class(w)] -= n, 1
    share = np.concatenate([[n for _, n in top], [ends + 1], sizes[:, 0] + 1]).astype(float)
    share /= share.sum()
    model = trained(table, share, states, rounds) if ends else None
    over = np.log10(float(total + distinct + 1))
    # What a symbol adds to the base score, whether it is known, and what its class takes off; words of classes add the rest.
    log_base = np.concatenate([np.log10([n + 1.0 for _, n in top]), [np.log10(ends + 1.0)], np.zeros(CLASSES)]) - over
    known = np.concatenate([np.ones(len(top), bool), [ends > 0], np.zeros(CLASSES, bool)])
    inner = np.concatenate([np.zeros(len(top) + 1), np.log10(sizes.sum(axis=1) + 1)])
    sent = spark.sparkContext.broadcast(((model.start, model.move, model.emit) if model else None, log_base, known, inner))
    kinds_of = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, log_base, known, inner = sent.value
        model = Model(*parts) if parts else None
        for own, seqs in _chunks(batches, 3):
            base = [float(log_base[x].sum()) for x in seqs]
            like = [float(s - inner[x].sum()) for s, x in zip(model.likelihoods(seqs) / np.log(10), seqs, strict=True)] if model else base
            made = [pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.bool_()), pa.array([len(x) for x in seqs], pa.int64())]
            made += [pa.array([int(known[x].sum()) for x in seqs], pa.int64()), pa.array(base, pa.float64()), pa.array(like, pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), *made, pa.array([r[3] for r in own], pa.list_(pa.int32()))], ["chunk", *kinds_of, "rare"])

    part = table.where("symbols is not null").select("chunk", "doc_id", "held_out", "symbols", "rare").mapInArrow(tidy(score), f"chunk long, {schema}, rare array<int>")

    # A chunk's counts of its rarer words come before its texts: one sort by one
    # number. A word's place and count are one number too, as most rows are these.
    lexicon = table.where("words is not null").select("chunk", F.posexplode("words").alias("i", "word")).join(counts, "word")
    lexicon = lexicon.select((F.col("chunk") * 2).alias("key"), F.expr(f"shiftleft(cast(i as bigint), {_COUNT_BITS}) + n").alias("pair"))
    text = part.select((F.col("chunk") * 2 + 1).alias("key"), F.struct(*kinds_of, "rare").alias("r"))
    both = lexicon.unionByName(text, allowMissingColumns=True).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, logs = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(np.diff(key) != 0) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if s == e:
                    continue
                if key[s] >> 1 != at:
                    at, held, logs = key[s] >> 1, [], np.zeros(0)
                if key[s] % 2 == 0:
                    held.append(batch.column(1).slice(s, e - s).to_numpy())
                    continue
                own = batch.column(2).slice(s, e - s).flatten()
                lists = own[-1]
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()[ends[0] : ends[-1]]
                if held:
                    pairs, held = np.concatenate(held), []
                    logs = np.zeros((pairs >> _COUNT_BITS).max() + 1)
                    logs[pairs >> _COUNT_BITS] = np.log10((pairs & ((1 << _COUNT_BITS) - 1)) + 1.0)
                if len(flat) and flat.max() >= len(logs):  # words that training has not
                    logs = np.concatenate([logs, np.zeros(flat.max() + 1 - len(logs))])
                whose, own_logs = np.repeat(np.arange(len(lists)), np.diff(ends)), logs[flat]
                more = np.bincount(whose, weights=own_logs, minlength=len(lists))
                found = np.bincount(whose, weights=own_logs > 0, minlength=len(lists)).astype(np.int64)
                made = [*own[:3], pa.array(own[3].to_numpy() + found), *(pa.array(x.to_numpy() + more) for x in own[4:6])]
                yield pa.RecordBatch.from_arrays(made, list(kinds_of))

    done = both.mapInArrow(tidy(finish), schema)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
