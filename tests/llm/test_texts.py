"""Byte-level BPE, language ID, fingerprints, HMM scoring."""

import base64
import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recallspark.llm import byte_bpe, fingerprints, hmm, language_id
from recallspark.llm.common import held_out
from recallspark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


def test_bpe_is_tiktoken(docs, rows, vocab, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, vocab, offsets=True, keep=("doc_id", "text")), vocab).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        for i, s, e in zip(r.ids, r.starts, r.ends, strict=True):
            assert vocab.pieces[i] in text[s:e].encode()
    assert byte_bpe.round_trip_digests(empty, vocab).count() == 0


def test_bpe_digests(docs, vocab):
    import hashlib

    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks={p: i for i, p in enumerate(vocab.pieces)}, special_tokens={})
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for with_ids in (False, True):
        got = byte_bpe.round_trip_digests(docs, vocab, keep=("doc_id", "text"), with_ids=with_ids)
        for r in got.collect():
            ids = enc.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(r.text or ""))
            assert not with_ids or r.ids == ids


def test_bpe_works_copies_out_once(spark, vocab):
    """Equal rows that stand together; null and equal texts of other ids are rows of their own."""
    import pyarrow as pa

    seen = []

    def run(batches):
        for batch in batches:
            seen.append(len(batch))
            yield from (batch.slice(i, 2) for i in range(0, len(batch), 2))

    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "a b"), (None, "c"), (None, "c"), (3, None), (3, None), (4, ""), (4, ""), (1, "a b")]
    batches = [pa.RecordBatch.from_pylist([{"i": i, "t": t} for i, t in part], pa.schema([("i", pa.int64()), ("t", pa.string())])) for part in (rows, [], rows[:1], rows[:3])]
    got = [(r["i"], r["t"]) for b in byte_bpe._once(run)(iter(batches)) for r in b.to_pylist()]
    assert got == rows + rows[:1] + rows[:3] and seen == [8, 0, 1, 1]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(1)
    found = byte_bpe.round_trip_digests(df, vocab, with_ids=True).collect()
    alone = {t: byte_bpe.round_trip_digests(df.where(df.text.eqNullSafe(t)), vocab, with_ids=True).first()[1:] for t in ("a b", "c", "", None)}
    assert [(r.doc_id, r[1:]) for r in found] == [(i, alone[t]) for i, t in rows]


def test_bpe_of_odd_strings(spark, vocab):
    import random

    import tiktoken

    ranks = {p: i for i, p in enumerate(vocab.pieces)}
    enc = tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(["aa", "a", "=", "==", " ", "\n", "é", "漢", "0", "'s", "😀", "\u0085", "_"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), vocab).collect()
    assert all(r.ids == enc.encode_ordinary(texts[r.doc_id]) for r in got)


def test_segmentation_sums():
    pieces = ("a", "ab", "b", " ", " a", "ba", "abab")
    table = np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1]])
    seg, p = language_id.Segmenter(pieces, table), dict(zip(pieces, table, strict=True))

    def total(s):
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(s) + 1):
            out = out + (p[s[:n]] * total(s[n:]) if s[:n] in p else language_id.UNSEEN * total(s[1:]) if n == 1 else 0)
        return out

    words = [" abab", " ba", "x", " aéb"]
    assert np.allclose(np.exp(seg.log_likelihoods(words)), [total(w) for w in words])
    assert math.isclose((seg.expected(words[:2], np.ones(2), 0) * [len(x) for x in pieces]).sum(), 8)


def test_long_words_are_summed_whole():
    pieces = ("a", "ab", "b", " ", " a", "ba", "abab", "bababababa")
    table = np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.3, 0.2]])
    seg, p = language_id.Segmenter(pieces, table), [dict(zip(pieces, map(Fraction, c), strict=True)) for c in table.T]

    def sums(s, p):
        a = [Fraction(1)]
        for i in range(1, len(s) + 1):
            a.append(sum(a[i - n] * p[s[i - n : i]] for n in range(1, min(i, 10) + 1) if s[i - n : i] in p) + (0 if s[i - 1] in p else a[i - 1] * Fraction(language_id.UNSEEN)))
        return a

    def log(x):
        return math.log(x.numerator) - math.log(x.denominator)

    words = [" ba", " " + "ab" * 50, "abba" * 9 + "é" * 60 + "baba" * 20, "x" * 200, " " + "bababababaa" * 40, "aé"]
    assert np.allclose(seg.log_likelihoods(words), [[log(sums(w, q)[-1]) for q in p] for w in words], rtol=1e-10)
    # The expected counts of a word's pieces, from exact forward and backward sums.
    for s in words[1:3]:
        for k, q in enumerate(p):
            turned = sums(s[::-1], {x[::-1]: v for x, v in q.items()})
            a, b = sums(s, q), turned[::-1]
            want = [float(sum(a[i] * q[x] * b[i + len(x)] for i in range(len(s)) if s.startswith(x, i)) / a[-1]) for x in pieces]
            assert np.allclose(seg.expected([s, " ba"], np.array([1.0, 0.0]), k), want)
    words.append("abba" * 5000)
    whole = seg.expected(words, np.ones(len(words)), 0)
    assert np.isfinite(whole).all() and math.isclose((whole * [len(x) for x in pieces]).sum(), sum(len(w) - w.count("é") - w.count("x") for w in words))


def test_fit_reads_long_words(spark):
    rows = [(i, ("ab" if i % 2 else "cd") * 100, "xx" if i % 2 else "yy") for i in range(6)]
    pieces = (" ", "a", "b", "c", "d", "ab", "cd")
    langs, table, _ = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces)
    assert langs == ["xx", "yy"] and table[5, 0] > 10 * table[6, 0] and table[6, 1] > 10 * table[5, 1]


def test_language(spark, docs, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = language_id.identify(docs, model).collect()
    und = [r for r in got if r.lang_pred == "und"]
    assert len(got) == docs.count() and len(und) == 4 and all(r.score == 0 for r in und) and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty, model).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled, model).collect()} == {"und"}
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done = language_id.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where(held_out(4, 2))
    assert done.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_fingerprints(docs, rows, empty):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    order = sorted(rows, key=key)
    got = fingerprints.compared(docs).collect()
    texts = [r[1] or "" for r in order]
    want = Counter()
    for i, (doc_id, _, _, _) in enumerate(order):
        if doc_id is not None:
            new = fingerprints.edited(texts[i], texts[(i + 1) % len(texts)])
            want[doc_id, len(texts[i]), hashlib.sha256(new.encode()).hexdigest()] += 1
    have = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None)
    last = min(r[0] for r in rows if r[0] is not None)  # what follows it has no id, in either order
    assert len(got) == len(rows) and {k: v for k, v in want.items() if k[0] != last} == {k: v for k, v in have.items() if k[0] != last}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fingerprints.compared(empty).count() == 0
    single = fingerprints.compared(docs.where("doc_id = 5")).first()
    assert single.near_next == 1.0


def brute_anchors(text, k, s):
    """Places of the k-mers whose least s-mer is their first or last, by plain loops."""
    one = {}
    for i in range(len(text) - s + 1):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in text[i : i + s]:
                h = h * fingerprints._P + np.uint64(ord(c))
            one[i] = int(fingerprints._mix(np.array([h]))[0])
    inner = lambda i: [one[j] for j in range(i, i + k - s + 1)]
    return [i for i in range(len(text) - k + 1) if min(inner(i)) in (one[i], one[i + k - s])]


def test_syncmers_by_brute_force():
    text = "".join(chr(97 + (i * i + i // 3) % 26) for i in range(400)) + "aaaa" * 20 + "naïve 漢字 😀 text" * 3
    at, h = fingerprints.closed_syncmers(text)
    assert at.tolist() == brute_anchors(text, fingerprints.K, fingerprints.S) and np.diff(at).max() <= fingerprints.K - fingerprints.S
    again, g = fingerprints.closed_syncmers("prefix text " + text)
    shifted = dict(zip((again - 12).tolist(), g.tolist(), strict=True))
    assert all(shifted[int(i)] == int(x) for i, x in zip(at, h, strict=True))
    assert all(np.array_equal(x, y) for x, y in zip(fingerprints.read(fingerprints.shown((at, h))), (at, h), strict=True))
    for short in ("x", "y" * 31, "".join(chr(97 + i) for i in range(26))):
        assert len(fingerprints.closed_syncmers(short)[0]) == 1


def test_likeness_is_by_position():
    import random

    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, passage, b = text(4000), text(400), text(4000)
    like = lambda x, y: fingerprints.likeness(fingerprints.closed_syncmers(x), fingerprints.closed_syncmers(y))
    assert like(a, a) == 1.0 and like("", "") == 1.0 and like("", a) == 0.0 and like("abc", "abc") == 1.0 and like("abc", "abd") == 0.0
    assert like(a, b) == 0.0 and 0.05 < like(a + passage, passage + b) < 0.12  # 400 of 4,400, at another place
    parts = [a[i : i + 40] for i in range(0, 4000, 40)]
    rng.shuffle(parts)
    assert like(a, "".join(parts)) < 0.2  # the same pieces at as many shifts
    assert abs(like(a, a[:2000] + b[:2000]) - 0.5) < 0.05


def test_next_documents_of_one_id(spark):
    """Rows of one id, and repeated rows, are dealt to many partitions."""
    rows = [(5, f"text number {i} of many that share an id") for i in range(300)] + [(5, "one and the same text, again and again")] * 300 + [(9, "first"), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert fingerprints._with_next(df).where("guest = 0").groupBy("pid").count().agg(F.max("count")).first()[0] < 300
    got = fingerprints.compared(df.cache()).collect()
    assert len(got) == len(rows) and sum(r.near_next == 1.0 for r in got) == 299


def test_hmm(docs, rows, empty):
    own = docs.withColumn("held_out", held_out(7, 2))
    got = hmm.scored(own, words=20, states=3, rounds=2).collect()
    token = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter()
    for i, t, _, _ in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2:
            counts.update(token(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), len(token(t)), sum(counts[w] > 0 for w in token(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t)), 6)) for i, t, _, _ in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert hmm.scored(empty.withColumn("held_out", held_out(7, 2))).count() == 0
    alone = hmm.scored(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(alone) == len(rows) and all(r.score == r.base_score for r in alone)


def test_forward_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    m = hmm.Model.initial(rng.random(7), 3)
    seqs = [rng.integers(0, 7, n) for n in (9, 4, 4, 1)]
    sums = []
    for size in (1_000_000, 5, 1):  # one segment, some, one a time
        monkeypatch.setattr(hmm, "_SEGMENT_TOKENS", size)
        for s, x in zip(seqs, m.likelihoods(seqs), strict=True):
            a = m.start * m.emit[s[0]]
            for k in s[1:]:
                a = (a @ m.move) * m.emit[k]
            assert math.isclose(math.log(a.sum()), x, rel_tol=1e-9)
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
        m.expected(seqs, start, move, emit)
        assert math.isclose(start.sum(), 4) and math.isclose(move.sum(), 14) and math.isclose(emit.sum(), 18)
        sums.append(np.concatenate([start, move.ravel(), emit.ravel()]))
    assert np.allclose(sums[0], sums[1]) and np.allclose(sums[0], sums[2])
    before = m.likelihoods(seqs).sum()
    better = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert better.likelihoods(seqs).sum() > before


def brute_hmm(rows, words, states, rounds):
    """Scores of (text, held out) by plain loops in double precision."""
    own = [(t or "").encode().lower().split() for t, _ in rows]
    counts, ends = Counter(w for x, (_, held) in zip(own, rows, strict=True) if not held for w in x), sum(not held for _, held in rows)
    by = sorted(Counter(math.floor(math.log2(n) * 16) for n in counts.values()).items(), reverse=True)
    total, border = 0, math.inf
    for k, n in by:
        if total + n > words:
            break
        total, border = total + n, k
    top = sorted((w for w, n in counts.items() if math.floor(math.log2(n) * 16) >= border), key=lambda w: (-counts[w], w))
    of = {w: i for i, w in enumerate(top)}
    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in of:
            tokens[hmm.word_class(w)] += n
            kinds[hmm.word_class(w)] += 1
    share = np.array([*(counts[w] for w in top), ends + 1, *(tokens[c] + 1 for c in range(hmm.CLASSES))], float)
    share /= share.sum()
    seqs = [[*(of.get(w, len(top) + 1 + hmm.word_class(w)) for w in x), len(top)] for x in own]
    m = hmm.Model.initial(share, states)

    def alphas(s):
        a = [m.start * m.emit[s[0]]]
        for k in s[1:]:
            a.append((a[-1] @ m.move) * m.emit[k])
        return a

    for _ in range(rounds):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit)
        for s, (_, held) in zip(seqs, rows, strict=True):
            if held:
                continue
            a, b = alphas(s), [np.ones(states)]
            for k in s[:0:-1]:
                b.append(m.move @ (m.emit[k] * b[-1]))
            b.reverse()
            z = a[-1].sum()
            start += a[0] * b[0] / z
            for t, k in enumerate(s):
                emit[k] += a[t] * b[t] / z
                if t:
                    move += np.outer(a[t - 1], m.emit[k] * b[t]) * m.move / z
        emit = (emit + hmm.SMOOTH * share[:, None]) / (emit.sum(axis=0) + hmm.SMOOTH)
        move, start = move + 0.1, start + 0.1
        m = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
    out = []
    for s, x in zip(seqs, own, strict=True):
        inside = sum(math.log10((counts[w] + 1) / (tokens[hmm.word_class(w)] + kinds[hmm.word_class(w)] + 1)) for w in x if w not in of)
        out.append(math.log10(alphas(s)[-1].sum()) + inside)
    return out


def test_scores_by_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(8)
    word = lambda k: rng.choice(("ab", "cd", "ef")) + rng.choice("xyz")[: k % 2 + 1] + rng.choice("pqrst") * rng.randint(1, 3)
    rows = [(" ".join(word(i) for _ in range(rng.randint(1, 25))), i % 5 == 0) for i in range(60)] + [(None, False), ("", True), ("neverseen abxp abxp", True)]
    df = spark.createDataFrame([(i, t, h, 3, "s") for i, (t, h) in enumerate(rows)], "doc_id long, text string, held_out boolean, chunk int, symbols string").repartition(3)
    want = brute_hmm(rows, 12, 3, 2)
    for most in (hmm.CHUNK_WORDS, 7):  # many chunks a task too
        monkeypatch.setattr(hmm, "CHUNK_WORDS", most)
        got = {r.doc_id: r.score for r in hmm.scored(df, words=12, states=3, rounds=2).collect()}
        assert len(got) == len(rows) and all(math.isclose(got[i], x, rel_tol=1e-4) for i, x in enumerate(want))


def test_hmm_gains_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out(7, 2))
    gain = hmm.scored(docs).where("held_out").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    assert gain > 0.1


def brute_likeness(a, b):
    """Share of anchors in common passages by plain loops; an anchor is the text it stands for."""
    def anchors(text):
        at = brute_anchors(text, fingerprints.K, fingerprints.S)
        found = [(i, text[i : i + fingerprints.K]) for i in at] or ([(0, text)] if text else [])
        seen = Counter()
        out = {}
        for i, x in found:
            out[x, seen[x]] = i
            seen[x] += 1
        return out

    x, y = anchors(a), anchors(b)
    if not x or not y:
        return float(len(x) == len(y))
    shifts = Counter(x[k] - y[k] for k in x.keys() & y.keys())
    return 2 * sum(n for n in shifts.values() if n >= min(2, len(x), len(y))) / (len(x) + len(y))


def test_fingerprints_of_a_table_by_plain_loops(spark, rows):
    """Likeness, edits and fingerprints, whatever the order in which rows are read."""
    texts = {i: t or "" for i, t, *_ in rows if i is not None and len(t or "") < 6000}
    texts |= {100 + i: texts[1][i * 7 :] + texts[9] * (i % 3) for i in range(12)}
    order = sorted(texts, reverse=True)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    twice = df.union(df.where("doc_id in (1, 12)")).repartition(5).orderBy(F.rand())
    for own, repeats in ((df, 0), (df.repartition(7), 0), (twice, 2)):
        got = fingerprints.compared(own).collect()
        assert len(got) == len(texts) + repeats
        for r in got:
            if repeats and r.doc_id in (1, 12) and r.near_next == 1.0:
                continue  # followed by its copy
            follows = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            new = fingerprints.edited(texts[r.doc_id], follows)
            assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert math.isclose(r.near_edited, brute_likeness(texts[r.doc_id], new)) and math.isclose(r.near_next, brute_likeness(texts[r.doc_id], follows))
            assert r.fingerprint == fingerprints.shown(fingerprints.closed_syncmers(texts[r.doc_id])) and r.edited_fingerprint == fingerprints.shown(fingerprints.closed_syncmers(new))
