"""Nearest neighbours, reranking, diversity, and the three-channel search."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import RankConfig
from ..functions.text import overlap, overlap_tokens, query_tokens
from ..functions.vectors import similarity
from ..sources.index import matrix, smallest, squared, whole
from ..sources.scratch import written

#: Queries that one pass over the memories takes; more go in several passes.
MAX_QUERIES = 4096
#: Queries whose distances to a batch are looked at together.
_CHUNK = 512
#: Rows of a batch that are compared at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Channel:
    """The ``k`` nearest of the memories for which ``where`` holds; with
    ``own_user`` of the query's own user's."""

    k: int
    own_user: bool = False
    where: Column | None = None


def _nearest(memories: DataFrame, asked: list[Row], channels: list[Channel]) -> DataFrame:
    """(channel, qid, doc_id, distance): each task's nearest of each channel for
    each of the queries (qid, user_id, embedding), in one pass."""
    sets: dict[tuple, list[Row]] = {}
    for c, channel in enumerate(channels):
        for r in asked:
            sets.setdefault((c, len(r["embedding"]), r["user_id"] if channel.own_user else None), []).append(r)
    groups = [(*key, channels[key[0]].k, channels[key[0]].own_user, np.array([r["qid"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], float)) for key, rows in sets.items()]
    n_channels = len(channels)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.full((len(g[5]), g[3]), np.inf), np.full((len(g[5]), g[3]), -1)) for g in groups]
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(2)
            size, user = np.diff(vectors.offsets.to_numpy()), np.array(batch.column(1).to_pylist(), object)
            inside = [batch.column(3 + c).to_numpy(zero_copy_only=False) for c in range(n_channels)]
            for (c, dim, name, k, own_user, _, points), (best, found) in zip(groups, held, strict=True):
                every = np.flatnonzero((size == dim) & inside[c] & ((user == name) if own_user else True))
                for s in range(0, len(every), _ROWS):
                    own = every[s : s + _ROWS]
                    x = matrix(vectors.take(pa.array(own)))
                    for i in range(0, len(points), _CHUNK):
                        d, n = smallest(squared(points[i : i + _CHUNK], x), ids[own], k)
                        d, n = np.concatenate([best[i : i + _CHUNK], d], axis=1), np.concatenate([found[i : i + _CHUNK], n], axis=1)
                        best[i : i + _CHUNK], found[i : i + _CHUNK] = smallest(d, n, k)
        for (c, *_, q, _), (best, found) in zip(groups, held, strict=True):
            real = np.isfinite(best)
            q = np.repeat(q, real.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), c, np.int32)), pa.array(q), pa.array(found[real]), pa.array(best[real])], ["channel", "qid", "doc_id", "distance"])

    return memories.mapInArrow(near, "channel int, qid long, doc_id long, distance double")


def in_blocks(rows: DataFrame, asked: DataFrame, run: Callable[[DataFrame, list[Row]], DataFrame]) -> DataFrame:
    """What ``run`` gives of ``rows`` for all of ``asked`` (qid, ...), which it gets as
    lists of at most ``MAX_QUERIES``: the driver holds one of them at a time, and
    where there are several, ``rows`` are made once for all and what each list
    gives is written before the next."""
    first = asked.limit(MAX_QUERIES + 1).collect()
    if len(first) <= MAX_QUERIES:
        return run(rows, first)
    rows = written(rows)
    blocks = -(-2 * asked.count() // MAX_QUERIES)  # half full, so that no hash overfills one
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))))
    return functools.reduce(DataFrame.union, (written(run(rows, asked.where(F.col("block") == i).collect())) for i in range(blocks)))


def nearest_of(memories: DataFrame, queries: DataFrame, channels: list[Channel]) -> DataFrame:
    """(channel, qid, doc_id, distance, knn_rank): for each channel, by its place in
    the list, the nearest memories of each query by squared distance (six
    decimals), ties by doc_id.

    Queries go to every task in blocks of ``MAX_QUERIES``, so the driver holds one
    block at a time; further blocks are passes of their own, whose results are
    written and put together. A task passes on its nearest of each query. Vectors
    that are null, hold nulls, or have another length than the query's are no
    neighbours; a query without a vector has none."""
    inside = [F.coalesce(c.where, F.lit(False)) if c.where is not None else F.lit(True) for c in channels]
    rows = memories.where(whole()).select("doc_id", "user_id", "embedding", *(x.alias(f"in{i}") for i, x in enumerate(inside)))
    asked = queries.where(whole()).select("qid", "user_id", "embedding")
    found = in_blocks(rows, asked, lambda some, own: _nearest(some, own, channels))
    rank = F.row_number().over(Window.partitionBy("channel", "qid").orderBy("distance", "doc_id"))
    most = F.element_at(F.array(*(F.lit(c.k) for c in channels)), F.col("channel") + 1)
    # One limit for all channels lets Spark cut in each task; then each channel's own.
    return found.withColumn("knn_rank", rank).where(F.col("knn_rank") <= max(c.k for c in channels)).where(F.col("knn_rank") <= most)


def knn(memories: DataFrame, queries: DataFrame, k: int, own_user: bool = False) -> DataFrame:
    """(qid, doc_id, distance, knn_rank): the ``k`` nearest memories of each query,
    with ``own_user`` among the user's own; see :func:`nearest_of`."""
    return nearest_of(memories, queries, [Channel(k, own_user)]).drop("channel")


def age_seconds(as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("ts"), as_of))


def half_life(cfg: RankConfig) -> Column:
    out = F.lit(float(cfg.default_half_life))
    for source, days in cfg.half_life.items():
        out = F.when(F.col("source") == source, float(days)).otherwise(out)
    return F.when(F.col("is_milestone"), float(cfg.milestone_half_life)).otherwise(out)


def recency(cfg: RankConfig, as_of: Column) -> Column:
    days = F.floor(age_seconds(as_of) / 86400)
    return F.when(F.col("ts").isNull(), 0.5).otherwise(F.pow(F.lit(0.5), days / half_life(cfg)))


def keyword_share(tokens: Column, text: Column) -> Column:
    """The share of the query's tokens that the text holds."""
    # Lower-cased once, not once a token; likewise the tokens.
    share = lambda x: F.when(F.size(x["w"]) == 0, 0.0).otherwise(F.size(F.filter(x["w"], lambda w: F.contains(x["t"], w))) / F.size(x["w"]))
    return F.transform(F.array(F.struct(F.lower(text).alias("t"), tokens.alias("w"))), share)[0]


def within_cutoff(cfg: RankConfig, as_of: Column) -> Column:
    """Whether a memory is young enough for its source; those without a time are."""
    limit = F.lit(None).cast("double")
    for source, hours in cfg.cutoff_hours.items():
        limit = F.when(F.col("source") == source, float(hours)).otherwise(limit)
    return limit.isNull() | F.col("ts").isNull() | (age_seconds(as_of) / 3600 <= limit)


def not_echo(cfg: RankConfig = RankConfig()) -> Column:  # noqa: B008
    """Channel 1's filters, which apply to the pool after it is drawn."""
    known = ~F.col("source").isin(*cfg.excluded)
    return known if cfg.short_persons else known & ~((F.col("source") == "extracted_person") & (F.col("chars") < 80))


def reranked(pool: DataFrame, as_of: Column, cfg: RankConfig = RankConfig(), keys: Sequence[str] = ("qid",)) -> DataFrame:  # noqa: B008
    """Adds the score's parts (three decimals), ``final_score`` (four) and ``rank``
    of each of ``keys`` by score and then by nearness. Needs distance, importance, source, ts,
    is_milestone and share, as a pool has them."""
    sim, rec = similarity(F.col("distance")), recency(cfg, as_of)
    imp = F.least(F.coalesce("importance", F.lit(5)) / 10, F.lit(1.0))  # as stored memories have by default
    kw = F.col("share") * cfg.keyword
    fresh = F.when(age_seconds(as_of) < cfg.fresh_hours * 3600, cfg.fresh).otherwise(0.0)
    score = F.least(F.lit(1.0), cfg.importance * imp + cfg.recency * rec + cfg.similarity * sim + kw + F.coalesce(fresh, F.lit(0.0)))
    score = score + F.when(F.col("is_milestone"), cfg.milestone).otherwise(0.0)
    out = pool.withColumns({
        "s_similarity": F.round(sim, 3), "s_importance": F.round(imp, 3), "s_recency": F.round(rec, 3), "s_keyword": F.round(kw, 3), "final_score": F.round(score, 4),
    })
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("final_score"), "knn_rank")))


def mmr(ranked: DataFrame, n: int, penalty: Column | float) -> DataFrame:
    """(qid, doc_id, pick): greedy choice of ``n`` rows a query, each the best by
    score less ``penalty`` times its greatest overlap with those chosen; the first
    in rank order wins ties. A query's pool is bounded by the search, so it is one
    row's array and each choice an expression over it. Needs a pool's tokens."""
    item = F.struct("rank", "doc_id", "final_score", "tokens")
    pools = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("pool"), F.max(F.lit(penalty) if isinstance(penalty, float) else penalty).alias("penalty"))
    out = picked(pools, n)
    return out.select("qid", F.posexplode("chosen").alias("pick", "c")).select("qid", "c.doc_id", (F.col("pick") + 1).alias("pick"))


def picked(pools: DataFrame, n: int) -> DataFrame:
    """``pools`` (pool, penalty, ...) with ``chosen``, the rows of each pool, an array
    in rank order, that :func:`mmr` takes."""

    def choose(chosen: Column) -> Column:
        def worth(p: Column) -> Column:
            most = F.array_max(F.transform(chosen, lambda c: overlap(p["tokens"], c["tokens"])))
            # Seven decimals keep sums of doubles that should tie, tied.
            return F.round(p["final_score"] - F.col("penalty") * F.coalesce(most, F.lit(0.0)), 7)

        left = F.filter("pool", lambda p: ~F.exists(chosen, lambda c: c["rank"] == p["rank"]))
        best = F.array_max(F.transform(left, lambda p: F.struct(worth(p).alias("w"), (-p["rank"]).alias("r"), p.alias("p"))))["p"]
        return F.concat(chosen, F.when(F.size(left) > 0, F.array(best)).otherwise(F.slice(chosen, 1, 0)))

    out = pools.withColumn("chosen", F.slice("pool", 1, 1))
    for _ in range(n - 1):
        out = out.withColumn("chosen", choose(F.col("chosen")))
    return out


def drawn(memories: DataFrame, queries: DataFrame, channels: list[Channel], texts: bool = True) -> DataFrame:
    """The nearest memories of each channel with their columns and ``chars``, the
    text's length, ``tokens``, hashes of its words that can overlap, and ``share``, the share
    of the query's words that it holds; without ``texts`` not the text itself.

    The neighbours and the queries' words are written first, so that Spark knows
    their sizes: as long as they are small, both go to where the memories are
    read and no text moves; else rows meet by shuffle. All that is made of the
    texts is made there."""
    near = written(nearest_of(memories, queries, channels))
    words = written(queries.select("qid", query_tokens(F.col("qtext")).alias("words")))
    rows = memories.drop("embedding", "ts_raw").join(near, "doc_id").join(words, "qid")
    rows = rows.withColumns({"chars": F.length("text"), "tokens": F.transform(overlap_tokens(F.col("text")), lambda w: F.xxhash64(w)), "share": keyword_share(F.col("words"), F.col("text"))}).drop("words")
    return rows if texts else rows.drop("text")


def pooled(memories: DataFrame, queries: DataFrame, k: int, own_user: bool = False, texts: bool = True) -> DataFrame:
    """The nearest ``k`` memories of each query, as :func:`drawn` gives them."""
    return drawn(memories, queries, [Channel(k, own_user)], texts).drop("channel")


def three_channels(memories: DataFrame, queries: DataFrame, as_of: Column, cfg: RankConfig = RankConfig()) -> DataFrame:  # noqa: B008
    """(qid, doc_id, channel, final_score, rank): the user's own memories (diverse
    facts and, where ``cfg`` has slots for them, top milestones), character core and imported knowledge; equal
    80-character beginnings once, best ``limit`` by score. One pass over the
    memories serves all channels."""
    wanted = [Channel(cfg.character_pool, where=F.col("source") == "character_core"), Channel(cfg.pool, True), Channel(cfg.knowledge_pool, where=F.col("source") == "md_import")]
    pool = drawn(memories.withColumn("beginning", F.left("text", F.lit(80))), queries, wanted, texts=False)
    gate = F.when(F.col("channel") == 1, not_echo(cfg)).otherwise(F.col("distance") < F.when(F.col("channel") == 0, cfg.character_gate).otherwise(cfg.knowledge_gate))
    # Kept, as facts are read twice: to be chosen from and to be shown.
    ranked = written(reranked(pool.where(gate), as_of, cfg, ["channel", "qid"]))
    columns = ["qid", "doc_id", "beginning", "final_score", "channel", "place"]
    own = ranked.where("channel = 1").where(within_cutoff(cfg, as_of))
    facts = own.where("not is_milestone") if cfg.slots else own
    picked = facts.join(mmr(facts, cfg.facts, cfg.diversity), ["qid", "doc_id"])
    picked = picked.withColumn("place", F.col("pick")).select(*columns)
    top = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    great = own.where("is_milestone").withColumn("n", top).where(F.col("n") <= cfg.milestones)
    great = great.where(F.lit(cfg.slots)).withColumn("place", F.lit(cfg.facts) + F.col("n")).select(*columns)
    most = F.when(F.col("channel") == 0, cfg.character_limit).otherwise(cfg.knowledge_limit)
    others = ranked.where(F.col("channel").isin(0, 2) & (F.col("rank") <= most)).withColumn("place", F.col("rank")).select(*columns)
    first = Window.partitionBy("qid", "beginning").orderBy("channel", "place")
    every = others.unionByName(picked).unionByName(great).withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("final_score"), "channel", "place")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.limit).select("qid", "doc_id", "channel", "final_score", "rank")


#: Characters of the pieces by which beginnings are found in texts.
_PIECE = 32
#: Hashes of beginnings of a width that are sent to where texts are read, at most.
_FEW = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Its powers, by the size of the pieces that are put together.
_POWERS = {2**i: np.uint64(pow(int(_PRIME), 2**i, 2**64)) for i in range(5)}


def chosen_pieces(text: str, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the widths, the hashes of the pieces that stand for the windows of
    so many characters of a text: a window of a power of two, up to 32, for itself,
    and for a longer one that of its pieces of 32 with the least hash. A window has
    the same piece wherever it stands. Hashes may come more than once."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size, h = 1, c  # of pieces of ``size`` characters; twice as long ones are made of two
    for w in widths:
        while 2 * size <= min(w, _PIECE) and len(h) > size:
            h, size = h[:-size] * _POWERS[size] + h[size:], 2 * size
        if len(c) < w or not w:
            yield w, np.empty(0, np.int64)
            continue
        least, span = h + np.uint64(w), w - size + 1
        least = (least ^ (least >> np.uint64(31))) * _PRIME
        least ^= least >> np.uint64(29)
        done = 1
        while done < span:  # the least of ``span`` in a row, from shorter rows of them
            step = min(done, span - done)
            least, done = np.minimum(least[:-step], least[step:]), done + step
        if span > 1:
            least = least[np.append(True, least[1:] != least[:-1])]
        yield w, (least >> np.uint64(1)).astype(np.int64)


def _pieces(texts: DataFrame, widths: list[int], among: dict[int, np.ndarray]) -> DataFrame:
    """(id, width, hash) of the chosen pieces of each text (id, text), each hash once,
    for each of the widths; of a width in ``among`` only hashes that it has."""
    sent, bits = texts.sparkSession.sparkContext.broadcast(among), np.int64((1 << 22) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {}
        for w, known in sent.value.items():
            marks[w] = np.zeros(int(bits) + 1, bool)
            marks[w][known & bits] = True
        for batch in batches:
            row, width, hashes, n = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w, h in chosen_pieces(text, widths):
                    h = np.unique(h[marks[w][h & bits]] if w in marks else h)
                    if w in marks and len(h):
                        known = sent.value[w]
                        h = h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                    row.append(np.full(len(h), i))
                    width.append(np.full(len(h), w, np.int32))
                    hashes.append(h)
                    n += len(h)
                if n > 100_000 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(x)) for x in (width, hashes))], ["id", "width", "hash"])
                    row, width, hashes, n = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, width int, hash long")


def _may_hold(texts: DataFrame, beginnings: DataFrame, size: int) -> DataFrame:
    """(id, b): the texts (id, text) that can hold each of ``beginnings`` (b), distinct
    strings of up to ``size`` characters; all that do are among them. A beginning
    is sought by its first 1, 2, 4 ... or ``size`` characters, as many as it has,
    whose chosen piece a text must have, wherever it holds them."""
    widths = [*(w for w in (1, 2, 4, 8, 16, 32) if w < size), size]
    width = F.lit(None).cast("int")
    for w in widths:
        width = F.when(F.length("b") >= w, w).otherwise(width)
    asked = written(beginnings.select("b", width.alias("w")))
    used = sorted(r[0] for r in asked.select("w").distinct().collect())  # seven numbers at most
    key = asked.select(F.struct("b", "w").alias("id"), F.expr("left(b, w)").alias("text"))
    key = _pieces(key.select(F.to_json("id").alias("id"), "text"), used, {}).withColumn("k", F.from_json("id", "b string, w int")).where(F.col("k.w") == F.col("width"))
    # Where there are few of a width, what the beginnings need is known where texts are read.
    key = written(key.select(F.col("k.b").alias("b"), "width", "hash"))
    few = {w: np.array([r[0] for r in key.where(F.col("width") == w).select("hash").distinct().limit(_FEW + 1).collect()], np.int64) for w in used}
    among = {w: np.sort(h) for w, h in few.items() if 0 < len(h) <= _FEW}
    return _pieces(texts, used, among).join(key, ["width", "hash"]).select("id", "b")


def _least(pairs: DataFrame, of: str, rank: str, held: Callable[[DataFrame], DataFrame], first: int = 4) -> DataFrame:
    """(``of``, ``rank``): for each value of ``of`` the least ``rank`` of its ``pairs``
    that ``held`` keeps. As few as can be are looked at: the ``first`` by rank, then,
    where none of them is kept, eight times as many, and so on to the last."""
    pairs = written(pairs.withColumn("__n", F.dense_rank().over(Window.partitionBy(of).orderBy(rank))))
    found, low, high, left = None, 0, first, pairs
    while True:
        new = written(held(left.where((F.col("__n") > low) & (F.col("__n") <= high))).groupBy(of).agg(F.min(rank).alias(rank)))
        found = new if found is None else found.unionByName(new)
        left = pairs.join(found.select(of), of, "left_anti")
        low, high = high, high * 8
        if left.where(F.col("__n") > low).isEmpty():
            return found


def resolved(results: DataFrame, documents: DataFrame, size: int = 50) -> DataFrame:
    """(result_id, doc_id): for each of ``results`` (result_id, text) the least id
    of ``documents`` (doc_id, text) whose beginning of ``size`` characters it
    holds, or which holds its beginning; shorter texts are their own beginnings,
    and empty ones begin nothing. Equal beginnings are one. Results without a
    document have no row."""
    found, own = results.select(F.col("result_id").alias("id"), "text"), documents.select(F.col("doc_id").alias("id"), "text")
    begin = lambda df: df.where(F.length("text") > 0).select("id", F.left("text", F.lit(size)).alias("b"))
    of_docs, of_results = written(begin(own).groupBy("b").agg(F.min("id").alias("doc_id"))), written(begin(found))
    # A beginning that is a document's own has an id, which only lesser ones better.
    known = of_docs.withColumnRenamed("doc_id", "most")
    better = lambda df: df.where(F.col("most").isNull() | (F.col("doc_id") < F.col("most"))).drop("most")
    equal = of_results.join(of_docs, "b").select(F.col("id").alias("result_id"), "doc_id")
    inside = lambda df, texts: df.join(texts, "id").where(F.contains("text", "b"))
    pairs = _may_hold(found.where(F.length("text") > 0), of_docs.select("b"), size).join(of_docs, "b")
    pairs = better(pairs.join(of_results.join(known, "b").select("id", "most"), "id", "left"))
    held = _least(pairs, "id", "doc_id", lambda df: inside(df, found)).select(F.col("id").alias("result_id"), "doc_id").union(equal)
    pairs = better(_may_hold(own.where(F.length("text") > 0), of_results.select("b").distinct(), size).withColumn("doc_id", F.col("id")).join(known, "b", "left"))
    holds = _least(pairs, "b", "doc_id", lambda df: inside(df, own))
    both = held.union(of_results.join(holds, "b").select(F.col("id").alias("result_id"), "doc_id"))
    return both.groupBy("result_id").agg(F.min("doc_id").alias("doc_id"))
