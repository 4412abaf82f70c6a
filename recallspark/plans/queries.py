"""Queries of the memory engine; each takes (spark, sf_dir)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EXCLUDED_SOURCES, INTENTS, LEGACY, REINGEST_SOURCES, TAXONOMY, TONES, RankConfig
from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import audit, consolidate, enrich, evaluate, grounding, persons, search, state
from ..sources import index, scratch, store, views
from ..sources.table import Table
from ..streaming import machine
from ..streaming import state as streams
from . import fixtures as X

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """All documents as (id, text)."""
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _pool(spark: SparkSession, d: str, cfg: RankConfig = RankConfig(), texts: bool = False) -> DataFrame:  # noqa: B008
    found = search.pooled(views.memories(spark, d), views.queries(spark, d), cfg.pool, texts=texts)
    return search.reranked(found.where(search.not_echo()), views.as_of(), cfg)


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "doc_id", "s_similarity", "s_importance", "s_recency", "s_keyword", "final_score", "rank")


@query
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(views.memories(spark, d), views.queries(spark, d), 6)


@query
def tenant_isolation(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(views.memories(spark, d), views.queries(spark, d), 5, own_user=True)


@query
def knn_index(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours through a stored index, exact by the cells' radii."""
    memories = views.memories(spark, d)
    found = index.Index.build(memories, scratch.folder(spark, "index"))
    return found.search(views.queries(spark, d), 6)


@query
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the nearest four fifths of the cells, over all queries: the vectors
    have little structure, so neighbours lie in many cells."""
    memories, asked = views.memories(spark, d), views.queries(spark, d)
    found = index.Index.build(memories, scratch.folder(spark, "index"))
    some = found.search(asked, 10, -(-4 * len(found.sizes) // 5), exact=False)
    return index.recall(some, search.knn(memories, asked, 10)).agg(F.count("*").alias("n"), (F.avg("recall") >= 0.9).alias("enough"))


@query
def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_pool(spark, d).where("rank <= 6"))


@query
def rerank_legacy(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_pool(spark, d, LEGACY).where("rank <= 5"))


@query
def keyword_boost(spark: SparkSession, d: str) -> DataFrame:
    pool = search.pooled(views.memories(spark, d), views.queries(spark, d), 30, texts=False)
    return pool.select("qid", "doc_id", F.round(F.col("share") * 0.15, 6).alias("boost"))


@query
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return views.memories(spark, d, False).select("doc_id", "source", F.round(search.recency(RankConfig(), views.as_of()), 6).alias("recency"))


@query
def temporal_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return views.memories(spark, d, False).where(search.within_cutoff(RankConfig(), views.as_of())).groupBy("source").agg(F.count("*").alias("n"))


@query
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return search.mmr(_pool(spark, d), 3, 0.8)


@query
def three_channel_search(spark: SparkSession, d: str) -> DataFrame:
    return search.three_channels(views.memories(spark, d), views.queries(spark, d), views.as_of())


@query
def legacy_search(spark: SparkSession, d: str) -> DataFrame:
    return search.three_channels(views.memories(spark, d), views.queries(spark, d), views.as_of(), LEGACY)


@query
def grounding_status(spark: SparkSession, d: str) -> DataFrame:
    """Grades of a user's own two nearest memories within a distance of 1.2, so
    some queries have one or none."""
    asked = views.queries(spark, d)
    return grounding.graded(asked, search.knn(views.memories(spark, d), asked, 2, own_user=True).where("distance <= 1.2"))


@query
def grounding_search(spark: SparkSession, d: str) -> DataFrame:
    asked = views.queries(spark, d)
    graded = grounding.graded(asked, search.knn(views.memories(spark, d), asked, 6))
    return graded.select("qid", "n", "status", "confidence", "avg_distance", grounding.directive().alias("directive"))


def _prototypes(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(i, k, list(v)) for i, (k, v) in enumerate(TAXONOMY.items())], "label int, entity_type string, subs array<string>")
    rows = views.table(spark, d, "embeddings").join(F.broadcast(names), "label")
    return rows.select("entity_type", F.element_at("subs", (F.col("vec_id") % F.size("subs") + 1).cast("int")).alias("entity_subtype"), "embedding")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    keys = ["entity_type", "entity_subtype"]
    return enrich.as_vectors(enrich.centroids(_prototypes(spark, d), keys), keys)


def _labels(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    own = spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")
    rows = views.table(spark, d, "embeddings").join(F.broadcast(own), F.col("label") % len(names) == F.col("ordinal"))
    return enrich.as_vectors(enrich.centroids(rows, ["ordinal", "name"]), ["ordinal", "name"])


def _entities(spark: SparkSession, d: str) -> DataFrame:
    messages = views.memories(spark, d).select("doc_id", "text", "embedding")
    return enrich.classified(messages, _classes(spark, d), 0.3)


@query
def centroids(spark: SparkSession, d: str) -> DataFrame:
    keys = ["entity_type", "entity_subtype"]
    return enrich.centroids(_prototypes(spark, d), keys).select(*keys, "pos", F.round("value", 6).alias("value"))


@query
def centroid_classify(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d)


@query
def intent_argmax(spark: SparkSession, d: str) -> DataFrame:
    return enrich.best_class(views.memories(spark, d), _labels(spark, d, INTENTS), 0.3, "unknown")


@query
def tone_argmax(spark: SparkSession, d: str) -> DataFrame:
    return enrich.best_class(views.memories(spark, d), _labels(spark, d, TONES), 0.3, "neutral")


@query
def top2_milestones(spark: SparkSession, d: str) -> DataFrame:
    return enrich.top_per(_entities(spark, d).where("entity_type = 'MILESTONE'"), ["doc_id"], 2)


@query
def top5_entities(spark: SparkSession, d: str) -> DataFrame:
    return enrich.top_per(_entities(spark, d), ["doc_id"], 5)


@query
def synthesize_text(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False).where("entity_type is not null")
    return rows.select("doc_id", enrich.synthesized(F.date_format("ts", "yyyy-MM-dd")).alias("memory"))


@query
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("id", T.date_value(F.col("text"), F.lit("2024-01-31").cast("date")).alias("date_value"))


@query
def person_extract(spark: SparkSession, d: str) -> DataFrame:
    """Over whole conversations; the judging words are of the tables' language."""
    rows = views.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return persons.persons(rows, *X.JUDGING)


@query
def enrich_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False).where("entity_type is not null").select("doc_id", "text", "entity_type", "entity_subtype")
    return enrich.enriched(rows).select("doc_id", "base_importance", "boost", "importance", "impact", "temporal_type", "supersedes", F.array_join("tags", ",").alias("tags"), "business_value")


@query
def importance_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumns({"entity_type": F.lit("FACT"), "entity_subtype": F.lit("health")})
    return rows.select("id", enrich.keyword_boost(F.col("text")).alias("boost"), F.array_join(enrich.tags(F.col("text")), ",").alias("tags"))


@query
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents, a third of them with an echo in the middle of the text."""
    half = F.floor(F.length("text") / 2).cast("int")
    echoed = F.concat(F.left("text", half), F.lit("[MEMORY]an\necho[/MEMORY]"), F.substr("text", half + 1))
    clean = T.strip_tags(F.when(F.col("id") % 3 == 0, echoed).otherwise(F.col("text")))
    return _rows(spark, d).select("id", F.md5(clean).alias("clean"), T.word_count(clean).alias("words"))


@query
def content_id_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = store.prepared(views.memories(spark, d, False).drop("mem_id")).withColumn("write_seq", F.col("doc_id"))
    return store.upserted(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")).select("mem_id", "doc_id", "importance", store.user_hash("s0").alias("user_hash"))


@query
def delete_superseded(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False)
    keys = rows.where("entity_type = 'DATE' and entity_subtype = 'deadline'").select("persona_id", "user_id", "source", "entity_subtype").distinct()
    return store.superseded(rows, keys).groupBy("source").agg(F.count("*").alias("n"))


@query
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.latest_wins(views.memories(spark, d, False)).select("doc_id", "user_id", "source", "entity_subtype")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on the query set's documents as new memories against their
    users' stored ones, looked up as the best five of a pool of 25."""
    rows = views.memories(spark, d)
    pool = search.pooled(rows.where("doc_id % 20 <> 0"), views.queries(spark, d), 25, own_user=True, texts=False)
    near = search.reranked(pool, views.as_of()).where("rank <= 5")
    near = near.select(F.col("qid").alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("entity_subtype").alias("other_subtype"), F.round(1 - F.col("distance") / 2, 6).alias("similarity"), "rank")
    return consolidate.decided(_new(spark, d).select("doc_id", "entity_subtype"), near)


def _new(spark: SparkSession, d: str) -> DataFrame:
    asked = views.queries(spark, d).select(F.col("qid").alias("doc_id"))
    return views.memories(spark, d, False).join(asked, "doc_id", "left_semi")


@query
def consolidate_action(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).withColumn("archived", F.array_join("archived", ","))


@query
def consolidate_apply(spark: SparkSession, d: str) -> DataFrame:
    """The memory table after these decisions."""
    stored = views.memories(spark, d, False).where("doc_id % 20 <> 0")
    rows = consolidate.carried_out(stored, _new(spark, d), _decisions(spark, d))
    return rows.select("doc_id", "importance", "mentions", "last_mentioned", "is_active", F.get_json_object("note", "$.by").alias("by"))


@query
def merge_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False).withColumn("digest", F.md5("text"))
    return consolidate.merged(rows, ["digest"]).where("mentions > 1")


@query
def consolidation_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False)
    kept = consolidate.latest_wins(rows).select("doc_id", F.lit(True).alias("kept"))
    return consolidate.stats(rows.join(kept, "doc_id", "left").withColumn("is_active", F.coalesce("kept", F.lit(False))))


@query
def phrase_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return store.without_phrases(views.session(spark, d), ("the th", "TION")).select("conv_id", "seq", "role")


@query
def copy_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = views.session(spark, d).withColumn("mem_id", store.content_id("s0", F.col("conv_id").cast("string"), "role", "content"))
    return store.copy_missing(rows, rows.where("conv_id % 3 = 0"), "mem_id").select("mem_id")


@query
def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Conversations put into a bucketed table in two writes, some of them twice."""
    echoed = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("[MEMORY]an echo[/MEMORY] "), "content")).otherwise(F.col("content"))
    rows = views.session(spark, d).select("conv_id", "role", echoed.alias("content"), "ts", F.col("seq").cast("long").alias("write_seq"), F.col("content").alias("thought"), F.col("content").alias("hint"))
    rows = scratch.written(store.prepared_messages(rows))
    table = Table.open(spark, scratch.folder(spark, "sessions"), "mem_id", 8, rows.schema)
    table.upsert(rows.where("conv_id % 2 = 0"), "write_seq")
    table.upsert(rows.where("conv_id % 2 = 1 or conv_id % 4 = 0"), "write_seq")
    return table.read().select("mem_id", "conv_id", "role", "importance", F.length("thought").alias("thought_chars"), F.length("hint").alias("hint_chars"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns as messages, each with a vector of the table."""
    vectors = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    own = views.session(spark, d).where("role = 'user'")
    rows = own.select((F.col("conv_id") * 1000 + F.col("seq")).alias("doc_id"), F.col("content").alias("text"), "ts")
    return rows.join(vectors, F.col("doc_id") % F.lit(vectors.count()) == F.col("vec_id")).drop("vec_id")


@query
def conversation_pipeline(spark: SparkSession, d: str) -> DataFrame:
    found = enrich.remembered(_turns(spark, d), _classes(spark, d), 0.3)
    return found.select("doc_id", "entity_type", "entity_subtype", "confidence", "importance", "impact", F.md5("memory").alias("digest"))


@query
def reingest(spark: SparkSession, d: str) -> DataFrame:
    """User turns of 30 characters and more, through the conversation pipeline
    and into a bucketed table of memories."""
    turns = _turns(spark, d).where(F.length("text") >= 30).withColumn("user_id", F.concat(F.lit("u"), (F.floor(F.col("doc_id") / 1000) % 10).cast("string")))
    found = enrich.remembered(turns, _classes(spark, d), 0.3)
    source = F.lit("enriched")
    for kind, name in REINGEST_SOURCES.items():
        source = F.when(F.col("entity_type") == kind, name).otherwise(source)
    great = F.col("entity_type").isin("MILESTONE", "SHARED_THING")
    rows = found.select("user_id", F.col("memory").alias("text"), source.alias("source"), great.alias("is_milestone"), "importance", "entity_subtype", "ts", F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), "entity_type").alias("write_seq"))
    rows = scratch.written(store.prepared(rows))
    table = Table.open(spark, scratch.folder(spark, "memories"), "mem_id", 8, rows.schema)
    table.upsert(rows, "write_seq")
    table.upsert(rows, "write_seq")  # a rerun changes nothing
    return table.read().select("mem_id", "source", F.col("is_milestone").alias("milestone"), "importance", "entity_subtype", "ts")


@query
def session_last_n(spark: SparkSession, d: str) -> DataFrame:
    return state.last_messages(views.session(spark, d), 10).select("conv_id", "role", "seq", "place")


@query
def raw_window_48h(spark: SparkSession, d: str) -> DataFrame:
    return state.recent_window(views.session(spark, d), views.as_of()).select("user_id", "conv_id", "seq", "place")


@query
def relative_age(spark: SparkSession, d: str) -> DataFrame:
    """The ages of events of all users, to the second, a day after their last."""
    end = F.lit("2024-02-01").cast("timestamp_ntz")
    return views.table(spark, d, "events").select("event_id", T.relative_age(F.col("ts").cast("timestamp_ntz"), end).alias("label"))


@query
def newest_five(spark: SparkSession, d: str) -> DataFrame:
    return views.memories(spark, d, False).where("source <> 'chat'").orderBy(F.desc("ts"), "doc_id").limit(5).select("doc_id", "ts", F.left("text", F.lit(80)).alias("beginning"))


@query
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_source(views.memories(spark, d, False))


@query
def importance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.importance_histogram(views.memories(spark, d, False))


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(views.memories(spark, d, False))


@query
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.counts(views.memories(spark, d, False), views.as_of())


@query
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return audit.health(views.memories(spark, d, False), views.as_of())


def _label_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(qid, label) of the query vectors, and (doc_id, label) of all memories by
    their vectors, with ``chat``, whether one is of that source."""
    vectors = views.table(spark, d, "embeddings").select("vec_id", "label")
    docs = views.memories(spark, d, False).select("doc_id", F.coalesce(F.col("source") == "chat", F.lit(False)).alias("chat"))
    docs = docs.join(vectors, F.col("doc_id") % F.lit(vectors.count()) == F.col("vec_id")).where("label is not null").select("doc_id", "label", "chat")
    return vectors.where("vec_id % 20 = 0 and label is not null").select(F.col("vec_id").alias("qid"), "label"), scratch.written(docs)


def _expected(spark: SparkSession, d: str) -> evaluate.ByLabel:
    """Memories whose vector has the query vector's label."""
    asked, docs = _label_tables(spark, d)
    return evaluate.ByLabel(asked, docs.select("doc_id", "label"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, evaluate.ByLabel, DataFrame, evaluate.ByLabel]:
    """Queries asked, expected rows, must-include rows (a query's own document)
    and must-exclude rows (expected chat)."""
    asked, (own, docs) = views.queries(spark, d).select("qid"), _label_tables(spark, d)
    expected, chat = (evaluate.ByLabel(own, rows.select("doc_id", "label")) for rows in (docs, docs.where("chat")))
    return asked, expected, asked.select("qid", F.col("qid").alias("doc_id")), chat


@query
def retrieval_score(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.retrieval_score(_pool(spark, d), *_labelled(spark, d))


@query
def precision_at_3(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_at(_pool(spark, d), _expected(spark, d))


def _grid(pool: DataFrame, labels: tuple[DataFrame, ...]) -> DataFrame:
    rows = pool.select(
        "qid", "doc_id", "knn_rank", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") / 2), 6).alias("similarity"), (F.col("importance") / 10).alias("importance"),
        F.round(search.recency(RankConfig(), views.as_of()), 6).alias("recency"),
    )
    return evaluate.weight_grid(rows, *labels, list(X.GRID))


@query
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(_pool(spark, d), _labelled(spark, d))


def _measured_pool(spark: SparkSession, d: str) -> DataFrame:
    return scratch.written(_pool(spark, d, texts=True))


def _scores_of(spark: SparkSession, d: str, pool: DataFrame, labels: tuple, grid: DataFrame, sweep: DataFrame) -> DataFrame:
    """(name, score): the five measures of the evaluation, out of 10, from its pool
    and labels and what the weight sets and penalties gave over them."""
    of = lambda df, name, score: df.select(F.lit(name).alias("name"), F.round(score, 6).alias("score"))
    share = lambda df: df.agg((10 * F.count_if("passed") / F.greatest(F.count("*"), F.lit(1))).alias("s"))
    parts = [
        of(share(_ingestion(spark, d)), "ingestion", F.col("s")),
        of(evaluate.retrieval_score(pool, *labels), "retrieval", F.col("score")),
        of(grid.where("best"), "reranker", F.col("score")),
        of(sweep.agg(F.max("diversity").alias("s")), "mmr", 10 * F.col("s")),
        of(share(evaluate.keyword_hits(pool, _wanted(spark, d))), "e2e", F.col("s")),
    ]
    return functools.reduce(DataFrame.union, parts)


@query
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What the measured results of the evaluation and the audit ask for."""
    pool, labels = _measured_pool(spark, d), _labelled(spark, d)
    grid, sweep = (scratch.written(x) for x in (_grid(pool, labels), _sweep(pool)))
    c, of = audit.counts(views.memories(spark, d, False), views.as_of()), F.greatest(F.col("total"), F.lit(1))
    ratio = F.when(F.col("enriched") == 0, F.lit(float("inf"))).otherwise(F.col("sessions") / F.col("enriched"))
    audited = {"duplicates": F.col("extra").cast("double"), "short_share": F.col("short") / of, "stale_share": F.col("stale") / of, "session_ratio": ratio}
    listed = F.array(*(F.struct(F.lit(k).alias("measure"), x.alias("value")) for k, x in audited.items()))
    measured = _scores_of(spark, d, pool, labels, grid, sweep).select(F.col("name").alias("measure"), F.col("score").alias("value"))
    measured = measured.union(evaluate.gain_over(grid, "weights_gain", "score", F.col("name") == X.GRID[0][0]))
    measured = measured.union(evaluate.gain_over(sweep, "penalty_gain", "diversity", F.col("penalty") == RankConfig().diversity))
    return evaluate.recommendations(measured.union(c.select(F.inline(listed))))


@query
def text_to_id(spark: SparkSession, d: str) -> DataFrame:
    """The first three results' texts back to all documents."""
    found = _pool(spark, d, texts=True).where("rank <= 3").select(F.concat_ws(":", "qid", "rank").alias("result_id"), "text")
    return search.resolved(scratch.written(found), views.table(spark, d, "documents").select("doc_id", "text"))


def _sweep(pool: DataFrame) -> DataFrame:
    return evaluate.diversity_sweep(pool.withColumn("cluster", F.col("source")), list(X.PENALTIES))


@query
def mmr_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(_pool(spark, d))


@query
def calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label", "embedding")
    return evaluate.calibration(rows, F.col("qid") % 20 == 0)


@query
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    pool, labels = _measured_pool(spark, d), _labelled(spark, d)
    return evaluate.overall(_scores_of(spark, d, pool, labels, _grid(pool, labels), _sweep(pool)))


@query
def content_type(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _rows(spark, d).select("id", T.content_type(t).alias("kind"), T.content_density(t).alias("density"), T.estimated_tokens(t).alias("tokens"))


@query
def trim(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("target", F.explode(F.array(F.lit(40), F.lit(200), F.lit(1000))))
    return rows.select("id", "target", F.md5(T.trimmed(F.col("text"), F.col("target"))).alias("short"))


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return grounding.fitted(_pool(spark, d, texts=True).where("rank <= 6"), 12000, 3000)


@query
def budget_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d).select("qid", "doc_id", "place", "trimmed", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def context_build(spark: SparkSession, d: str) -> DataFrame:
    return grounding.context(_fitted(spark, d)).select("qid", "n", "chars", "tokens", F.md5("context").alias("digest"))


@query
def xp_running(spark: SparkSession, d: str) -> DataFrame:
    return state.progressed(views.state_events(spark, d)).select("user_id", "event_id", "gained", "xp", "level", "messages")


@query
def mood_last_value(spark: SparkSession, d: str) -> DataFrame:
    return state.progressed(views.state_events(spark, d)).select("user_id", "event_id", "mood", "topic")


@query
def levels(spark: SparkSession, d: str) -> DataFrame:
    rows = state.progressed(views.state_events(spark, d)).groupBy("user_id").agg(F.max("xp").alias("xp"))
    return rows.select("user_id", "xp", state.level(F.col("xp")).alias("level"))


@query
def state_update(spark: SparkSession, d: str) -> DataFrame:
    rows = state.updated(views.state_messages(spark, d))
    return rows.select("user_id", "event_id", "gained", "xp", "level", "messages", "mood", "mood_since", "vibe", "topic")


@query
def final_state(spark: SparkSession, d: str) -> DataFrame:
    """Every user's whole state after all messages."""
    rows = state.final_states(views.state_messages(spark, d))
    return rows.select("user_id", "xp", "level", "messages", "mood", "mood_since", "vibe", "topic", "last_ts", F.array_join("concerns", ",").alias("concerns"))


@query
def state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every user's last state as JSON lines and back, with a key too many."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = state.progressed(views.state_events(spark, d)).withColumn("n", F.row_number().over(last)).where("n = 1")
    lines = state.saved(rows.select("user_id", "xp", "level", "messages", "mood", F.lit(1).alias("unknown")))
    return state.loaded(lines).select("user_id", "xp", "level", "messages", "mood", "vibe", F.size("concerns").alias("n_concerns"))


@query
def morning_message(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max(F.struct("ts", (-F.col("doc_id")).alias("o"), F.md5("text").alias("digest")))["digest"]
    rows = views.memories(spark, d, False).groupBy("user_id").agg(F.max(F.when(F.col("source") == "night_insight", F.lit(1))).alias("some"), newest.alias("digest"))
    states = rows.select("user_id", F.when(F.col("some") == 1, F.col("digest")).alias("message"), (F.substring("user_id", 2, 9).cast("int") % 2 == 0).alias("shown"))
    return state.read_once(states)


@query
def concern_fifo(spark: SparkSession, d: str) -> DataFrame:
    rows = views.state_messages(spark, d).where("added is not null or removed is not null")
    return state.folded_concerns(rows.select("user_id", F.struct("ts", "event_id").alias("seq"), "added", "removed")).select("user_id", F.array_join("concerns", ",").alias("concerns"))


@query
def nightly_window(spark: SparkSession, d: str) -> DataFrame:
    """What the nightly analysis reads; a thirteenth of the times can't be read."""
    rows = views.memories(spark, d, False)
    at = F.when(F.col("doc_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    lines = state.nightly_lines(rows.withColumn("at", at), views.as_of(), (*EXCLUDED_SOURCES, "night_insight", "project_knowledge"))
    return lines.withColumn("line", F.md5("line"))


@query
def state_at_message(spark: SparkSession, d: str) -> DataFrame:
    """The state that each session message met: that of its user's last event."""
    said = views.session(spark, d).select((F.col("conv_id") % 10).alias("user_id"), "ts", "conv_id", "seq")
    states = state.progressed(views.state_events(spark, d)).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "xp", "mood")
    return state.state_at(said, states).select("conv_id", "seq", "state.event_id", "state.xp", "state.mood")


@query
def audit_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The audit from stored daily aggregates and those of new memories alone."""
    rows = views.memories(spark, d, False)
    stored = scratch.written(audit.daily(rows.where("doc_id % 4 <> 0")))
    out = audit.counts_of_days(audit.brought_up(stored, audit.daily(rows.where("doc_id % 4 = 0"))), views.as_of())
    exact = rows.agg(F.count_distinct(F.coalesce("text", F.lit(""))).alias("texts"))
    return out.join(F.broadcast(exact)).withColumn("close", F.abs(F.col("distinct_texts") / F.col("texts") - 1) < 0.05).drop("distinct_texts", "texts")


@query
def insight_parse(spark: SparkSession, d: str) -> DataFrame:
    return state.parsed_insights(views.insights(spark, d), "raw").select("id", "text", "confidence", "importance")


@query
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = views.replies(spark, d).select("id", T.parsed_reply(F.col("raw")).alias("r"))
    return rows.select("id", F.md5("r.response").alias("response"), "r.thought", "r.hint", "r.mood", "r.topic", "r.safe_haven")


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """All words of each query as its keywords."""
    return views.queries(spark, d).select("qid", T.query_tokens(F.col("qtext")).alias("keywords"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.keyword_hits(_pool(spark, d, texts=True), _wanted(spark, d))


@query
def keyword_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query
def sanity_score(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sanity_score(_hits(spark, d), 0.5)


def _ingestion(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False).where("entity_type is not null")
    cases = rows.select("doc_id", F.array("entity_type", F.lit("GOAL")).alias("types"), F.array("entity_subtype", F.lit("project"), F.lit("career")).alias("subtypes"), F.lit(0.35).alias("least"))
    return evaluate.ingestion(cases, _entities(spark, d))


@query
def ingestion_rule(spark: SparkSession, d: str) -> DataFrame:
    return _ingestion(spark, d)


@query
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """The mean of what is ingested, recalled and grounded."""
    graded = grounding.graded(views.queries(spark, d), search.knn(views.memories(spark, d), views.queries(spark, d), 6))
    mean = lambda df, name, x: df.agg(F.avg(x).alias("score")).select(F.lit(name).alias("name"), "score")
    parts = [
        mean(_ingestion(spark, d), "pipeline", F.col("passed").cast("double")), mean(evaluate.precision_at(_pool(spark, d), _expected(spark, d)), "recall", F.col("precision")),
        mean(graded, "grounding", (F.col("status") != "NO_DATA").cast("double")),
    ]
    return evaluate.readiness(functools.reduce(DataFrame.union, parts))


@query
def memory_block(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d, texts=True).where("rank <= 6").withColumn("line", T.memory_line(F.col("ts"), views.as_of()))
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return out.select("qid", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"))


@query
def since_label(spark: SparkSession, d: str) -> DataFrame:
    last = views.session(spark, d).groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", state.since_label(F.col("ts"), views.as_of()).alias("label"))


@query
def state_block(spark: SparkSession, d: str) -> DataFrame:
    blocks = state.state_block(state.final_states(views.state_messages(spark, d)), views.as_of())
    return blocks.withColumn("block", F.md5("block"))


@query
def raw_block(spark: SparkSession, d: str) -> DataFrame:
    blocks = state.recent_block(state.recent_window(views.session(spark, d), views.as_of()), views.as_of())
    return blocks.withColumn("block", F.md5("block"))


@query
def insight_window(spark: SparkSession, d: str) -> DataFrame:
    """Of the last 480 hours, as the tables' insights are spread over 90 days; the
    operator's own default is 16."""
    return state.insight_window(views.memories(spark, d, False), views.as_of(), 480).select("user_id", "doc_id", "place")


@query
def soft_archive(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False)
    old = rows.join(consolidate.latest_wins(rows).select("doc_id"), "doc_id", "left_anti").select("doc_id")
    return consolidate.archived(rows, old, "newer").select("doc_id", "is_active", F.get_json_object("note", "$.archived_because").alias("reason"))


@query
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = views.memories(spark, d, False).select("mem_id", "user_id")
    return consolidate.inserted_if_absent(rows.where("user_id <> 'u3'").dropDuplicates(["mem_id"]), rows, "mem_id")


@query
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("id", F.md5(T.ascii_folded(F.col("text"))).alias("folded"))


@query
def stream_xp(spark: SparkSession, d: str) -> DataFrame:
    """Running XP over the stream of events, run to its end in micro-batches."""
    return streams.run_progress(views.state_events(spark, d, stream=True))


@query
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over the stream of messages, run to its end."""
    with machine.with_rocksdb(spark):
        return streams.run_to_table(machine.companion_stream(views.state_messages(spark, d, stream=True)))
