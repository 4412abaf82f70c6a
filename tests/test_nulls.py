"""Nulls, empty texts, ties and empty tables in the memory engine's operators."""

import pytest
from pyspark.sql import functions as F

from recallspark.config import AS_OF
from recallspark.functions import text as T
from recallspark.operators import audit, consolidate, enrich, grounding, search, state
from recallspark.sources import store

KINDS = "doc_id long, user_id string, persona_id string, source string, text string, importance int, is_milestone boolean, ts string, entity_type string, entity_subtype string, embedding array<float>"
ROWS = [
    (1, "u", "p", "extracted_fact", "some text of a fact with words", 5, False, "2024-01-30 10:00:00", "FACT", "preference", [1.0, 0.0]),
    (2, "u", "p", "extracted_fact", "some text of a fact with words", 5, False, "2024-01-30 10:00:00", "FACT", "preference", [1.0, 0.0]),
    (3, "u", "p", "extracted_fact", None, 5, None, None, "FACT", None, [0.0, 1.0]),
    (4, "u", None, "chat", "", None, False, "2024-01-30 10:00:00", None, None, [0.5, 0.5]),
    (5, None, "p", None, "other text", 9, True, None, "MILESTONE", "gratitude", None),
    (6, "u", "p", "chat", "żółć 漢字 😀", 1, False, "2025-01-01 00:00:00", None, "tired", [float("nan"), 1.0]),
]


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame(ROWS, KINDS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "u", "text of words", [1.0, 0.0]), (2, "u", None, [0.0, 1.0]), (3, "u", "words", None), (4, None, "", [1.0, 1.0])], "qid long, user_id string, qtext string, embedding array<float>")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def test_search_with_nulls_and_ties(memories, queries):
    memories = memories.where("doc_id <> 6")
    ranked = search.reranked(search.pooled(memories, queries, 5), as_of())
    got = {(r.qid, r.doc_id): r for r in ranked.collect()}
    assert {q for q, _ in got} == {1, 2, 4} and len(got) == 12
    assert got[1, 1].final_score == got[1, 2].final_score and got[1, 1]["rank"] < got[1, 2]["rank"]  # a tie goes by nearness and id
    assert got[1, 3].s_recency == 0.5 and got[1, 4].s_importance == 0.5
    assert got[1, 1].s_keyword > 0 and got[2, 1].s_keyword in (None, 0.0) and got[4, 1].s_keyword == 0.0
    fits = grounding.fitted(ranked, 100).collect()
    assert all(r.text is not None for r in fits) or len(fits) >= 3
    assert search.mmr(ranked, 3, 0.8).count() == 9
    assert search.three_channels(memories, queries, as_of()).where("qid = 1").count() >= 2


def test_searches_of_empty_tables(spark, memories, queries):
    assert search.reranked(search.pooled(memories.where("false"), queries, 5), as_of()).count() == 0
    assert search.three_channels(memories, queries.where("false"), as_of()).count() == 0
    assert grounding.graded(queries, search.knn(memories.where("false"), queries, 3)).where("status = 'NO_DATA'").count() == 4


def test_enrichment_and_classes(spark, memories):
    rows = {r.doc_id: r for r in enrich.enriched(memories).collect()}
    assert rows[3].base_importance == 5 and rows[3].tags == ["fact"] and rows[4].tags == [] and rows[6].supersedes == "topic:current_energy"
    assert rows[3].importance in (5, None) and rows[5].importance == 8
    classes = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "c", [0.0, 1.0])], "ordinal int, name string, centroid array<double>")
    best = {r.doc_id: r.label for r in enrich.best_class(memories, classes, 0.3, "none").collect()}
    assert best == {1: "a", 2: "a", 3: "c", 4: "a"}  # null, NaN and zero vectors have no row; the first of equals wins


def test_consolidation_and_audits(memories):
    assert sorted(r.doc_id for r in consolidate.latest_wins(memories).collect()) == [2, 3, 4, 5, 6]
    counts = audit.counts(memories, as_of()).first()
    assert counts.total == 6 and counts.extra == 1
    assert audit.counts(memories.where("false"), as_of()).first().total == 0 and audit.health(memories.where("false"), as_of()).first().score == 8
    merged = {r.digest: r for r in consolidate.merged(memories.withColumn("digest", F.md5(F.coalesce("text", F.lit("none")))), ["digest"]).collect()}
    assert sorted(r.mentions for r in merged.values()) == [1, 1, 1, 1, 2]
    assert {r.source: r.n for r in audit.by_source(memories).collect()} == {"extracted_fact": 3, "chat": 2, None: 1}


def test_stores_and_texts(spark, memories):
    kept = store.prepared(memories)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6] or sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    gone = store.without_phrases(spark.createDataFrame([(1, None), (2, ""), (3, "TOXIC words")], "i int, content string"), ("toxic",))
    assert sorted(r.i for r in gone.collect()) == [1, 2]
    row = memories.where("doc_id = 3").select(
        T.content_type(F.col("text")).alias("kind"), T.words(F.col("text")).alias("words"), T.date_value(F.col("text"), F.lit("2024-01-31").cast("date")).alias("date"), T.phrases_in(F.col("text"), ("a",)).alias("held")
    ).first()
    assert row.kind == "GENERAL" and row.date is None and row.held in (None, [])


def test_sessions(spark):
    rows = [(1, "user", "b", "2024-01-30 10:00:00", 2, "u"), (1, "user", "a", "2024-01-30 10:00:00", 1, "u"), (1, "model", None, None, 3, "u"), (2, "user", None, "2024-01-30 11:00:00", 1, None)]
    session = spark.createDataFrame(rows, "conv_id long, role string, content string, ts string, seq long, user_id string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    last = state.last_messages(session, 2).collect()
    assert sorted((r.conv_id, r.seq, r.place) for r in last) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    window = state.recent_window(session, as_of())
    assert {(r.user_id, r.seq): r.place for r in window.collect()} == {("u", 2): 1, ("u", 1): 2, (None, 1): 1}
    assert {r.user_id: r.block for r in state.recent_block(window, as_of()).collect()}["u"] == "• [14h temu] a\n• [14h temu] b"
    assert store.prepared_messages(session.withColumns({"thought": F.lit("x" * 900), "hint": F.lit(None).cast("string")})).count() == 2
