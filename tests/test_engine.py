"""Properties and small cases of the memory engine."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from recallspark.config import RankConfig
from recallspark.functions import text as T
from recallspark.operators import audit, enrich, evaluate, grounding, persons, search, state
from recallspark.plans import fixtures as X
from recallspark.plans.queries import REGISTRY
from recallspark.sources import store, views

DATA = "/root/testdata/sf0.001"


def test_no_diversity_is_rank_order(spark):
    ranked = search.reranked(search.pooled(views.memories(spark, DATA), views.queries(spark, DATA), 30), views.as_of())
    chosen = {(r.qid, r.doc_id, r.pick) for r in search.mmr(ranked, 3, 0.0).collect()}
    assert chosen == {(r.qid, r.doc_id, r["rank"]) for r in ranked.where("rank <= 3").collect()}
    assert ranked.agg(F.max("final_score")).first()[0] <= 1.5


def test_mmr_of_short_pools(spark):
    rows = spark.createDataFrame([(1, 7, [1, 2], 0.5, 1)], "qid long, doc_id long, tokens array<long>, final_score double, rank int")
    assert [(r.doc_id, r.pick) for r in search.mmr(rows, 3, 0.8).collect()] == [(7, 1)]


def test_knn_of_an_empty_table(spark):
    none = views.memories(spark, DATA).where("false")
    assert search.knn(none, views.queries(spark, DATA), 3).count() == 0


@pytest.mark.parametrize("room", [0, 40, 120, 500, 10_000])
def test_budget_is_kept(spark, room):
    ranked = search.reranked(search.pooled(views.memories(spark, DATA), views.queries(spark, DATA), 10), views.as_of())
    used = grounding.fitted(ranked, room).groupBy("qid").agg(F.sum(F.length("text")).alias("n"))
    assert used.where(F.col("n") > room).count() == 0


def test_upsert_is_idempotent(spark):
    rows = store.prepared(views.memories(spark, DATA, False).drop("mem_id")).withColumn("write_seq", F.col("doc_id"))
    once = store.upserted(rows.limit(0), rows)
    assert once.count() == store.upserted(once, rows).count() == rows.select("mem_id").distinct().count()


def test_grounding_cases(spark):
    asked = spark.createDataFrame([(q,) for q, _ in X.GROUNDING], "qid int")
    found = spark.createDataFrame([(q, float(x)) for q, ds in X.GROUNDING for x in ds], "qid int, distance double")
    got = {r.qid: r.status for r in grounding.graded(asked, found).collect()}
    assert got == {1: "NO_DATA", 2: "NO_DATA", 3: "GROUNDED", 4: "LOW_CONFIDENCE", 5: "LOW_CONFIDENCE", 6: "NO_DATA"}


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_dates(spark):
    got = [r.d for r in texts(spark, X.DATES).select("id", T.date_value(F.col("text"), F.lit("2024-01-31").cast("date")).alias("d")).orderBy("id").collect()]
    assert got == [
        "2024-02-03", "2024-02-14", "2024-03-01", "2024-02-07", "2024-03-01", "2024-02-01", "2024-02-02", "2024-01-31", "2024-02-01", "2024-02-07", "2024-03-15", None,
        "2025-01-05", "2024-05-12", None, "2025-01-07", "2024-03-31", "2024-06-15", "2024-02-28", None,
    ]


def test_tags_and_boosts(spark):
    got = [r.c for r in texts(spark, X.TAGGED).select("id", T.strip_tags(F.col("text")).alias("c")).orderBy("id").collect()]
    assert got == ["witaj  świecie", "bez znacznika", "", "x [MEMORY] otwarty"]
    assert [r.b for r in texts(spark, X.BOOSTS).select("id", enrich.keyword_boost(F.col("text")).alias("b")).orderBy("id").collect()] == [3, 1, 2, 0, 2, 2]
    assert [r.f for r in texts(spark, X.FOLDED).select("id", T.ascii_folded(F.col("text")).alias("f")).orderBy("id").collect()] == ["zazoc gesla jazn", "ozko", "naive cafe", "plain", " x"]


def test_trims_and_ages(spark):
    kinds = [r.k for r in texts(spark, X.CONTENT).select("id", T.content_type(F.col("text")).alias("k")).orderBy("id").collect()]
    assert kinds == ["CODE", "INSTRUCTION", "FACT", "EMOTIONAL", "GENERAL", "GENERAL", "CODE", "INSTRUCTION"]
    short = texts(spark, X.CONTENT).select("id", T.trimmed(F.col("text"), F.lit(40)).alias("t")).orderBy("id").collect()
    assert short[1].t == "Najpierw otwórz plik." and short[0].t == X.CONTENT[0] and short[4].t.endswith("...") and len(short[4].t) <= 40
    end = F.lit("2024-02-01").cast("timestamp_ntz")
    ages = spark.createDataFrame(list(enumerate(X.AGES)), "id int, s int").select("id", T.relative_age(end - F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")), end).alias("l"))
    assert [r.l for r in ages.orderBy("id").collect()] == ["[przed chwilą] ", "[6 min temu] ", "[1 godz. temu] ", "[1 dni temu] ", "[1 mies. temu] ", "[przed chwilą] ", "[60 min temu] ", "[1 dni temu] ", ""]


def test_insights(spark):
    got = [tuple(r) for r in state.parsed_insights(texts(spark, (*X.INSIGHTS, "broken [", None)), "text").collect()]
    assert got == [(0, "pierwszy dłuższy wniosek", 0.8, 6), (1, "drugi dłuższy wniosek", 0.6, 5)]


def test_measures_of_fixed_scores(spark):
    scores = spark.createDataFrame(list(X.SCORES), "name string, score double")
    assert tuple(evaluate.overall(scores).first()) == (7.55, "GOOD")
    assert tuple(evaluate.readiness(spark.createDataFrame(list(X.SECTIONS), "name string, score double")).first()) == (0.9, "ready")
    fine = spark.createDataFrame([("ingestion", 9.0), ("duplicates", 3.0), ("unknown", 0.0)], "measure string, value double")
    assert [tuple(r) for r in evaluate.recommendations(fine).collect()] == [("all", "none", None, "none")]
    bad = spark.createDataFrame([("ingestion", 6.9), ("retrieval", 7.0), ("duplicates", 11.0)], "measure string, value double")
    assert sorted((r.subject, r.value) for r in evaluate.recommendations(bad).collect()) == [("audit", 11.0), ("ingestion", 6.9)]
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.5)], "name string, score double")
    assert evaluate.gain_over(rows, "g", "score", F.col("name") == "a").first().value == 1.5


def test_concerns_fold(spark):
    def fold(updates):
        kept = []
        for _, added, removed in updates:
            if added and added not in kept:
                kept.append(added)
            kept = [c for c in kept[-5:] if c != removed]
        return kept

    rows = spark.createDataFrame(list(X.CONCERNS), "seq int, added string, removed string").withColumn("user_id", F.lit("u"))
    assert state.folded_concerns(rows.repartition(3)).first().concerns == fold(X.CONCERNS)
    one = spark.createDataFrame([("u1", 1, "a", "a")], "user_id string, seq int, added string, removed string")
    assert state.folded_concerns(one).first().concerns == []


def test_replies(spark):
    got = [r.r for r in spark.createDataFrame(list(enumerate(X.REPLIES)), "id int, text string").select("id", T.parsed_reply(F.col("text")).alias("r")).orderBy("id").collect()]
    assert [r.response for r in got] == ["dobrze", "w porządku", "urwana odpowiedź", "…", "…", "…"]
    assert got[0].safe_haven and got[0].mood == "calm" and got[1].hint == "h"


def plain_persons(text, negative, positive, context, known, excluded):
    """(name, subtype, text) of a message, by plain loops."""
    low = text.lower()
    names = {}
    for n in [m.group(1) for m in re.finditer(persons.NAME.replace(r"[\p{L}\p{N}_]", r"\w"), text)] + [k.capitalize() for k in known if k in low]:
        names.setdefault(n.lower(), n)
    out = []
    for key, name in names.items():
        if key in excluded:
            continue
        at = low.find(key)
        window = low[max(0, at - 100) : at + 500]
        near = {s: [w for w in ws if w in window] for s, ws in (("bad", negative), ("good", positive))}
        found = near if near["bad"] or near["good"] else {s: [w for w in ws if w in low] for s, ws in (("bad", negative), ("good", positive))}
        other = [w for w in context if w in low]
        if not (found["bad"] or found["good"] or other or key in known):
            continue
        words = found["bad"] or found["good"] or other or [key]
        parts = [p for p in re.split(r"(?<=[.!?\n])", text) if key in p.lower() or any(w in p.lower() for w in words)]
        parts = [p.strip(" ").lstrip("user: ").lstrip("model: ") for p in parts]  # noqa: B005
        parts = [p for p in parts if len(p) > 5][:4]
        body = " ".join(parts) if parts else window.strip(" ")[:300]
        said = f"{name}: {body}"[:400]
        if len(said) >= len(name) + 10:
            out.append((name, "negative_person" if found["bad"] else "positive_person", said))
    return out


def test_persons_by_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(X.PERSONS)] + [(10, None), (11, ""), (12, "Marek. Marek Nowak kłamie? marek MAREK Ewa"), (13, "x" * 700 + " Ewa " + "y" * 700 + " oszust"), (14, "user: Ola i Ula są razem. model: tak")]
    own = (("kłamie", "oszust"), ("pomocna", "uczciwy"), ("rozmawiałem z", "razem"), ("ula",), ("rozmawiałem", "zwykłe"))
    got = sorted((r.doc_id, r["name"], r.subtype, r.text) for r in persons.persons(spark.createDataFrame(rows, "doc_id int, text string"), *own).collect())
    assert got == sorted((i, *x) for i, t in rows if t for x in plain_persons(t, *own))
    assert (0, "Marek", "negative_person") in {r[:3] for r in got} and (2, "Ewa", "positive_person") in {r[:3] for r in got}
    talk = spark.read.parquet(f"{DATA}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text").collect()
    got = sorted((r.doc_id, r["name"], r.subtype, r.text) for r in REGISTRY["person_extract"](spark, DATA).collect())
    assert len(got) > 50 and got == sorted((r.doc_id, *x) for r in talk if r.text for x in plain_persons(r.text, *X.JUDGING))


def test_stream_matches_batch(spark):
    batch = {(r.event_id, r.xp) for r in REGISTRY["xp_running"](spark, DATA).collect()}
    assert {(r.event_id, r.xp) for r in REGISTRY["stream_xp"](spark, DATA).collect()} == batch


def test_upserting_stream(spark, tmp_path):
    from recallspark.sources.table import Table
    from recallspark.streaming.state import upserting

    kinds = "mem_id string, text string, write_seq long"
    for rows in ([("a", "x", 1), ("b", "y", 2)], [("a", "z", 3)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upserting(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    table = Table.open(spark, str(tmp_path / "out"), "mem_id", 4, spark.createDataFrame([], kinds).schema)
    assert {r.mem_id: r.text for r in table.read().collect()} == {"a": "z", "b": "y"} and table.manifest["version"] == 2


def test_windowed_counts(spark, tmp_path):
    from recallspark.streaming.state import windowed_counts

    views.session(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s"))
    windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == views.session(spark, DATA).where("role = 'user'").count()


def test_tables_and_knowledge(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps([{"text": "fakt", "source": "project_knowledge", "metadata": {"aspect": "x"}}]))
    row = store.read_knowledge(spark, str(tmp_path / "k.json")).first()
    assert row.importance == 5 and row.metadata == {"aspect": "x"}
    store.write_table(views.memories(spark, DATA), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).where("source = 'chat'")
    assert "source" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert back.count() == views.memories(spark, DATA, False).where("source = 'chat'").count()


def test_many_queries_go_in_blocks(spark, monkeypatch):
    memories, queries = views.memories(spark, DATA), views.queries(spark, DATA)
    want = sorted(map(tuple, search.knn(memories, queries, 4).collect()))
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    assert sorted(map(tuple, search.knn(memories, queries, 4).collect())) == want


def test_channels_are_searches_of_their_own(spark):
    memories, queries = views.memories(spark, DATA), views.queries(spark, DATA)
    goal = F.col("source") == "chat"
    got = search.nearest_of(memories, queries, [search.Channel(3, where=goal), search.Channel(5, True)]).collect()
    for i, alone in enumerate((search.knn(memories.where(goal), queries, 3), search.knn(memories, queries, 5, True))):
        assert sorted(tuple(r)[1:] for r in got if r.channel == i) == sorted(map(tuple, alone.collect()))


def test_vectors_with_nulls_and_ties(spark):
    kinds = "doc_id long, user_id string, embedding array<float>"
    memories = spark.createDataFrame([(3, "u", [1.0, 0.0]), (1, "u", [1.0, 0.0]), (2, None, [1.0, 0.0]), (4, "u", None), (5, "u", [None, 1.0]), (6, "u", [1.0]), (7, "u", [0.0, 1.0])], kinds)
    queries = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", None)], kinds.replace("doc_id", "qid"))
    assert [(r.doc_id, r.knn_rank) for r in search.knn(memories, queries, 3).orderBy("knn_rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [r.doc_id for r in search.knn(memories, queries, 9, True).orderBy("knn_rank").collect()] == [1, 3, 7]


def test_no_text_is_shuffled_to_be_scored(spark):
    ranked = search.reranked(search.pooled(views.memories(spark, DATA), views.queries(spark, DATA), 30, texts=False), views.as_of())
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("Window")[0] and "text" not in ranked.columns
    physical = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and physical.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_texts_to_ids_by_plain_search(spark, monkeypatch, few):
    """Every place of every beginning, also of short and repeated ones."""
    monkeypatch.setattr(search, "_FEW", few)
    rng = random.Random(few)
    word = lambda: "".join(rng.choice("abż😀 ") for _ in range(rng.choice([1, 3, 7, 20, 33, 49, 50, 51, 90])))
    docs = [(i, word()) for i in range(60)] + [(60, None), (61, ""), (62, "a" * 300)]
    docs += [(70 + i, word() + docs[rng.randrange(60)][1] + word()) for i in range(40)]
    results = [(f"r{i}", word() + docs[rng.randrange(60)][1][:60] + word()) for i in range(30)] + [("r98", "a" * 120), ("r99", None), ("r100", "zzz")]
    got = {r.result_id: r.doc_id for r in search.resolved(spark.createDataFrame(results, "result_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {}
    for r, t in results:
        hits = [i for i, x in docs if t and x and (x[:50] in t or t[:50] in x)]
        if hits:
            want[r] = min(hits)
    assert got == want and len(want) > 20


def test_pieces_come_once_a_text(spark):
    """A piece that a text has at 5,000 places is one row, and windows have their text's pieces."""
    texts = spark.createDataFrame([(1, "a" * 5000), (2, None), (3, "")], "id long, text string").where("text is not null")
    assert sorted(map(tuple, search._pieces(texts, [1, 50], {}).select("id", "width").collect())) == [(1, 1), (1, 50)]
    rng, widths = random.Random(7), [1, 2, 4, 8, 16, 32, 50]
    text = "".join(rng.choice("ab ż") for _ in range(700))
    whole = {w: set(h.tolist()) for w, h in search.chosen_pieces(text, widths)}
    for i in range(650):
        for w in widths:
            ((_, h),) = search.chosen_pieces(text[i : i + w], [w])
            assert len(h) == 1 and h[0] in whole[w]


def test_least_holder_after_many_that_do_not(spark):
    """The 40th candidate by rank is the first that holds."""
    pairs = spark.createDataFrame([("x", i) for i in range(100)] + [("y", 5)], "b string, doc_id long")
    got = search._least(pairs, "b", "doc_id", lambda df: df.where("b = 'x' and doc_id >= 40")).collect()
    assert [tuple(r) for r in got] == [("x", 40)]


def test_calibration_in_blocks(spark, monkeypatch):
    rows = views.table(spark, DATA, "embeddings").select(F.col("vec_id").alias("qid"), "label", "embedding")
    rows = rows.union(spark.createDataFrame([(900, 1, None), (920, 1, [None, 1.0])], rows.schema))
    want = evaluate.calibration(rows, F.col("qid") % 20 == 0).first()
    monkeypatch.setattr(search, "MAX_QUERIES", 4)
    assert evaluate.calibration(rows, F.col("qid") % 20 == 0).first() == want
    assert evaluate.calibration(rows, F.lit(False)).first().mean_similar is None


def test_aggregates_by_day_merge(spark):
    rows = views.memories(spark, DATA, False).withColumn("text", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("text")))
    whole = audit.counts_of_days(audit.daily(rows), views.as_of()).first()
    parts = [audit.daily(rows.where(F.col("doc_id") % 3 == i)) for i in range(3)]
    assert audit.counts_of_days(audit.brought_up(audit.brought_up(parts[0], parts[1]), parts[2]), views.as_of()).first() == whole
    assert audit.counts_of_days(audit.daily(rows.where("false")), views.as_of()).first().total == 0


def test_state_at_messages(spark):
    states = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5, 50), (1, "2024-01-01 10:00:00", 4, 40), (1, "2024-01-03 00:00:00", 6, 60), (2, "2024-01-02 00:00:00", 7, 70)], "user_id int, ts string, event_id long, xp int")
    said = spark.createDataFrame([(1, 1, "2024-01-01 09:59:59"), (2, 1, "2024-01-01 10:00:00"), (3, 1, "2024-01-02 23:00:00"), (4, 1, "2024-02-01 00:00:00"), (5, 2, "2024-01-01 00:00:00"), (6, 3, "2024-01-01 00:00:00"), (7, 1, None), (8, None, "2024-01-05 00:00:00")], "id int, user_id int, ts string")
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for bucket in (60, 3600, 10**9):
        got = {r.id: r.state and r.state.xp for r in state.state_at(timed(said), timed(states), bucket).collect()}
        assert got == {1: None, 2: 50, 3: 50, 4: 60, 5: None, 6: None, 7: None, 8: None}


def test_night_lines_keep_unreadable_times(spark):
    rows = [(1, i, "chat", f"text {i}", at) for i, at in enumerate(["2024-01-30T10:00:00Z", "2024-01-29T10:00:00.5", "soon", None, "2023-12-01T00:00:00"])] + [(2, 9, "chat", "alone", "soon"), (1, 10, "md_import", "skipped", "soon")]
    got = state.nightly_lines(spark.createDataFrame(rows, "user_id int, doc_id long, source string, text string, at string"), views.as_of(), ("md_import",)).orderBy("place").collect()
    assert [(r.doc_id, r.line) for r in got] == [(0, "[2024-01-30 10:00] (chat) text 0"), (1, "[2024-01-29 10:00] (chat) text 1"), (2, "[?] (chat) text 2"), (3, "[?] (chat) text 3")]


def test_scan_reads_few_columns(spark):
    plan = REGISTRY["source_distribution"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan


def test_config_is_a_parameter(spark):
    ranked = search.reranked(search.pooled(views.memories(spark, DATA), views.queries(spark, DATA), 5), views.as_of(), RankConfig(milestone=0.0, fresh=0.0))
    assert ranked.agg(F.max("final_score")).first()[0] <= 1.0


def test_labels_by_class_are_their_pairs(spark):
    """Labels that are never expanded measure as their table of pairs does."""
    rng = random.Random(5)
    asked = spark.createDataFrame([(q,) for q in range(6)], "qid long")
    queries = spark.createDataFrame([(q, q % 3) for q in range(5)] + [(5, 9)], "qid long, label long")
    docs = spark.createDataFrame([(i, i % 4) for i in range(40)], "doc_id long, label long")
    chat = docs.where("doc_id % 5 = 0")
    ranked = spark.createDataFrame([(q, i, r + 1) for q in range(6) for r, i in enumerate(rng.sample(range(40), q))], "qid long, doc_id long, rank int")
    pairs = lambda d: queries.join(d, "label").select("qid", "doc_id")
    mine = asked.select("qid", F.col("qid").alias("doc_id"))
    got = evaluate.retrieval_score(ranked, asked, evaluate.ByLabel(queries, docs), mine, evaluate.ByLabel(queries, chat)).first()
    assert got == evaluate.retrieval_score(ranked, asked, pairs(docs), mine, pairs(chat)).first()
    got = evaluate.precision_at(ranked, evaluate.ByLabel(queries, docs))
    assert sorted(got.collect()) == sorted(evaluate.precision_at(ranked, pairs(docs)).collect())
