"""The state machine: batch in blocks, in micro-batches, and as a stateful stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from recallspark.config import LEVELS
from recallspark.operators import state
from recallspark.plans.queries import REGISTRY
from recallspark.sources import scratch
from recallspark.streaming import machine
from recallspark.streaming import state as streams

KINDS = "user_id long, event_id long, ts timestamp_ntz, words double, entities long, mood string, reply_topic string, entity_type string, entity_subtype string, added string, removed string, xp_delta double, greeting string"


def made(seed, n, users=4):
    """Messages in the order of time; a third is one user's. Ties, gaps and nulls."""
    rng, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 40, 3000, 30_000]))
        pick = lambda *xs: rng.choice([None, *xs])  # noqa: B023, E731
        out.append((
            0 if rng.random() < 0.34 else rng.randrange(users), i, at, float(rng.randrange(30)), rng.randrange(4), pick("calm", "null", "glad"), pick("garden", "null"), pick("EMOTION", "FACT", "PERSON"), rng.choice("abc"),
            pick(*"pqrstuvw"), pick(None, None, *"pqrs"), pick(0.0, -1.0, 2.7), pick("hello", "morning"),
        ))
    return out


def brute(rows):
    """(user, event) to the state after it, by a plain loop."""
    names = [k.split()[0] for k in KINDS.split(", ")]
    kept, out = {}, {}
    for r in sorted((dict(zip(names, x, strict=True)) for x in rows), key=lambda r: (r["ts"], r["event_id"])):
        s = kept.setdefault(r["user_id"], {"xp": 0, "messages": 0, "mood": None, "mood_since": None, "vibe": None, "topic": None, "concerns": [], "last": None, "greeting": None, "times": []})
        gap = s["last"] is not None and int(r["ts"].timestamp()) - int(s["last"].timestamp()) > 6 * 3600
        gained = min(3, (r["words"] > 3) + (r["words"] > 20) + (r["entities"] >= 2) + gap)
        s["xp"] += gained + (int(r["xp_delta"]) if r["xp_delta"] and r["xp_delta"] > 0 else 0)
        s["messages"] += 1
        if r["entity_type"] == "EMOTION":
            s["vibe"] = r["entity_subtype"]
        if r["entity_type"] == "FACT":
            s["topic"] = f"FACT:{r['entity_subtype']}"
        if r["reply_topic"] not in (None, "null"):
            s["topic"] = r["reply_topic"]
        if r["mood"] not in (None, "null"):
            s["mood"], s["mood_since"] = r["mood"], r["ts"]
        if r["added"] and r["added"] not in s["concerns"]:
            s["concerns"] = s["concerns"] + [r["added"]]
        s["concerns"] = [c for c in s["concerns"][-5:] if c != r["removed"]]
        s["times"].append(r["ts"])
        shown, s["greeting"], s["last"] = s["greeting"], r["greeting"], r["ts"]
        recent = sum(t > r["ts"] - dt.timedelta(hours=48) for t in s["times"])
        level = max(n for n, least in LEVELS if s["xp"] >= least)
        out[r["user_id"], r["event_id"]] = s | {"gained": gained, "level": level, "shown": shown, "recent": recent, "concerns": list(s["concerns"])}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def streamed(spark, parts, tmp_path):
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("bucket", [1, 3600, 10**9])
def test_blocked_scan_is_a_plain_loop(spark, bucket):
    rows = made(1, 600)
    want = brute(rows)
    got = state.progressed(state.messages_with_state(frame(spark, rows)), None, state.KEPT, F.col("bonus"), bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        s = want[r.user_id, r.event_id]
        assert (r.gained, r.xp, r.level, r.messages, r.mood, r.mood_since, r.vibe, r.topic) == tuple(s[k] for k in ("gained", "xp", "level", "messages", "mood", "mood_since", "vibe", "topic"))


def test_a_hot_user_is_spread(spark):
    """No task sorts or sums all events of a user that has them all."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(20_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.lit(5.0).alias("words"), F.lit(0).alias("entities"), F.lit(None).cast("string").alias("mood"), F.lit(None).cast("string").alias("topic"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = state.progressed(rows)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 0.5 * 20_000
        assert out.agg(F.max("xp"), F.max("messages")).first()[:] == (20_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_final_states_and_going_on_from_them(spark):
    rows = made(2, 500)
    want = {}
    for (user, _), s in sorted(brute(rows).items(), key=lambda x: (x[1]["messages"])):
        want[user] = s
    half = state.final_states(frame(spark, rows[:250]))
    both = [state.final_states(frame(spark, rows)), state.final_states(frame(spark, rows[250:]), scratch.written(half))]
    for found in both:
        for r in found.collect():
            s = want[r.user_id]
            assert (r.xp, r.level, r.messages, r.mood, r.mood_since, r.vibe, r.topic, r.concerns) == tuple(s[k] for k in ("xp", "level", "messages", "mood", "mood_since", "vibe", "topic", "concerns"))
    saved = state.loaded(state.saved(both[0]))
    assert sorted(map(tuple, saved.collect()), key=repr) == sorted(map(tuple, both[0].collect()), key=repr)


def test_micro_batches_are_the_batch(spark, tmp_path):
    rows = made(3, 400)
    stream = streamed(spark, [rows[:100], rows[100:150], rows[150:]], tmp_path)
    got = {(r.user_id, r.event_id): (r.xp, r.level) for r in streams.run_progress(stream).collect()}
    assert got == {k: (s["xp"] - bonus(rows, k), level_of(s["xp"] - bonus(rows, k))) for k, s in brute(rows).items()}


def bonus(rows, key):
    """What xp_delta gave the user so far; the plain stream has none."""
    own = sorted((r for r in rows if r[0] == key[0]), key=lambda r: (r[2], r[1]))
    upto = next(i for i, r in enumerate(own) if r[1] == key[1])
    return sum(int(r[11]) for r in own[: upto + 1] if r[11] and r[11] > 0)


def level_of(xp):
    return max(n for n, least in LEVELS if xp >= least)


def check_stream(found, want):
    for r in found:
        s = want[r.user_id, r.event_id]
        assert (r.gained, r.xp, r.level, r.messages, r.mood, r.vibe, r.topic, r.concerns, r.recent, r.greeting) == (
            s["gained"], s["xp"], s["level"], s["messages"], s["mood"], s["vibe"], s["topic"], ",".join(s["concerns"]), s["recent"], s["shown"],
        )


def test_stateful_stream_over_micro_batches(spark, tmp_path):
    rows = made(4, 300)
    stream = streamed(spark, [rows[:80], rows[80:90], rows[90:]], tmp_path)
    with machine.with_rocksdb(spark):
        found = streams.run_to_table(machine.companion_stream(stream, late="90 days")).collect()
    assert len(found) == len(rows)
    check_stream(found, brute(rows))
    assert spark.conf.get(machine.PROVIDER[0], None) != machine.PROVIDER[1]


def test_stateful_stream_from_a_batch_table(spark, tmp_path):
    rows = made(5, 200)
    before = scratch.written(state.final_states(frame(spark, rows[:120])))
    stream = streamed(spark, [rows[120:]], tmp_path)
    with machine.with_rocksdb(spark):
        found = streams.run_to_table(machine.companion_stream(stream, before)).collect()
    want = brute(rows)
    assert len(found) == 80
    for r in found:
        s = want[r.user_id, r.event_id]
        assert (r.xp, r.level, r.messages, r.mood, r.vibe, r.topic, r.concerns) == (s["xp"], s["level"], s["messages"], s["mood"], s["vibe"], s["topic"], ",".join(s["concerns"]))


def test_null_times_and_empty_tables(spark):
    rows = [(1, 1, None, 5.0, 0, *[None] * 8), (1, 2, dt.datetime(2024, 1, 1), 5.0, 0, *[None] * 8), (1, 3, dt.datetime(2024, 1, 2), 30.0, 3, *[None] * 8), (None, 4, None, 1.0, 0, *[None] * 8)]
    got = {r.event_id: (r.gained, r.xp) for r in state.updated(frame(spark, rows)).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 2) and got[3] == (3, 5) and got[4] == (0, 0)
    assert state.final_states(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [3600, 10**9])
def test_gaps_count_seconds_of_the_clock(spark, bucket):
    """00:00:00.9 and 06:00:01.1 are 6 h and a second apart by the clock, as the stream
    and the SQL count; 00:00:00.1 and 06:00:00.9 are 6 h."""
    at = lambda h, s, m: dt.datetime(2024, 1, 1, h, 0, s, m)
    rows = [(1, 1, at(0, 0, 900_000)), (1, 2, at(6, 1, 100_000)), (2, 3, at(0, 0, 100_000)), (2, 4, at(6, 0, 900_000))]
    events = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "user_id long, event_id long, ts timestamp_ntz, words double, entities long")
    got = {r.event_id: r.xp for r in state.progressed(events, None, (), bucket=bucket).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    seen = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0, 900_000),)], "ts timestamp_ntz")
    assert seen.select(state.since_label(F.col("ts"), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))).first()[0] == "Ostatnia rozmowa: 2 godzin temu"


def test_insight_window_has_rows(spark):
    """The query's window is wide enough for the tables' insights."""
    assert REGISTRY["insight_window"](spark, "/root/testdata/sf0.01").count() > 0


def test_states_are_moved_once_a_micro_batch():
    """A user's thousand messages cost the stream no more calls of its state store
    than one does, and the messages are counted as recent to the millisecond."""
    calls = []

    class Kept:
        value = None

        def get(self):
            calls.append("get")
            return self.value if self.value is not None else getattr(self, "none", None)

        def put(self, value):
            calls.append("put")
            self.value = value

        update = put

        def clear(self):
            self.put(None)

    class Handle:
        def getValueState(self, name, schema):
            return Kept()

        def getListState(self, name, schema):
            kept = Kept()
            kept.none = []
            return kept

        getMapState = getListState

        def registerTimer(self, at):
            calls.append(at)

    fields = ("user_id", "event_id", "ts", "second", "milli", "micro", "points", "mood", "mood_since", "vibe", "topic", "added", "removed", "bonus", "greeting")
    at = [1_704_067_211_029_000 + i * 480_000_000 for i in range(1000)]
    rows = [Row(**dict(zip(fields, (1, i, None, t // 10**6, t // 1000, t, 1, None, None, None, None, "c", None, 0, None), strict=True))) for i, t in enumerate(at)]
    companion = machine.Companion(48)
    companion.init(Handle())
    out = list(companion.handleInputRows((1,), iter(rows[::-1]), None))
    assert len(calls) < 10 and calls[-1] == at[-1] // 1000 + 48 * 3_600_000
    assert [r.recent for r in out] == [min(i + 1, 360) for i in range(1000)]
    assert len(companion.recent.value) == 360 and out[-1].xp == 1000
