"""Per-user state folds over ordered messages, and session windows."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEVELS
from ..functions.text import hours_label


def gained_xp(gap_hours: Column) -> Column:
    """XP of one message, at most 3; ``gap_hours`` is null for a first one."""
    points = (F.col("words") > 3).cast("int") + (F.col("words") > 20).cast("int") + (F.col("entities") >= 2).cast("int")
    return F.least(F.lit(3), points + F.coalesce((gap_hours > 6).cast("int"), F.lit(0)))


def gap_hours(before: Column, ts: Column) -> Column:
    """Hours between two times, each cut to its second first: what is counted are
    the seconds of the clock, not the whole ones of the time between."""
    second = lambda x: F.unix_seconds(x.cast("timestamp"))
    return (second(ts) - second(before)) / 3600


def level(xp: Column) -> Column:
    out = F.lit(LEVELS[0][0])
    for number, least in LEVELS:
        out = F.when(xp >= least, number).otherwise(out)
    return out


#: Seconds of a bucket of the running state: a user's events are taken by the bucket.
BUCKET = 3600
#: The bucket of events without a time, which come first.
_NO_TIME = -(2**62)


def _met(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what is carried to their bucket; a null user is one too."""
    own = carried.withColumnsRenamed({k: f"__own_{k}" for k in keys})
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__own_{k}")) for k in keys))
    return rows.join(own, same).drop(*(f"__own_{k}" for k in keys))


def progressed(events: DataFrame, before: DataFrame | None = None, lasts: tuple[str, ...] = ("mood", "topic"), bonus: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """Each event with its XP (``gained``), the user's running XP, level and number
    of messages, and the last value so far of each column of ``lasts``, by (ts,
    event_id). ``bonus`` is further XP of an event, beyond the cap.

    A prefix scan in two steps, as one user may have a third of all events: within
    buckets of a user's time, and over the buckets, whose sums, last values and
    boundary gap are carried to the next ones. ``before`` has states (user_id, xp,
    messages, last_ts and ``lasts``) from which users go on. Users without a row
    there begin anew; null times come first and have no gap."""
    user, own = ["user_id", "__b"], Window.partitionBy("user_id", "__b").orderBy("ts", "event_id")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__b", F.coalesce(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket), F.lit(_NO_TIME)))
    rows = rows.withColumns({"__n": F.row_number().over(own), "__gap": gap_hours(F.lag("ts").over(own), F.col("ts"))})
    more = F.coalesce(bonus.cast("long"), F.lit(0)) if bonus is not None else F.lit(0).cast("long")
    rows = rows.withColumns({"gained": gained_xp(F.col("__gap")), "__more": more})
    # Of each bucket: its first event, whose gap is not known yet, and what the others and the bonus add.
    place = lambda x: F.when(F.col(x).isNotNull(), F.struct("ts", "event_id"))
    blocks = rows.groupBy(*user).agg(
        F.min_by(F.struct("ts", "words", "entities"), "__n").alias("f"), F.sum(F.when(F.col("__n") > 1, F.col("gained")).otherwise(0) + F.col("__more")).alias("rest"),
        F.count("*").alias("c"), F.max("ts").alias("__end"), *(F.max_by(x, place(x)).alias(f"__last_{x}") for x in lasts),
    )
    along = Window.partitionBy("user_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    if before is not None:
        kept = before.select("user_id", F.col("xp").alias("__xp0"), F.col("messages").alias("__m0"), F.col("last_ts").alias("__t0"), *(F.col(x).alias(f"__was_{x}") for x in lasts))
        blocks = blocks.join(kept, "user_id", "left")
    was = lambda x, kind: F.col(x) if before is not None else F.lit(None).cast(kind)
    ended = F.coalesce(F.max("__end").over(along), was("__t0", "timestamp_ntz").cast(dict(events.dtypes)["ts"]))
    blocks = blocks.select("*", ended.alias("__ended"), F.col("f.ts").alias("ts"), F.col("f.words").alias("words"), F.col("f.entities").alias("entities"))
    blocks = blocks.withColumn("first", gained_xp(gap_hours(F.col("__ended"), F.col("ts"))))
    carried = blocks.select(
        *user, F.col("first").alias("__first"),
        (F.coalesce(F.sum(F.col("first") + F.col("rest")).over(along), F.lit(0)) + F.coalesce(was("__xp0", "long"), F.lit(0))).alias("__xp"),
        (F.coalesce(F.sum("c").over(along), F.lit(0)) + F.coalesce(was("__m0", "long"), F.lit(0))).alias("__m"),
        *(F.coalesce(F.last(f"__last_{x}", True).over(along), was(f"__was_{x}", "string")).alias(f"__then_{x}") for x in lasts),
    )
    rows = _met(rows, carried, user)
    gained = F.when(F.col("__n") == 1, F.col("__first")).otherwise(F.col("gained"))
    rows = rows.withColumn("gained", gained)
    rows = rows.withColumns(
        {"xp": F.col("__xp") + F.sum(F.col("gained") + F.col("__more")).over(so_far), "messages": F.col("__m") + F.col("__n")}
        | {x: F.coalesce(F.last(x, True).over(so_far), F.col(f"__then_{x}")) for x in lasts}
    )
    return rows.withColumn("level", level(F.col("xp"))).drop("__b", "__n", "__gap", "__more", "__first", "__xp", "__m", *(f"__then_{x}" for x in lasts))


def with_concern(kept: list[str], added: str | None, removed: str | None, most: int = 5) -> list[str]:
    """One change of a list of concerns: appended if absent, the last ``most``
    kept, then a removal."""
    if added is not None and added not in kept:
        kept = [*kept, added]
    kept = kept[-most:]
    return [c for c in kept if c != removed] if removed is not None else kept


def folded_concerns(updates: DataFrame, before: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(user_id, concerns) after the changes (user_id, seq, added, removed) in the
    order of ``seq``, from the concerns in ``before`` or none. Changes stream
    past sorted, and a task keeps one user's few concerns, not the changes."""
    kind = dict(updates.dtypes)["user_id"]
    names = ["user_id", "seq", "added", "removed", "had"]
    rows = updates.select("user_id", "seq", "added", "removed", F.lit(None).cast("array<string>").alias("had"))
    if before is not None:
        null = lambda c: F.lit(None).cast(dict(updates.dtypes)[c]).alias(c)
        rows = before.select("user_id", null("seq"), null("added"), null("removed"), F.col("concerns").alias("had")).union(rows)
    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("seq").asc_nulls_first()).select(*(n for n in names if n != "seq"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, some = None, [], False
        users, lists = [], []
        for batch in batches:
            for user, added, removed, had in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if some and user != at:
                    users.append(at)
                    lists.append(kept)
                if not some or user != at:
                    at, kept, some = user, [], True
                kept = list(had) if had is not None else with_concern(kept, added, removed, most)
            if len(users) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(users, batch.schema.field(0).type), pa.array(lists, pa.list_(pa.string()))], ["user_id", "concerns"])
                users, lists = [], []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([*users, at], batch.schema.field(0).type), pa.array([*lists, kept], pa.list_(pa.string()))], ["user_id", "concerns"])

    return dealt.mapInArrow(fold, f"user_id {kind}, concerns array<string>")


def last_messages(session: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation; ``place`` counts in time."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("ts"), F.desc("seq"))
    kept = session.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("ts", "seq")))


def recent_window(session: DataFrame, as_of: Column, hours: int = 48, n: int = 6) -> DataFrame:
    """A user's last ``n`` own messages of the last ``hours``, over conversations."""
    own = session.where((F.col("role") == "user") & (F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours))))
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("seq"), F.desc("conv_id"))
    return own.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def state_at(messages: DataFrame, states: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``messages`` (user_id, ts, ...) with ``state``, the last row of ``states``
    (user_id, ts, event_id, ...) of their user at or before their time, as a
    struct; null before the first, and for a null time.

    An as-of join without a join of pairs: both are put together, and each
    message takes the last state before it, within a bucket of the user's time
    and from the buckets before, so a hot user is many tasks."""
    last = F.struct(*(c for c in states.columns if c != "user_id"))
    when = lambda df: F.coalesce(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket), F.lit(_NO_TIME))
    old = states.where("ts is not null").select("user_id", "ts", when(states).alias("__b"), F.lit(0).alias("__kind"), "event_id", last.alias("__s"), F.lit(None).alias("__m"))
    new = messages.select("user_id", "ts", when(messages).alias("__b"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("event_id"), F.lit(None).alias("__s"), F.struct("*").alias("__m"))
    both, user = old.union(new), ["user_id", "__b"]
    inside = Window.partitionBy(*user).orderBy("ts", "__kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("user_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = old.groupBy(*user).agg(F.max_by("__s", F.struct("ts", "event_id")).alias("__end"))
    # A bucket of messages alone takes what the ones before left, so it needs a row too.
    every = ends.unionByName(new.select(*user).distinct(), allowMissingColumns=True).groupBy(*user).agg(F.first("__end", True).alias("__end"))
    carried = every.select(*user, F.last("__end", True).over(along).alias("__before"))
    rows = both.withColumn("__own", F.last("__s", True).over(inside)).where("__kind = 1")
    rows = _met(rows, carried, user)
    state = F.when(F.col("ts").isNotNull(), F.coalesce("__own", "__before"))
    return rows.select("__m.*", state.alias("state"))


def nightly_lines(memories: DataFrame, as_of: Column, skipped: tuple[str, ...], days: int = 7, least: int = 3, most: int = 50) -> DataFrame:
    """(user_id, doc_id, place, line): what a night's analysis reads of each user,
    newest first, from memories (user_id, doc_id, source, text, at) of the last
    ``days``; ``at`` is a time as text. A time that can't be read counts as new
    and is shown as [?], after the others. Users of fewer than ``least`` have none."""
    ts = F.try_to_timestamp(F.replace("at", F.lit("Z"), F.lit(""))).cast("timestamp_ntz")
    rows = memories.withColumn("__ts", ts).where(~F.col("source").isin(*skipped) & (F.col("__ts").isNull() | (F.col("__ts") >= as_of - F.make_dt_interval(days=F.lit(days)))))
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("__ts"), "doc_id")
    enough = rows.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(enough, "user_id", "left_semi")
    shown = F.coalesce(F.date_format("__ts", "yyyy-MM-dd HH:mm"), F.lit("?"))
    return rows.select("user_id", "doc_id", "place", F.concat(F.lit("["), shown, F.lit("] ("), F.col("source"), F.lit(") "), F.left("text", F.lit(200))).alias("line"))


def since_label(ts: Column, as_of: Column) -> Column:
    """How long ago a user was last seen, as a line of the state block."""
    hours = gap_hours(ts, as_of)
    line = lambda n, unit: F.concat(F.lit("Ostatnia rozmowa: "), F.floor(n).cast("string"), F.lit(f" {unit} temu"))
    return F.when(ts.isNull(), "").when(hours > 48, line(hours / 24, "dni")).when(hours > 1, line(hours, "godzin")).otherwise("Ostatnia rozmowa: w tej sesji")


def state_block(states: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, block): each state (in the columns of ``STATE``) as the lines that a
    prompt shows: level, XP, mood, topic, messages, when the user was last seen,
    and concerns, one a line."""
    none = F.lit("(brak)")
    since = since_label(F.col("last_ts"), as_of)
    concerns = F.when(F.size("concerns") > 0, F.array_join(F.transform("concerns", lambda c: F.concat(F.lit("  - "), c)), "\n")).otherwise(F.concat(F.lit("  "), none))
    lines = [
        F.concat(F.lit("Level: "), F.col("level").cast("string")), F.concat(F.lit("XP: "), F.col("xp").cast("string")), F.concat(F.lit("Mood: "), F.coalesce("mood", none)),
        F.concat(F.lit("Temat: "), F.coalesce("topic", none)), F.concat(F.lit("Wiadomości: "), F.col("messages").cast("string")), F.when(since != "", since), F.lit("Aktywne sprawy:"), concerns,
    ]
    return states.select("user_id", F.concat_ws("\n", F.lit("[STAN]"), *lines, F.lit("[/STAN]")).alias("block"))


def recent_block(window: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, block): the messages of :func:`recent_window`, oldest first, a line
    each with how long ago they were said; a few a user, as the window has."""
    line = F.concat(F.lit("• "), hours_label(F.col("ts"), as_of), F.left("content", F.lit(200)))
    rows = window.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), line.alias("line")))).alias("l"))
    return rows.select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def insight_window(memories: DataFrame, as_of: Column, hours: int = 16, n: int = 3) -> DataFrame:
    """A user's newest ``n`` night insights of the last ``hours``; without a time none."""
    own = memories.where((F.col("source") == "night_insight") & (F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours))))
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "doc_id")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def parsed_insights(rows: DataFrame, column: str, sure: float = 0.6, shortest: int = 10) -> DataFrame:
    """The other columns of ``rows``, text, confidence and importance: a row for each
    sure and long enough insight of a JSON array; broken JSON gives none."""
    found = rows.select(*(c for c in rows.columns if c != column), F.inline(F.from_json(column, "array<struct<text:string,confidence:double,priority:string>>")))
    importance = F.when(F.col("priority") == "high", 6).when(F.col("priority") == "medium", 5).otherwise(4)
    return found.where((F.col("confidence") >= sure) & (F.length("text") >= shortest)).withColumn("importance", importance).drop("priority")


#: The companion's state as it is kept; keys that are not here are ignored.
STATE = "user_id long, xp long, level int, messages long, mood string, mood_since timestamp_ntz, vibe string, topic string, last_ts timestamp_ntz, concerns array<string>"


def _said(x: str) -> Column:
    """A value of a reply; "null" counts as null."""
    return F.when(F.col(x) != "null", F.col(x))


def messages_with_state(messages: DataFrame) -> DataFrame:
    """``messages`` with what each sets: ``vibe`` by an emotion, ``topic`` as the
    reply names it or else its first entity gives (facts, goals, dates and
    milestones do), ``mood`` and ``mood_since``, and ``bonus`` XP where the
    reply's xp_delta is greater than 0. Needs entity_type, entity_subtype,
    reply_topic, mood and xp_delta."""
    named = F.when(F.col("entity_type").isin("FACT", "GOAL", "DATE", "MILESTONE"), F.concat_ws(":", "entity_type", "entity_subtype"))
    return messages.withColumns({
        "vibe": F.when(F.col("entity_type") == "EMOTION", F.col("entity_subtype")), "topic": F.coalesce(_said("reply_topic"), named), "mood": _said("mood"),
        "mood_since": F.when(_said("mood").isNotNull(), F.col("ts")), "bonus": F.when(F.col("xp_delta") > 0, F.floor("xp_delta").cast("long")),
    })


KEPT = ("mood", "mood_since", "vibe", "topic")


def updated(messages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Each of ``messages`` (see :func:`messages_with_state`; and user_id, event_id,
    ts, words, entities) with the user's whole state after it but for concerns:
    gained, xp, level, messages, mood, mood_since, vibe, topic."""
    return progressed(messages_with_state(messages), before, KEPT, F.col("bonus"))


def final_states(messages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The state of each user after all ``messages``, in the columns of ``STATE``.
    Concerns go by the few messages that add or remove one."""
    last = F.max_by(F.struct("xp", "level", "messages", *KEPT), F.struct("ts", "event_id"))
    rows = updated(messages, before).groupBy("user_id").agg(last.alias("s"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))
    changes = messages.where(F.coalesce(_said("added"), _said("removed")).isNotNull())
    listed = changes.select("user_id", F.struct("ts", "event_id").alias("seq"), _said("added").alias("added"), _said("removed").alias("removed"))
    rows = rows.select("user_id", "s.*", "last_ts").join(folded_concerns(listed, before), "user_id", "left")
    return rows.select("user_id", "xp", "level", "messages", "mood", F.col("mood_since").cast("timestamp_ntz").alias("mood_since"), "vibe", "topic", "last_ts", F.coalesce("concerns", F.array().cast("array<string>")).alias("concerns"))


def saved(states: DataFrame) -> DataFrame:
    """(value): each state as one JSON line, ready for ``write.text``."""
    return states.select(F.to_json(F.struct("*")).alias("value"))


def loaded(lines: DataFrame) -> DataFrame:
    """States of JSON lines (value): unknown keys are ignored, missing ones get
    a new state's values, and a broken line is left out."""
    rows = lines.select(F.from_json("value", STATE).alias("s")).where("s.user_id is not null").select("s.*")
    filled = {"xp": F.lit(0), "level": F.lit(1), "messages": F.lit(0), "concerns": F.array().cast("array<string>")}
    names = [f.split()[0] for f in STATE.split(", ")]
    return rows.select(*(F.coalesce(n, filled[n]).alias(n) if n in filled else F.col(n) for n in names))


def reset(states: DataFrame) -> DataFrame:
    """New states of the same users."""
    return loaded(states.select(F.to_json(F.struct("user_id")).alias("value")))


def read_once(states: DataFrame) -> DataFrame:
    """``states`` (message, shown) with ``message`` only where it was not shown
    yet, and ``shown`` set where there is one now."""
    due = F.col("message").isNotNull() & ~F.coalesce("shown", F.lit(False))
    return states.withColumns({"shown": F.coalesce("shown", F.lit(False)) | due, "message": F.when(due, F.col("message"))})
