"""The companion's state machine as a stateful stream operator.

One processor folds a user's messages: XP, level, mood, topic and counters in a
value state, concerns in a list state, the times of the messages of the last hours
in another that an event-time timer empties, and a greeting that is shown once. A
user's states are read and written once a micro-batch, whatever its messages. States of a
batch table can be the start. :mod:`recallspark.operators.state` has the batch
form; both give the same rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import LEVELS
from ..operators.state import gained_xp, messages_with_state, with_concern

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCALARS = "xp long, messages long, mood string, mood_since timestamp, vibe string, topic string, last_second long, greeting string"
OUT = "user_id long, event_id long, gained int, xp long, level int, messages long, mood string, vibe string, topic string, concerns string, recent int, greeting string"
_NAMES = [x.split()[0] for x in SCALARS.split(", ")]
_OUT = Row(*(x.split()[0] for x in OUT.split(", ")))
#: The second and millisecond of a message without a time.
_NO_TIME = -(2**62)


class Companion(StatefulProcessor):
    """States of users, by their messages in the order of (ts, event_id) within a
    micro-batch. ``hours`` is how long a message counts as recent."""

    def __init__(self, hours: int = 48) -> None:
        self.span = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", SCALARS)
        self.concerns = handle.getListState("concerns", "concern string")
        self.recent = handle.getListState("recent", "at long")

    def _keep(self, recent: list[int]) -> None:
        self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        (user,) = key
        kept = self.scalars.get()
        s = dict(zip(_NAMES, kept, strict=True)) if kept is not None else dict.fromkeys(_NAMES)
        xp, messages, last, shown = s["xp"] or 0, s["messages"] or 0, s["last_second"], s["greeting"]
        mood, since, vibe, topic = s["mood"], s["mood_since"], s["vibe"], s["topic"]
        before = [c[0] for c in self.concerns.get()]
        # The times in order, of which those from ``old`` on are recent.
        concerns, recent, old, out = before, sorted(t[0] for t in self.recent.get()), 0, []
        # A micro-batch's rows of a user; the stream's file limit bounds them.
        for m in sorted(rows, key=lambda m: (m.micro, m.event_id)):
            event, _, second, milli, _, points, new_mood, new_since, new_vibe, new_topic, added, removed, bonus, greeting = m[1:]
            timed = second != _NO_TIME
            gained = min(3, points + int(timed and last is not None and second - last > 6 * 3600))
            xp += gained + bonus
            messages += 1
            mood, vibe, topic = mood if new_mood is None else new_mood, vibe if new_vibe is None else new_vibe, topic if new_topic is None else new_topic
            since = since if new_since is None else new_since
            if added is not None or removed is not None:
                concerns = with_concern(concerns, added, removed)
            old = bisect_right(recent, milli - self.span, old)
            insort(recent, milli, old)
            last = second if timed else last
            level = max(n for n, least in LEVELS if xp >= least)
            out.append(_OUT(user, event, gained, xp, level, messages, mood, vibe, topic, ",".join(concerns), len(recent) - old, shown))
            shown = greeting
        self.scalars.update((xp, messages, mood, since, vibe, topic, last, shown))
        if concerns != before:
            self.concerns.put([(c,) for c in concerns]) if concerns else self.concerns.clear()
        self._keep(recent[old:])
        # The others are dropped by then or with the next messages.
        if recent[-1] != _NO_TIME:
            self.handle.registerTimer(recent[-1] + self.span)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._keep([t[0] for t in self.recent.get() if t[0] > now - self.span])
        yield from ()

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.scalars.update(tuple(initialState[n] for n in _NAMES))
        if initialState["concerns"]:
            self.concerns.put([(c,) for c in initialState["concerns"]])

    def close(self) -> None:
        pass


def companion_stream(messages: DataFrame, before: DataFrame | None = None, hours: int = 48, late: str = "48 hours") -> DataFrame:
    """A stream of messages (see ``operators.state.messages_with_state``; and
    greeting) as the state after each. ``before`` has states of
    ``operators.state.final_states``, from which users go on; what comes later
    than ``late`` is dropped. The state stands in RocksDB: run it by
    :func:`with_rocksdb`."""
    rows = messages_with_state(messages).withColumn("ts", F.col("ts").cast("timestamp"))
    timed = lambda f: F.coalesce(f("ts"), F.lit(_NO_TIME))
    rows = rows.select(
        "user_id", "event_id", "ts", timed(F.unix_seconds).alias("second"), timed(F.unix_millis).alias("milli"), timed(F.unix_micros).alias("micro"), gained_xp(F.lit(None)).alias("points"), "mood",
        F.col("mood_since").cast("timestamp").alias("mood_since"), "vibe", "topic", "added", "removed", F.coalesce("bonus", F.lit(0)).alias("bonus"), "greeting",
    )
    if before is not None:
        before = before.withColumn("last_second", F.unix_seconds(F.col("last_ts").cast("timestamp")))
        columns = {n: F.col(n).cast(k) if n in before.columns else F.lit(None).cast(k) for n, k in (x.split() for x in SCALARS.split(", "))}
        before = before.select("user_id", *(c.alias(n) for n, c in columns.items()), "concerns").groupBy("user_id")
    grouped = rows.withWatermark("ts", late).groupBy("user_id")
    return grouped.transformWithState(statefulProcessor=Companion(hours), outputStructType=OUT, outputMode="Append", timeMode="eventTime", initialState=before)


class with_rocksdb:  # noqa: N801
    """The session's state store is RocksDB within this context."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(PROVIDER[0], None)
        self.spark.conf.set(*PROVIDER)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.unset(PROVIDER[0]) if self.old is None else self.spark.conf.set(PROVIDER[0], self.old)
