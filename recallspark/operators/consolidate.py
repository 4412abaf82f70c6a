"""Merge, supersede and latest-wins over stored memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATEST_WINS, SUPERSEDES
from ..sources.scratch import written


def topic() -> F.Column:
    out = F.lit(None).cast("string")
    for subtype, name in SUPERSEDES.items():
        out = F.when(F.col("entity_subtype") == subtype, name).otherwise(out)
    return out


def latest_wins(memories: DataFrame) -> DataFrame:
    """Of the listed (type, subtype) pairs only a user's newest memory; all others."""
    pair = F.concat_ws(":", "entity_type", "entity_subtype")
    last = Window.partitionBy("user_id", "persona_id", "entity_type", "entity_subtype").orderBy(F.desc("ts"), F.desc("doc_id"))
    listed = F.coalesce(pair.isin([f"{a}:{b}" for a, b in LATEST_WINS]), F.lit(False))
    kept = memories.where(listed).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return kept.unionByName(memories.where(~listed))


def decided(new: DataFrame, near: DataFrame, merge_from: float = 0.85, archive_from: float = 0.70) -> DataFrame:
    """(doc_id, action, target_id, archived) of each new memory (doc_id,
    entity_subtype). ``near`` has the stored ones looked up for it (doc_id,
    other_id, other_subtype, similarity, rank), a bounded number each. One with
    a topic supersedes: those of its topic from ``archive_from`` on are to be
    archived. Else it merges with the first in rank that is similar enough, or
    is created."""
    own = topic()
    theirs = F.lit(None).cast("string")
    for subtype, name in SUPERSEDES.items():
        theirs = F.when(F.col("other_subtype") == subtype, name).otherwise(theirs)
    rows = new.select("doc_id", own.alias("topic")).join(near.withColumn("other_topic", theirs), "doc_id", "left")
    old = F.when((F.col("topic") == F.col("other_topic")) & (F.col("similarity") >= archive_from), F.col("other_id"))
    first = F.min(F.when(F.col("similarity") >= merge_from, F.struct("rank", "other_id")))["other_id"]
    out = rows.groupBy("doc_id", "topic").agg(F.array_sort(F.collect_set(old)).alias("archived"), first.alias("first"))
    what = F.when(F.col("topic").isNotNull(), "supersede").when(F.col("first").isNotNull(), "merge").otherwise("create")
    target = F.when(F.col("topic").isNull(), F.col("first"))
    return out.select("doc_id", what.alias("action"), target.alias("target_id"), "archived")


def roots(targets: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(doc_id, root_id) for each of ``targets`` (doc_id, target_id): where its
    chain of merges ends. Each round doubles the step (pointer jumping), so the
    rounds grow with the logarithm of the longest chain. Chains must not be
    circles, as they are not where targets are older."""
    at = targets.select("doc_id", F.col("target_id").alias("root_id"))
    for _ in range(max_rounds):
        further = at.select(F.col("doc_id").alias("root_id"), F.col("root_id").alias("next"))
        if at.join(further, "root_id", "left_semi").isEmpty():
            return at
        at = written(at.join(further, "root_id", "left").select("doc_id", F.coalesce("next", "root_id").alias("root_id")))
    raise ValueError("merge targets form a circle")


def carried_out(stored: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """The table after the decisions of :func:`decided` on ``new``: the columns of
    ``stored`` (doc_id, importance, ts, ...; both tables have them) and mentions,
    last_mentioned, is_active and note.

    A merged memory is not stored: its root, stored or new, gets the greatest
    importance, one more mention and the last time. Memories that a superseding
    one archives are inactive, with the reason as a JSON note. Created and
    superseding memories are stored. Sums are made in each task first, so a root
    with very many mentions is no hot key."""
    decisions = written(decisions)
    ends = roots(decisions.where("action = 'merge'").select("doc_id", "target_id"))
    kept = new.join(decisions.where("action <> 'merge'").select("doc_id"), "doc_id", "left_semi")
    folded = new.select("doc_id", "importance", "ts").join(ends, "doc_id").groupBy("root_id").agg(F.max("importance").alias("__most"), F.count("*").alias("__more"), F.max("ts").alias("__last"))
    gone = decisions.select(F.explode("archived").alias("doc_id"), F.col("doc_id").alias("__by")).groupBy("doc_id").agg(F.min("__by").alias("__by"))
    rows = stored.unionByName(kept).join(folded.withColumnRenamed("root_id", "doc_id"), "doc_id", "left").join(gone, "doc_id", "left")
    note = F.to_json(F.struct(F.lit("superseded").alias("archived_because"), F.col("__by").alias("by")))
    rows = rows.withColumns({
        "importance": F.greatest("importance", "__most"), "mentions": (F.coalesce("__more", F.lit(0)) + 1).cast("long"), "last_mentioned": F.greatest("ts", "__last"),
        "is_active": F.col("__by").isNull(), "note": F.when(F.col("__by").isNotNull(), note),
    })
    return rows.drop("__most", "__more", "__last", "__by")


def mention_notes(new: DataFrame, decisions: DataFrame, size: int = 100) -> DataFrame:
    """(root_id, ts, doc_id, note): the first ``size`` characters of each merged
    text, a row each, as one memory may have any number; in the order of (ts,
    doc_id) they are its list."""
    ends = roots(decisions.where("action = 'merge'").select("doc_id", "target_id"))
    return new.join(ends, "doc_id").select("root_id", "ts", "doc_id", F.left("text", F.lit(size)).alias("note"))


def merged(memories: DataFrame, key: list[str]) -> DataFrame:
    """One row a cluster: greatest importance, number of mentions, last mention,
    and the first 100 characters of each text in order of time."""
    note = F.struct("ts", "doc_id", F.left("text", F.lit(100)).alias("t"))
    folded = memories.groupBy(*key).agg(
        F.min("doc_id").alias("first_id"), F.max("importance").alias("importance"), F.count("*").alias("mentions"), F.max("ts").alias("last_mentioned"), F.array_sort(F.collect_list(note)).alias("n")
    )
    return folded.withColumn("notes", F.array_join(F.transform("n", lambda x: x["t"]), " | ")).drop("n")


def stats(memories: DataFrame) -> DataFrame:
    """Total, active and archived memories."""
    return memories.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("archived"))


def archived(memories: DataFrame, targets: DataFrame, reason: str) -> DataFrame:
    """``memories`` with those of ``targets`` (doc_id) inactive and the reason noted."""
    marked = targets.select("doc_id", F.lit(True).alias("__hit")).distinct()
    rows = memories.join(marked, "doc_id", "left").withColumn("is_active", F.col("__hit").isNull())
    return rows.withColumn("note", F.when(F.col("__hit"), F.to_json(F.struct(F.lit(reason).alias("archived_because"))))).drop("__hit")


def inserted_if_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` and those of ``new`` whose key it lacks, one row a key."""
    return stored.unionByName(new.dropDuplicates([key]).join(stored.select(key), key, "left_anti"))
