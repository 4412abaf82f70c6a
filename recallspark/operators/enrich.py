"""Classification by centroids and enrichment by rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..config import (
    CORRECTION_PHRASES,
    IMPACT,
    IMPORTANCE,
    IMPORTANCE_BOOSTERS,
    MILESTONE_KEYWORD_THRESHOLD,
    MILESTONE_KEYWORDS,
    MILESTONE_LABELS,
    SUPERSEDES,
    TAG_WORDS,
    TEMPORAL,
    TYPE_THRESHOLDS,
)
from ..functions.text import phrases_in, word_count


def centroids(prototypes: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean of the vectors of each class, as (keys, pos, value)."""
    parts = prototypes.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def as_vectors(parts: DataFrame, keys: list[str]) -> DataFrame:
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l"))
    return listed.select(*keys, F.transform("l", lambda x: x["value"]).alias("centroid"))


def cosines(messages: DataFrame, centroids: list[list[float]], least: float | None = None) -> DataFrame:
    """(the other columns of ``messages``, pos, cosine): the cosine of each
    message's embedding and each centroid, one matrix product a batch; with
    ``least`` only from there on. Centroids are a small fixed table. Null
    vectors, vectors of another length, zero ones and those with null or NaN
    components have no rows."""
    points = np.array(centroids, float).reshape(len(centroids), -1)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    whole = (F.size("embedding") == points.shape[1]) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = messages.where(F.coalesce(whole, F.lit(False)))
    others = [f for f in rows.schema.fields if f.name != "embedding"]
    rows = rows.select(*(f.name for f in others), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(others)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
            found = (x @ points.T) / np.linalg.norm(x, axis=1, keepdims=True)
            i, pos = np.nonzero(np.ones(found.shape, bool) if least is None else found >= least)
            kept = [c.take(pa.array(i)) for c in batch.columns[: len(others)]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos.astype(np.int32)), pa.array(found[i, pos])], [*(f.name for f in others), "pos", "cosine"])

    return rows.mapInArrow(run, StructType([*others, StructField("pos", IntegerType()), StructField("cosine", DoubleType())]))


def classified(messages: DataFrame, classes: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, entity_type, entity_subtype, confidence) of all classes that reach
    their threshold. What the text decides is decided once a message."""
    own = classes.orderBy("entity_type", "entity_subtype").collect()
    every = sorted({w for found in MILESTONE_KEYWORDS.values() for w in found} | set(CORRECTION_PHRASES))
    held = messages.where(F.length("text") >= 5).withColumn("held", phrases_in(F.col("text"), every))
    some = lambda found: F.arrays_overlap("held", F.array(*map(F.lit, found)))
    words = [F.when(some(found), F.lit(subtype)) for subtype, found in MILESTONE_KEYWORDS.items()]
    said = held.select("doc_id", some(CORRECTION_PHRASES).alias("vetoed"), F.array_compact(F.array(*words)).alias("said"), "embedding")
    lowest = min(least, MILESTONE_KEYWORD_THRESHOLD, *TYPE_THRESHOLDS.values())
    found = cosines(said, [r["centroid"] for r in own], lowest - 0.001)
    names = F.array(*(F.struct(F.lit(r["entity_type"]).alias("t"), F.lit(r["entity_subtype"]).alias("s")) for r in own))[F.col("pos")]
    found = found.withColumns({"entity_type": names["t"], "entity_subtype": names["s"], "confidence": F.round("cosine", 3)})
    limit, milestone = F.lit(least), F.col("entity_type") == "MILESTONE"
    for kind, value in TYPE_THRESHOLDS.items():
        limit = F.when(F.col("entity_type") == kind, value).otherwise(limit)
    limit = F.when(milestone & F.array_contains("said", F.col("entity_subtype")), MILESTONE_KEYWORD_THRESHOLD).otherwise(limit)
    return found.where((F.col("confidence") >= limit) & ~(milestone & F.col("vetoed"))).select("doc_id", "entity_type", "entity_subtype", "confidence")


def best_class(messages: DataFrame, classes: DataFrame, floor: float, default: str) -> DataFrame:
    """(doc_id, label, score): the class of the greatest score over ``floor``, the
    first in order among equals, else the default."""
    own = classes.orderBy("ordinal").collect()
    scored = cosines(messages.select("doc_id", "embedding"), [r["centroid"] for r in own]).withColumn("score", F.round("cosine", 6))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("o"))).alias("b"))
    name = F.array(*(F.lit(r["name"]) for r in own))[-F.col("b.o")]
    return best.select("doc_id", F.when(F.col("b.score") > floor, name).otherwise(default).alias("label"), F.col("b.score").alias("score"))


def top_per(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` surest entities of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "entity_type", "entity_subtype")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def looked_up(rules: dict, default: str | int) -> Column:
    """The rule of (type, subtype), else the type's, else the default."""
    out = F.lit(default)
    for kind, own in rules.items():
        inner = F.lit(own["_default"])
        for subtype, value in own.items():
            if subtype != "_default":
                inner = F.when(F.col("entity_subtype") == subtype, value).otherwise(inner)
        out = F.when(F.col("entity_type") == kind, inner).otherwise(out)
    return out


def keyword_boost(text: Column) -> Column:
    """The sum of the weights of the words that the text holds, 3 at most."""
    weights = F.create_map(*(F.lit(x) for kv in IMPORTANCE_BOOSTERS.items() for x in kv))
    return F.least(F.lit(3), F.aggregate(phrases_in(text, tuple(IMPORTANCE_BOOSTERS)), F.lit(0), lambda a, w: a + F.element_at(weights, w)))


def tags(text: Column) -> Column:
    """Sorted distinct tags."""
    tag_of = F.create_map(*(F.lit(x) for tag, found in TAG_WORDS.items() for w in found for x in (w, tag)))
    more = F.transform(phrases_in(text, [w for found in TAG_WORDS.values() for w in found]), lambda w: F.element_at(tag_of, w))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.lower("entity_type"), F.col("entity_subtype")), more))))


def enriched(entities: DataFrame) -> DataFrame:
    """Adds importance, impact, temporal type, superseded topic, tags and value."""
    topic = F.lit(None).cast("string")
    for subtype, name in SUPERSEDES.items():
        topic = F.when(F.col("entity_subtype") == subtype, name).otherwise(topic)
    out = entities.withColumns({
        "base_importance": looked_up(IMPORTANCE, 5), "boost": keyword_boost(F.col("text")), "impact": looked_up(IMPACT, "informational"),
        "temporal_type": looked_up(TEMPORAL, "long_term"), "supersedes": topic, "tags": tags(F.col("text")),
    })
    out = out.withColumn("importance", F.least(F.lit(10), F.col("base_importance") + F.col("boost")))
    work = F.array_contains("tags", "work") | ((F.col("entity_type") == "DATE") & (F.col("entity_subtype") == "deadline"))
    return out.withColumn("business_value", F.when(work, F.col("importance")).otherwise(0))


def synthesized(date_value: Column | None = None) -> Column:
    """The short text of an entity: its label and the message's beginning."""
    short = F.rtrim(F.substring(F.trim("text"), 1, 80), F.lit(".,!? "))
    kind, sub = F.col("entity_type"), F.col("entity_subtype")
    label = sub
    for subtype, name in MILESTONE_LABELS.items():
        label = F.when(sub == subtype, name).otherwise(label)
    head = lambda name: F.concat(F.lit("["), name, F.lit(":"), sub, F.lit("] "))
    dated = F.concat(head(kind), date_value, F.lit(": "), short) if date_value is not None else F.lit(None).cast("string")
    return (
        F.when(kind == "MILESTONE", F.concat(head(kind), label, F.lit(" — "), short))
        .when(kind == "DATE", F.coalesce(dated, F.concat(head(kind), short)))
        .when(kind == "SHARED_THING", F.concat(head(F.lit("SHARED")), short))
        .when(kind.isin("EMOTION", "FACT", "PERSON", "MEDICATION", "MEASUREMENT", "FINANCIAL", "GOAL"), F.concat(head(kind), short))
        .otherwise(F.concat(F.lit("["), kind, F.lit("] "), short))
    )


def remembered(messages: DataFrame, classes: DataFrame, least: float = 0.5) -> DataFrame:
    """A row for each memory that messages (doc_id, text, embedding) give: the
    message's columns but the vector, entity_type, entity_subtype, confidence,
    the enrichment and the short text ``memory``. Messages of under 10
    characters or 4 words give none, nor do shared things under 0.55, more
    than two milestones, and short texts of under five words."""
    said = messages.where((F.length("text") >= 10) & (word_count(F.col("text")) >= 4))
    found = classified(said, classes, least).where((F.col("entity_type") != "SHARED_THING") | (F.col("confidence") >= 0.55))
    kinds = found.withColumn("great", F.col("entity_type") == "MILESTONE")
    order = Window.partitionBy("doc_id", "great").orderBy(F.desc("confidence"), "entity_subtype")
    found = kinds.withColumn("place", F.row_number().over(order)).where(~F.col("great") | (F.col("place") <= 2)).drop("great", "place")
    rows = enriched(said.drop("embedding").join(found, "doc_id")).withColumn("memory", synthesized())
    return rows.where(word_count(F.col("memory")) >= 5)
