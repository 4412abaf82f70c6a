"""Data-quality audits of stored memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def by_source(memories: DataFrame) -> DataFrame:
    """(source, n, pct), pct of all with two decimals."""
    total = memories.agg(F.count("*").alias("total"))
    counts = memories.groupBy("source").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("source", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct"))


def importance_histogram(memories: DataFrame) -> DataFrame:
    """(importance, n) for 1 to 10, zeros included."""
    every = memories.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("importance"))
    return every.join(memories.groupBy("importance").agg(F.count("*").alias("n")), "importance", "left").select("importance", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(memories: DataFrame) -> DataFrame:
    """(digest, n, extra) of texts that are stored more than once."""
    return memories.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def counts(memories: DataFrame, as_of: Column) -> DataFrame:
    """One row: total, short, noise, extra copies, stale and milestones."""
    copies = memories.groupBy(F.md5("text").alias("d")).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
    stale = (F.col("importance") <= 3) & (F.col("ts") < as_of - F.make_dt_interval(days=F.lit(14)))
    out = memories.agg(
        F.count("*").alias("total"), F.count_if(F.length("text") < 50).alias("short"), F.count_if(word_count(F.col("text")) < 5).alias("noise"),
        F.count_if(stale).alias("stale"), F.count_if("is_milestone").alias("milestones"),
        F.count_if(F.col("source") == "chat").alias("sessions"), F.count_if(F.col("source") == "enriched").alias("enriched"),
    )
    return out.join(F.broadcast(copies))


def health(memories: DataFrame, as_of: Column) -> DataFrame:
    """(score, ratio): 10 less penalties, at least 0."""
    c = counts(memories, as_of)
    of = lambda x: F.col(x) / F.greatest(F.col("total"), F.lit(1))
    ratio = F.when(F.col("enriched") == 0, F.lit(float("inf"))).otherwise(F.col("sessions") / F.col("enriched"))
    penalty = (
        F.when(of("short") > 0.2, 2).when(of("short") > 0.1, 1).otherwise(0)
        + F.when(of("extra") > 0.1, 2).when(of("extra") > 0.05, 1).otherwise(0)
        + F.when(ratio > 10, 2).when(ratio > 5, 1).otherwise(0)
        + F.when((F.col("milestones") == 0) & (F.col("total") > 50), 1).otherwise(0)
        + F.when(of("stale") > 0.3, 1).otherwise(0)
    )
    return c.select(F.greatest(F.lit(0), 10 - penalty).alias("score"), F.round(ratio, 3).alias("ratio"))


#: What is counted of each day, source and importance.
_SUMS = ("n", "short", "noise", "milestones")


def daily(memories: DataFrame) -> DataFrame:
    """(day, source, importance, n, short, noise, milestones, texts): aggregates that
    merge, of memories (text, source, importance, is_milestone, ts). ``texts`` is a
    sketch of the distinct texts, of 2**12 places: its estimate is within 5 % of
    the number in 99 of 100 cases."""
    rows = memories.groupBy(F.to_date("ts").alias("day"), "source", "importance")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.length("text") < 50).alias("short"), F.count_if(word_count(F.col("text")) < 5).alias("noise"), F.count_if("is_milestone").alias("milestones"),
        F.hll_sketch_agg(F.coalesce("text", F.lit("")), 12).alias("texts"),
    )


def brought_up(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The aggregates of :func:`daily` of old and new memories, from those stored and
    those of the new ones alone: no old memory is read."""
    both = stored.unionByName(new).groupBy("day", "source", "importance")
    return both.agg(*(F.sum(c).alias(c) for c in _SUMS), F.hll_union_agg("texts").alias("texts"))


def counts_of_days(days: DataFrame, as_of: Column) -> DataFrame:
    """One row from stored aggregates: the columns of :func:`counts` but for extra,
    exact (stale ones where ``as_of`` is a midnight), and ``distinct_texts``, an
    estimate."""
    stale = (F.col("importance") <= 3) & (F.col("day") < F.to_date(as_of - F.make_dt_interval(days=F.lit(14))))
    of = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return days.agg(
        total("n").alias("total"), total("short").alias("short"), total("noise").alias("noise"), of(stale).alias("stale"), total("milestones").alias("milestones"),
        of(F.col("source") == "chat").alias("sessions"), of(F.col("source") == "enriched").alias("enriched"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("texts")), F.lit(0)).alias("distinct_texts"),
    )
