"""Evidence grading and the token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FAR, NEAR
from ..functions.text import content_type, trimmed, type_priority


def graded(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, n, status, confidence, avg_distance, refuse_strict, refuse_soft); a
    query without results has no data."""
    rows = queries.select("qid").join(results.select("qid", "distance"), "qid", "left")
    out = rows.groupBy("qid").agg(F.count("distance").alias("n"), F.min("distance").alias("lo"), F.avg("distance").alias("mean"))
    status = (
        F.when(F.col("n") == 0, "NO_DATA")
        .when(F.col("n") == 1, F.when(F.col("lo") > FAR, "NO_DATA").otherwise("LOW_CONFIDENCE"))
        .when(F.col("lo") < NEAR, "GROUNDED")
        .when(F.col("lo") < FAR, "LOW_CONFIDENCE")
        .otherwise("NO_DATA")
    )
    confidence = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("lo") / 2)), 3))
    mean = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(F.round("mean", 3))
    out = out.select("qid", "n", status.alias("status"), confidence.alias("confidence"), mean.alias("avg_distance"))
    return out.withColumns({"refuse_strict": F.col("status") == "NO_DATA", "refuse_soft": F.col("confidence") < 0.1})


def directive(strict: bool = True) -> F.Column:
    """A short instruction for the status of a graded row."""
    share = F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    none = F.lit("[STRICT] no evidence: do not answer from memory") if strict else F.lit("[SOFT] no sure evidence: say so when in doubt")
    return (
        F.when(F.col("status") == "NO_DATA", none)
        .when(F.col("status") == "LOW_CONFIDENCE", F.concat(F.lit("[LOW] check that the memories concern the question (confidence "), share, F.lit(")")))
        .otherwise(F.concat(F.lit("[GROUNDED] quote only what the memories say (confidence "), share, F.lit(")")))
    )


def fitted(results: DataFrame, max_chars: int, reserved: int = 0) -> DataFrame:
    """(qid, doc_id, place, text, trimmed): results by priority while they fit; the
    first that doesn't is trimmed if 50 characters are left and 30 stay. Nothing
    follows it, so a running sum decides."""
    room = max_chars - reserved
    kind = content_type(F.col("text"))
    priority = F.round(type_priority(kind) * 0.4 + F.col("importance") * 0.3 + F.coalesce("final_score", F.lit(0.5)) * 10 * 0.3, 6)
    order = Window.partitionBy("qid").orderBy(F.desc("priority"), "rank")
    rows = results.withColumn("priority", priority).withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("over", F.min(F.when(F.col("used") > room, F.col("place"))).over(Window.partitionBy("qid")))
    left = F.lit(room) - (F.col("used") - F.length("text"))
    rows = rows.withColumn("short", trimmed(F.col("text"), left.cast("int")))
    whole = F.col("over").isNull() | (F.col("place") < F.col("over"))
    part = (F.col("place") == F.col("over")) & (left >= 50) & (F.length("short") >= 30)
    return rows.where(whole | part).select("qid", "doc_id", "place", F.when(whole, F.col("text")).otherwise(F.col("short")).alias("text"), (~whole).alias("trimmed"))


def context(fitted_rows: DataFrame) -> DataFrame:
    """(qid, n, chars, tokens, context): the texts of each query, in order."""
    out = fitted_rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("l"))
    out = out.select("qid", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("context"))
    size = F.length("context")
    return out.withColumns({"chars": size, "tokens": F.when(size == 0, 0).otherwise(F.floor(size / 4) + 1).cast("int")})
