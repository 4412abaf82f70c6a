"""The nightly job: what is new since last night is read once, insights are kept once.

A stream of memory files is run to its end each night (``availableNow``): its
checkpoint knows what earlier nights have read. Each micro-batch's memories become
lines for the model, by user; the model's replies, JSON arrays of insights, come
from a function of these lines, as the model itself stands outside. The insights
that are sure enough are memories of the user, with a content id, and are put into
a bucketed table under the batch's mark, so that a batch that runs again after a
failure leaves each insight there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import nightly_lines, parsed_insights
from ..sources.scratch import written
from ..sources.store import content_id
from ..sources.table import Table

INSIGHT = "mem_id string, user_id string, persona_id string, source string, text string, importance int, confidence double, ts timestamp_ntz, write_seq long"
SKIPPED = ("character_core", "md_import", "user_message_raw", "night_insight", "project_knowledge")


def as_insights(replies: DataFrame, as_of: Column, salt: str = "s0", persona: str = "p0") -> DataFrame:
    """Memories, in the columns of ``INSIGHT``, from replies (user_id, raw): those of
    a confidence of 0.6 and 10 characters, of importance 6, 5 or 4 by priority."""
    rows = parsed_insights(replies, "raw")
    last = F.row_number().over(Window.partitionBy("user_id", "text").orderBy(F.desc("confidence")))
    rows = rows.withColumn("__n", last).where("__n = 1")
    return rows.select(
        content_id(salt, F.col("user_id"), F.col("text")).alias("mem_id"), F.col("user_id").cast("string").alias("user_id"), F.lit(persona).alias("persona_id"), F.lit("night_insight").alias("source"),
        "text", F.col("importance").cast("int").alias("importance"), "confidence", as_of.cast("timestamp_ntz").alias("ts"), F.unix_seconds(as_of.cast("timestamp")).alias("write_seq"),
    )


def nightly(stream: DataFrame, path: str, checkpoint: str, as_of: Column, ask: Callable[[DataFrame], DataFrame], buckets: int = 16) -> StreamingQuery:
    """Runs a night over ``stream``, memories (user_id, doc_id, source, text, at).
    ``ask`` gives the replies (user_id, raw) to the lines (user_id, doc_id, place,
    line) of a micro-batch. Insights stand in the table at ``path``."""

    def night(batch: DataFrame, number: int) -> None:
        table = Table.open(batch.sparkSession, path, "mem_id", buckets, batch.sparkSession.createDataFrame([], INSIGHT).schema)
        replies = ask(written(nightly_lines(batch, as_of, SKIPPED)))
        table.upsert(as_insights(replies, as_of), "write_seq", done=f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(night).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
