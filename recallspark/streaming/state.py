"""Streams: per-user state, upserts by micro-batch, and expiring windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import progressed
from ..sources import scratch
from ..sources.table import Table, Versions

def progressing(stream: DataFrame, path: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]) -> StreamingQuery:
    """Runs ``step(rows, states)`` on each micro-batch: it gives the rows to write,
    below ``path``/rows, and the new states of the batch's users, which take the
    place of theirs in ``path``/states. Both are written under the batch's number, so a
    batch that runs again writes the same; two versions of the states are kept.

    ``step`` is a batch plan, so a user with a third of a micro-batch's rows is
    spread over tasks as in a batch."""
    states = Versions(stream.sparkSession, f"{path}/states")

    def run(batch: DataFrame, number: int) -> None:
        before = states.read(number - 1)
        rows, new = step(batch, before)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        states.write(number, new if before is None else before.join(new.select("user_id"), "user_id", "left_anti").unionByName(new))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def xp_step(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Running XP of a micro-batch's events on top of the users' states."""
    out = progressed(rows, before, lasts=())
    last = F.max_by(F.struct("xp", "messages"), F.struct("ts", "event_id"))
    new = out.groupBy("user_id").agg(last.alias("s"), F.max("ts").alias("last_ts")).select("user_id", "s.*", "last_ts")
    if before is not None:  # rows without a later time leave the last one
        was = before.select("user_id", F.col("last_ts").alias("was"))
        new = new.join(was, "user_id", "left").withColumn("last_ts", F.greatest("last_ts", "was")).drop("was")
    return out.select("user_id", "event_id", "xp", "level"), new


def run_progress(stream: DataFrame, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] = xp_step) -> DataFrame:
    """The rows of :func:`progressing`, run to the end of the stream's input."""
    path = scratch.folder(stream.sparkSession, "stream")
    progressing(stream, path, step).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows").drop("batch")


def upserting(stream: DataFrame, path: str, checkpoint: str, key: str = "mem_id", order: str = "write_seq", buckets: int = 16) -> StreamingQuery:
    """Writes a stream into a bucketed table (see ``sources.table``): each
    micro-batch's rows replace those of their keys, and only buckets that they
    touch are written. A batch that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        table = Table.open(batch.sparkSession, path, key, buckets, batch.schema)
        table.upsert(batch, order, done=f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream to its end into a Parquet table; table and checkpoint stand
    in a folder that driver and executors share."""
    path = scratch.folder(stream.sparkSession, "stream")
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/table")
    done.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def windowed_counts(session: DataFrame, late: str = "2 hours", width: str = "24 hours") -> DataFrame:
    """User messages by user and window of time; late ones within ``late`` count."""
    own = session.where("role = 'user'").withWatermark("ts", late)
    return own.groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")
