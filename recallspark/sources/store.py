"""Memory and session tables: content ids, upserts, deletes, copies, JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags

KNOWLEDGE = "text string, source string, importance int, metadata map<string,string>"


def content_id(salt: str, *parts: str | Column) -> Column:
    """First 32 hex digits of the SHA-256 of salt and parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), *parts), 256), 1, 32)


def user_hash(salt: str, user: str | Column = "user_id") -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), user), 256), 1, 16)


def prepared(rows: DataFrame, salt: str = "s0") -> DataFrame:
    """Rows ready to be stored: echo tags gone, short texts dropped before and
    after, milestones raised to importance 10, ids from the content."""
    rows = rows.where(F.length(F.trim("text")) >= 10).withColumn("text", strip_tags(F.col("text"))).where(F.length("text") >= 10)
    raised = F.when(F.col("is_milestone"), 10).otherwise(F.col("importance")).cast("int")
    return rows.withColumn("importance", raised).withColumn("mem_id", content_id(salt, "user_id", "text"))


def prepared_messages(rows: DataFrame, salt: str = "s0") -> DataFrame:
    """Session messages (conv_id, role, content, thought, hint, ...) ready to be
    stored: echo tags gone, empty ones dropped, thoughts and hints cut to 500 and
    200 characters, importance 3, ids from conversation, role and content."""
    rows = rows.withColumn("content", strip_tags(F.col("content"))).where(F.length("content") > 0)
    cut = {"thought": F.left("thought", F.lit(500)), "hint": F.left("hint", F.lit(200)), "importance": F.lit(3)}
    return rows.withColumns(cut).withColumn("mem_id", content_id(salt, F.col("conv_id").cast("string"), "role", "content"))


def upserted(stored: DataFrame, new: DataFrame, key: str = "mem_id", order: str = "write_seq") -> DataFrame:
    """Both tables' rows with the last write of each key: one shuffle by key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return stored.unionByName(new).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def superseded(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows without those of the same persona, user, source and subtype as ``keys``."""
    return stored.join(keys, ["persona_id", "user_id", "source", "entity_subtype"], "left_anti")


def without_phrases(rows: DataFrame, phrases: tuple[str, ...], column: str = "content") -> DataFrame:
    """Rows that hold none of the phrases, whatever the case."""
    return rows.where(~has_phrase(F.col(column), phrases))


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(text), F.lit(p.lower()))
    return F.coalesce(found, F.lit(False))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of memories with a fixed schema; a missing importance is 5."""
    return spark.read.schema(KNOWLEDGE).json(path, multiLine=True).na.fill({"importance": 5})


def write_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A Parquet table by persona and source, so that filters on them prune files."""
    rows.write.mode(mode).partitionBy("persona_id", "source").parquet(path)


def copy_missing(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key the target lacks: a copy that can be rerun."""
    return source.dropDuplicates([key]).join(target.select(key), key, "left_anti")
