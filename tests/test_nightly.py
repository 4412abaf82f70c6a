"""The nightly job: each memory is read once, each insight is there once."""

import json

from pyspark.sql import functions as F

from recallspark.sources.table import Table
from recallspark.streaming import nightly as N

KINDS = "user_id string, doc_id long, source string, text string, at string"
def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def replies(lines):
    """As a model would answer: an insight on the lines read, one twice, one unsure."""
    read = lines.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("line")), " / ").alias("l"))
    one = lambda text, c, p: F.struct(text.alias("text"), F.lit(c).alias("confidence"), F.lit(p).alias("priority"))
    said = F.array(one(F.col("l"), 0.9, "high"), one(F.col("l"), 0.7, "low"), one(F.lit("too unsure to be kept"), 0.5, "high"))
    return read.select("user_id", F.to_json(said).alias("raw"))


def run(spark, tmp_path):
    stream = spark.readStream.schema(KINDS).parquet(str(tmp_path / "in"))
    N.nightly(stream, str(tmp_path / "t"), str(tmp_path / "ck"), as_of(), replies, 4).awaitTermination()
    table = Table.open(spark, str(tmp_path / "t"), "mem_id", 4, spark.createDataFrame([], N.INSIGHT).schema)
    return table, sorted((r.user_id, r.text.count("text"), r.importance, r.confidence) for r in table.read().collect())


def test_nights_read_and_write_once(spark, tmp_path):
    put(spark, tmp_path, [("u1", i, "chat", f"text {i}", "2024-01-30T10:00:00") for i in range(4)] + [("u1", 8, "chat", "text old", "2023-01-01T00:00:00"), ("u2", 9, "chat", "text alone", "soon")])
    table, rows = run(spark, tmp_path)
    assert rows == [("u1", 4, 6, 0.9)]
    put(spark, tmp_path, [("u2", 20 + i, "chat", f"text {i}", "soon") for i in range(3)] + [("u2", 30, "night_insight", "text own", "soon")])
    table, rows = run(spark, tmp_path)
    assert rows == [("u1", 4, 6, 0.9), ("u2", 3, 6, 0.9)]  # the first night's memories are not read again
    version = table.manifest["version"]
    again, same = run(spark, tmp_path)
    assert same == rows and again.manifest["version"] == version


def test_a_night_that_runs_again_leaves_each_insight_once(spark, tmp_path):
    rows = spark.createDataFrame([("u1", json.dumps([{"text": "a fine insight", "confidence": 0.8, "priority": "medium"}])), ("u2", "broken"), ("u3", None)], "user_id string, raw string")
    table = Table.open(spark, str(tmp_path / "t"), "mem_id", 4, spark.createDataFrame([], N.INSIGHT).schema)
    for _ in range(2):
        table.upsert(N.as_insights(rows, as_of()), "write_seq", done="ck#0")
    table.upsert(N.as_insights(rows, as_of()), "write_seq", done="ck#1")
    assert [(r.user_id, r.text, r.importance, r.source) for r in table.read().collect()] == [("u1", "a fine insight", 5, "night_insight")]
