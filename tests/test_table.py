"""Bucketed tables: upserts, deletes, versions and what they leave alone."""

import json

import pytest
from pyspark.sql import functions as F

from recallspark.operators import consolidate
from recallspark.sources.table import Folder, Table

KINDS = "mem_id string, v long, seq long"


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("k"), "id").alias("mem_id"), F.col("id").alias("v"), F.lit(1).cast("long").alias("seq"))
    t = Table.open(spark, str(tmp_path / "t"), "mem_id", 8, rows.schema)
    t.upsert(rows, "seq")
    return t


def values(t):
    return {r.mem_id: r.v for r in t.read().collect()}


def test_upsert_writes_only_touched_buckets(spark, table):
    before = dict(table.manifest["parts"])
    table.upsert(spark.createDataFrame([("k3", 333, 2), ("k4", -4, 0)], KINDS), "seq")
    touched = {b for b, p in table.manifest["parts"].items() if p != before[b]}
    assert len(touched) <= 2 and values(table) == {f"k{i}": i for i in range(100)} | {"k3": 333}
    version = Folder(spark, f"{table.folder.path}/v{table.manifest['version']}")
    assert {n.removeprefix("bucket=") for n in version.names() if n.startswith("bucket=")} == touched


def test_last_of_repeated_keys_and_reruns(spark, table):
    rows = spark.createDataFrame([("new", 1, 5), ("new", 2, 7), ("new", 3, 6), (None, 4, 1)], KINDS)
    table.upsert(rows, "seq", done="batch 0")
    version = table.manifest["version"]
    table.upsert(rows, "seq", done="batch 0")
    assert table.manifest["version"] == version and values(table)["new"] == 2 and values(table)[None] == 4 and table.count() == 102


def test_delete_returns_its_count(spark, table):
    assert table.delete(spark.createDataFrame([("k3",), ("k3",), ("none",)], "mem_id string")) == 1
    assert table.delete_where(F.col("v") >= 90) == 10
    assert table.delete_where(F.col("v") > 1000) == 0
    assert table.count() == table.read().count() == 89


def test_get_or_create_and_versions(spark, table):
    for i in range(4):
        table.upsert(spark.createDataFrame([("k1", i, 10 + i)], KINDS), "seq")
    again = Table.open(spark, table.folder.path, "mem_id", 99, table.schema)
    assert again.manifest == table.manifest and again.manifest["buckets"] == 8 and values(again) == values(table)
    names = table.folder.names()
    assert sum(n.startswith("manifest-") for n in names) == 2
    old = json.loads(table.folder.read(min(n for n in names if n.startswith("manifest-"))))
    assert Table(spark, table.folder.path, old).get("k1").first().v == 2  # a reader of the version before still has its files
    assert again.get("k1", "k2").count() == 2 and again.get("none").count() == 0
    paths = again.get("k1").inputFiles()
    assert paths and all(f"bucket={b}" in p for p in paths for b in [p.split("bucket=")[1].split("/")[0]]) and len({p.split("bucket=")[1].split("/")[0] for p in paths}) == 1


def test_an_empty_table(spark, tmp_path):
    t = Table.open(spark, str(tmp_path / "none"), "mem_id", 4, spark.createDataFrame([], KINDS).schema)
    assert t.read().count() == t.count() == t.delete_where(F.lit(True)) == 0
    t.upsert(spark.createDataFrame([], KINDS), "seq")
    assert t.read().count() == 0


MEMORY = "doc_id long, user_id string, text string, importance int, ts timestamp_ntz, entity_subtype string"


def memory(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, user_id string, text string, importance int, ts string, entity_subtype string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_chains_of_merges_end_at_one_root(spark):
    chain = [(i, i - 1) for i in range(2, 60)] + [(100, 5), (101, 100), (200, 300)]
    got = {r.doc_id: r.root_id for r in consolidate.roots(spark.createDataFrame(chain, "doc_id long, target_id long")).collect()}
    assert got == {i: 1 for i in range(2, 60)} | {100: 1, 101: 1, 200: 300}
    with pytest.raises(ValueError, match="circle"):
        consolidate.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "doc_id long, target_id long"), 6)


def test_decisions_are_carried_out(spark):
    stored = memory(spark, [(1, "u", "first", 3, "2024-01-01", None), (2, "u", "tired then", 4, "2024-01-02", "tired"), (3, "u", "other", 5, "2024-01-03", None)])
    new = memory(spark, [(10, "u", "first again", 7, "2024-01-10", None), (11, "u", "first once more", 2, "2024-01-11", None), (12, "u", "tired now", 4, "2024-01-12", "tired"), (13, "u", "new one", 1, "2024-01-13", None)])
    near = spark.createDataFrame([(10, 1, None, 0.9, 1), (10, 3, None, 0.95, 2), (11, 10, None, 0.99, 1), (12, 2, "tired", 0.8, 1), (12, 3, None, 0.9, 2), (13, 3, None, 0.5, 1)], "doc_id long, other_id long, other_subtype string, similarity double, rank int")
    decisions = consolidate.decided(new, near)
    assert {r.doc_id: (r.action, r.target_id, r.archived) for r in decisions.collect()} == {10: ("merge", 1, []), 11: ("merge", 10, []), 12: ("supersede", None, [2]), 13: ("create", None, [])}
    rows = {r.doc_id: r for r in consolidate.carried_out(stored, new, decisions).collect()}
    assert set(rows) == {1, 2, 3, 12, 13}
    assert (rows[1].importance, rows[1].mentions, str(rows[1].last_mentioned)[:10]) == (7, 3, "2024-01-11")
    assert not rows[2].is_active and json.loads(rows[2].note) == {"archived_because": "superseded", "by": 12}
    assert all(rows[i].is_active and rows[i].mentions == 1 and rows[i].note is None for i in (3, 12, 13))
    notes = consolidate.mention_notes(new, decisions).orderBy("root_id", "ts").collect()
    assert [(r.root_id, r.note) for r in notes] == [(1, "first again"), (1, "first once more")]
