"""Domain views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF, TAXONOMY

#: The memory source that each documents.source number stands for.
SOURCES = (
    "extracted_emotion", "extracted_date", "extracted_fact", "extracted_person", "extracted_milestone", "extracted_medication", "extracted_goal",
    "extracted_measurement", "extracted_financial", "enriched", "night_insight", "character_core", "md_import", "user_message_raw", "project_knowledge",
    "chat", "chat", "chat", "chat", "chat",
)


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as memories; with embeddings unless ``vectors`` is false."""
    docs = table(spark, sf_dir, "documents")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.substring("source", 4, 9).cast("int") + 1)
    user = F.concat(F.lit("u"), (F.floor(F.col("doc_id") / 20) % 10).cast("string"))
    kind = F.when(F.startswith("source", F.lit("extracted_")), F.upper(F.substring("source", 11, 40)))
    subtypes = F.create_map(*(x for k, v in TAXONOMY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.try_element_at(subtypes, F.col("entity_type"))
    milestone = F.col("source") == "extracted_milestone"
    out = (
        docs.select("doc_id", "text", source.alias("source"), user.alias("user_id"), F.lit("p0").alias("persona_id"))
        .withColumn("mem_id", F.substring(F.sha2(F.concat(F.lit("s0:"), "user_id", F.lit(":"), "text"), 256), 1, 32))
        .withColumn("entity_type", kind)
        .withColumn("entity_subtype", F.element_at(own, (F.floor(F.col("doc_id") / 20) % F.size(own)).cast("int") + 1))
        .withColumn("is_milestone", milestone)
        .withColumn("importance", F.when(milestone, 10).otherwise(1 + F.floor(F.col("doc_id") / 3) % 10).cast("int"))
        .withColumn("ts", as_of() - F.make_dt_interval(hours=(F.col("doc_id") * 37 % 2160).cast("int")))
    )
    if not vectors:
        return out
    found = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return out.join(found, F.col("doc_id") % F.lit(found.count()) == F.col("vec_id")).drop("vec_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, user_id, qtext, embedding): the stated query set, every vector whose
    id is divisible by 20, with its document's whole text and user."""
    vectors = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    texts = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select("doc_id", F.col("text").alias("qtext"))
    out = vectors.join(texts, F.col("vec_id") == F.col("doc_id"))
    user = F.concat(F.lit("u"), (F.floor(F.col("vec_id") / 20) % 10).cast("string"))
    return out.select(F.col("vec_id").alias("qid"), user.alias("user_id"), "qtext", "embedding")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as session messages."""
    talk = table(spark, sf_dir, "conversations").where("role <> 'system'")
    at = as_of() - F.make_dt_interval(hours=(F.col("conv_id") * 13 % 96).cast("int")) + F.make_dt_interval(mins=F.col("turn").cast("int"))
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    user = F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string"))
    return talk.select("conv_id", role.alias("role"), F.col("text").alias("content"), at.alias("ts"), F.col("turn").alias("seq"), user.alias("user_id"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, a few at a time."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/events.parquet")
    # A stream reads a folder, and this table is one file in it.
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def state_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as messages of users: words, entities and a mood or topic."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events")
    return rows.select(
        "event_id", "ts", "user_id", F.floor("value").alias("words"), (k % 4).alias("entities"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("m"), (k % 5).cast("string"))).alias("mood"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("t"), (k % 7).cast("string"))).alias("topic"),
    )


def state_messages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as messages with an entity and what the reply to them says: mood,
    topic, concerns added and removed, and further XP; some leave a greeting,
    which the user's next message shows."""
    kinds = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(v[0]).alias("s")) for k, v in TAXONOMY.items()))
    rows = state_events(spark, sf_dir, stream).withColumn("e", kinds[(F.col("event_id") % len(TAXONOMY)).cast("int")])
    concern = lambda n: F.concat(F.lit("c"), (F.floor(F.col("event_id") / n) % 9).cast("string"))
    return rows.select(
        "user_id", "event_id", "ts", "words", "entities", "mood", F.col("topic").alias("reply_topic"), F.col("e.t").alias("entity_type"), F.col("e.s").alias("entity_subtype"),
        F.when(F.col("event_id") % 3 == 0, concern(3)).alias("added"), F.when(F.col("event_id") % 7 == 0, concern(7)).alias("removed"), F.when(F.col("event_id") % 11 == 0, F.lit(2.5)).alias("xp_delta"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("g"), (F.col("event_id") % 13).cast("string"))).alias("greeting"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): a model's insights on three documents each, as a JSON array."""
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("doc_id") % 3 + 1).cast("int"))
    one = F.struct(F.left("text", F.lit(40)).alias("text"), (F.col("doc_id") % 10 / 10).alias("confidence"), level.alias("priority"))
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("x")))).alias("l"))
    return rows.select("id", F.to_json(F.transform("l", lambda e: e["x"])).alias("raw"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): conversation turns as a model's replies: JSON, fenced JSON, JSON
    that breaks off after its response, and plain text."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("said"))
    body = F.to_json(F.struct(F.col("said").alias("response"), F.lit("a thought").alias("thought"), F.col("role").alias("mood"), (F.col("id") % 2 == 0).alias("safe_haven")))
    kind = F.col("id") % 4
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    broken = F.substring_index(body, ',"thought"', 1)
    return rows.select("id", F.when(kind == 0, body).when(kind == 1, fenced).when(kind == 2, broken).otherwise(F.col("said")).alias("raw"))
