"""Inbound transcripts, change logs as streams, and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import conversation_id, conversation_kind, conversation_problem, derived_event_id, ledger_event_id

INBOUND = "comment string, events array<struct<bot_id:string,user_id:string,message_id:string,text:string,group_id:string,mentioned:boolean>>"
EVALSET = "documents array<struct<key:string,title:string,content:string>>, queries array<struct<id:string,category:string,text:string,relevant:array<string>>>"
DOCUMENT_EVENT = "sequence long, event_id string, kind string, document_id long, aggregate_revision long, access_revision long, lifecycle_revision long, content string"


def flatten_inbound(transcripts: DataFrame) -> DataFrame:
    """One flat event for each inbound message, with derived ids and a reject reason (IO-06, IO-07)."""
    e = transcripts.select(F.explode("events").alias("e")).select("e.*")
    e = e.withColumn("conversation_id", conversation_id("bot_id", "user_id", "group_id")).withColumn("conversation_kind", conversation_kind("group_id"))
    e = e.withColumn("event_id", derived_event_id("conversation_id", "message", "message_id"))
    return e.withColumn("ledger_id", ledger_event_id("event_id")).withColumn("problem", conversation_problem("conversation_id", "conversation_kind", "bot_id", "user_id", "group_id"))


def ingest_inbound(spark: SparkSession, path: str) -> DataFrame:
    return flatten_inbound(spark.read.schema(INBOUND).json(path, multiLine=True))


def read_evalset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, relevance) of an evaluation set (IO-11)."""
    s = spark.read.schema(EVALSET).json(path, multiLine=True)
    q = s.select(F.explode("queries").alias("q"))
    return s.select(F.explode("documents").alias("d")).select("d.*"), q.select("q.id", "q.category", "q.text"), q.select(F.col("q.id").alias("id"), F.explode("q.relevant").alias("key"))


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A change log as a stream; with trigger(availableNow=True) it stops at the log's end, else it
    follows (IO-02)."""
    r = spark.readStream.schema(DOCUMENT_EVENT)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)
