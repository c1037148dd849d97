"""Streaming queries run over what there is, with the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.plans.log import ORACLES as LOG
from sparkwright.sources import shared
from sparkwright.streaming import progress as G


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared.root(spark)}/sparkwright/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return G.source(spark, sf_dir, schema, "events.parquet")


def _messages(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "evidence_created").when(F.col("event_type") == "signup", "phase").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("msg_type"), F.floor("value").alias("amount"))


def stageline_late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states from messages that reach six triggers in no order."""
    folder = _folder(spark)
    messages = _messages(spark.read.parquet(f"{sf_dir}/events.parquet"))
    messages.repartition(6, F.xxhash64("seq")).write.parquet(f"{folder}/in")
    with G.rocks_db(spark):
        out = G.once(G.late_run_states(G.source(spark, f"{folder}/in", messages.schema), "36500 days"), f"{folder}/out", f"{folder}/checkpoint", "update")
    return out.groupBy("run_id").agg(F.max_by(F.struct("state", "messages", "evidence", "phases", "last_progress"), "batch").alias("s")).select("run_id", "s.*")


def stageline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states by managed state."""
    messages = _messages(_events(spark, sf_dir))
    folder = _folder(spark)
    out = G.once(G.run_states(messages), f"{folder}/out", f"{folder}/checkpoint", "update")
    return out.groupBy("run_id").agg(F.max_by(F.struct("state", "messages", "evidence", "phases", "last_progress"), "messages").alias("s")).select("run_id", "s.*")


def evidence_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by day and type; the last days stay open until the watermark passes them, so updates are read."""
    evidence = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("captured_at"), F.col("event_type").alias("type"))
    folder = _folder(spark)
    out = G.once(G.evidence_windows(evidence), f"{folder}/out", f"{folder}/checkpoint", "update")
    return out.groupBy("window_start", "type").agg(F.max("n").alias("n")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "type", "n")


QUERIES = (stageline_stream, stageline_late_stream, evidence_window_stream)
ORACLES = {"stageline_stream": LOG["stageline_state"], "stageline_late_stream": LOG["stageline_state"], "evidence_window_stream": "select strftime(ts, '%Y-%m-%d') as day, event_type as type, count(*) as n from events group by all"}
