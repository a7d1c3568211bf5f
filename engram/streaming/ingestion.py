"""Add requests as a stream into a published store: each batch is validated, claimed, cut into chunks and made live in one rename.

A batch is acknowledged (its offsets are committed) only after its rows are live, so what a client is told was taken can be
read. A batch that is tried again writes the same publication. Requests of a user arrive in one batch in order of their
arrival; keys taken before are left out by claims, so a replay adds nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import chunking, ingest, retrieval, store
from engram.sources import tables

INGESTIONS = "user_id string, request_id string, session_id string, content_hash string, status string, lease_expires timestamp, received_seq long"


def taken(spark: SparkSession, batch: DataFrame, live: tables.Publications) -> dict[str, DataFrame]:
    """batch: rows of tables.ADD_REQUEST. The new rows of ingestions, chunks and outcomes (user_id, request_id, outcome: fresh, or why not)."""
    state = live.manifest()
    held = live.read("ingestions", state) if "ingestions" in state["tables"] else spark.createDataFrame([], INGESTIONS)
    rows = batch.withColumn("reason", ingest.reject_reason(F.col("request_id"), F.col("user_id"), F.col("session_id"), F.col("messages"), variant_times=True))
    body = F.sha2(F.to_json(F.transform("messages", lambda m: F.struct(m["role"], m["content"]))), 256)
    rows = retrieval.kept(rows.withColumn("content_hash", body).withColumn("seq", F.monotonically_increasing_id()))
    good = rows.where("reason IS NULL")
    claimed = retrieval.kept(store.claims(held.select("user_id", "request_id", "content_hash", "status", "lease_expires"), good.select("user_id", "request_id", "content_hash", "seq", "session_id", "messages"), F.current_timestamp()))
    new = claimed.where("outcome IN ('fresh', 'takeover')")
    numbered = store.sequenced(new.select("user_id", "request_id", "session_id", "content_hash", F.col("seq").alias("received_at")))
    base = held.groupBy("user_id").agg(F.max("received_seq").alias("_last"))
    ingestions = numbered.join(base, "user_id", "left").select("user_id", "request_id", "session_id", "content_hash", F.lit("committed").alias("status"), F.lit(None).cast("timestamp").alias("lease_expires"),
                                                               (F.col("received_seq") + F.coalesce("_last", F.lit(0))).cast("long").alias("received_seq"))
    messages = new.select("user_id", "request_id", F.posexplode("messages").alias("message_index", "m")).select("user_id", "request_id", "message_index", F.col("m.content").alias("content"), F.col("m.role").alias("role"))
    chunks = chunking.chunks(messages).join(messages.select("user_id", "request_id", "message_index", "role"), ["user_id", "request_id", "message_index"])
    refused = rows.where("reason IS NOT NULL").select("user_id", "request_id", F.col("reason").alias("outcome"))
    return {"ingestions": ingestions, "chunks": chunks, "outcomes": refused.unionByName(claimed.select("user_id", "request_id", "outcome"))}


def start(spark: SparkSession, requests: str, root: str, checkpoint: str, once: bool = True):
    """The stream from a folder of JSON lines into the store at root. once: all that is there, then stop."""
    live = tables.Publications(spark, root)

    def each(batch: DataFrame, number: int) -> None:
        live.append(taken(batch.sparkSession, batch, live), f"batch-{number}")

    writer = tables.add_request_stream(spark, requests).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recovered(ingestions: DataFrame) -> DataFrame:
    """ingestions with those failed whose lease ran out: what a service does before it takes requests."""
    return ingestions.withColumn("status", ingest.lease_state(F.col("status"), F.col("lease_expires"), F.current_timestamp()))
