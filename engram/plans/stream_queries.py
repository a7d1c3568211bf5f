"""Files, streams and publications end to end, in the shared folder. Ids in brackets name the operators of the inventory."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram.plans.registry import query
from engram.session import ensure_checkpoint_dir
from engram.sources import tables
from engram.sources.tables import table
from engram.streaming import ingestion


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def _requests(spark, sf):
    """Every conversation as a request; every fifth under the key of the one before, with another body."""
    c = table(spark, sf, "conversations")
    message = F.struct(F.col("role"), F.col("text").alias("content"), F.col("turn").alias("timestamp"))
    per = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    key = F.when(F.col("conv_id") % 5 == 4, F.col("conv_id") - 1).otherwise(F.col("conv_id"))
    return per.select(F.concat(F.lit("u"), key.cast("string")).alias("user_id"), F.concat(F.lit("r"), key.cast("string")).alias("request_id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "messages", "conv_id")


def _ingested(spark, sf) -> tables.Publications:
    """A store that a stream has filled: one file of requests, then the same again."""
    folder = _folder(spark)
    for again in range(2):
        first = _requests(spark, sf).where("conv_id % 5 < 4").drop("conv_id")
        first.coalesce(1).write.mode("append").json(f"{folder}/in")
        ingestion.start(spark, f"{folder}/in", f"{folder}/store", f"{folder}/offsets").awaitTermination()
    _requests(spark, sf).where("conv_id % 5 = 4").drop("conv_id").coalesce(1).write.mode("append").json(f"{folder}/in")
    ingestion.start(spark, f"{folder}/in", f"{folder}/store", f"{folder}/offsets").awaitTermination()
    return tables.Publications(spark, f"{folder}/store")


_ROLES = "SELECT conv_id, bool_and(role IN ('user', 'assistant')) AS ok FROM conversations GROUP BY conv_id"


@query(f"""WITH r AS ({_ROLES}), f AS (SELECT conv_id, ok FROM r WHERE conv_id % 5 < 4), l AS (SELECT conv_id, ok, conv_id - 1 AS key FROM r WHERE conv_id % 5 = 4)
SELECT 'r' || conv_id AS request_id, CASE WHEN ok THEN 'fresh' ELSE 'role' END AS outcome, 1::BIGINT AS n FROM f UNION ALL SELECT 'r' || conv_id, CASE WHEN ok THEN 'replay' ELSE 'role' END, 1 FROM f
UNION ALL SELECT 'r' || l.key, CASE WHEN NOT l.ok THEN 'role' WHEN f.ok THEN 'conflict' ELSE 'fresh' END, 1 FROM l LEFT JOIN f ON f.conv_id = l.key""")
def stream_outcomes(spark, sf):
    """[S1, S5, T1, T6, T7, T12] Requests taken once: sent again they are replays, with another body conflicts, with a bad role refused."""
    out = _ingested(spark, sf).read("outcomes")
    return out.groupBy("request_id", "outcome", F.monotonically_increasing_id()).agg(F.count("*").alias("n")).select("request_id", "outcome", "n")


@query(f"""WITH r AS ({_ROLES}), k AS (SELECT conv_id FROM r WHERE ok AND (conv_id % 5 < 4 OR conv_id - 1 NOT IN (SELECT conv_id FROM r WHERE ok)))
SELECT 's' || conv_id AS session_id, string_agg(text, '' ORDER BY turn) AS told, count(*) FILTER (length(text) > 0) > 0 AS any FROM conversations JOIN k USING (conv_id) GROUP BY conv_id HAVING count(*) FILTER (length(text) > 0) > 0""")
def stream_chunks(spark, sf):
    """[S5, S8, J5, T10] The chunks of each session that a stream has taken, put together in order of arrival and place."""
    live = _ingested(spark, sf)
    at = live.manifest()
    rows = live.read("chunks", at).join(live.read("ingestions", at).select("user_id", "request_id", "session_id"), ["user_id", "request_id"])
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "ord", "text"))), lambda c: c["text"]), "")
    return rows.groupBy("session_id").agg(told.alias("told")).select("session_id", "told", F.lit(True).alias("any"))


@query("""SELECT 'k' || vec_id AS key, vec_id + 1000 AS last, true AS first_time, false AS second_time FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 'k' || vec_id, vec_id, true, false FROM embeddings WHERE vec_id % 3 = 1""")
def legacy_vectors(spark, sf):
    """[S19, T20] Lines of keys and vectors: every third key twice (the last counts), every third line broken; imported once."""
    folder, k = _folder(spark), F.col("vec_id").cast("string")
    line = lambda v: F.concat(F.lit('{"k": "k'), k, F.lit('", "v": ['), v.cast("string"), F.lit("]}"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(F.when(F.col("vec_id") % 3 == 0, F.array(line(F.col("vec_id")), F.lit(""), line(F.col("vec_id") + 1000))).when(
        F.col("vec_id") % 3 == 1, F.array(line(F.col("vec_id")))).otherwise(F.array(F.lit("{broken"), F.lit('{"k": 1}'), F.lit('{"k": "x", "v": "y"}')))).alias("value"))
    rows.coalesce(1).select("value").write.text(f"{folder}/lines")
    live = tables.Publications(spark, f"{folder}/store")
    first, second = (live.once("vectors", {"vectors": tables.vector_lines(spark, f"{folder}/lines")}) for _ in range(2))
    return live.read("vectors").select("key", F.element_at("vector", 1).cast("long").alias("last"), F.lit(first).alias("first_time"), F.lit(second).alias("second_time"))


@query(f"SELECT v AS version, v = {tables.SCHEMA_VERSION} AS opens FROM (SELECT unnest([{tables.SCHEMA_VERSION - 1}, {tables.SCHEMA_VERSION}, {tables.SCHEMA_VERSION + 1}]) AS v)")
def schema_gate(spark, sf):
    """[S3, S4] A store opens at its own schema version alone."""
    folder, rows = _folder(spark), []
    for version in range(tables.SCHEMA_VERSION - 1, tables.SCHEMA_VERSION + 2):
        live = tables.Publications(spark, f"{folder}/{version}")
        live.publish({"cards": spark.range(1)})
        live.stamp(version)
        try:
            live.read("cards")
            rows.append((version, True))
        except ValueError:
            rows.append((version, False))
    return spark.createDataFrame(rows, "version int, opens boolean")
