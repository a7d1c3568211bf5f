"""Where queries and their SQL are entered, and the views of the driver's tables that they share.

Mapping: conversations are messages (user = conv_id modulo 8, session = conv_id, message index = turn), documents are
cards with one field, benchmark passages are search queries, embeddings are card vectors, events are requests and load
samples, labels are verdicts.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources.tables import dealt, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") % 8).alias("user_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def patch() -> Column:
    """A patch made of a part's columns."""
    name = F.concat(F.lower(F.substring("p_type", 1, 3)), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))
    size = F.col("p_size").cast("string")
    return F.concat(F.lit("diff --git a/src/"), name, F.lit(" b/src/"), name, F.lit("\n@@ -1 +1 @@\n+def fn_"), size, F.lit("(x):\n+class C"), size, F.lit(":"))


PATCH = "'diff --git a/src/' || lower(p_type[1:3]) || '_' || p_size || '.py b/src/' || lower(p_type[1:3]) || '_' || p_size || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+def fn_' || p_size || '(x):' || chr(10) || '+class C' || p_size || ':'"
FILE = "'src/' || lower(p_type[1:3]) || '_' || p_size || '.py'"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("src/"), F.lower(F.substring("p_type", 1, 3)), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))
    return table(spark, sf, "part").select("*", patch().alias("patch"), name.alias("file"), F.col("p_size").cast("string").alias("size"))
