"""Requests, sessions and publications as tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of validation.
MOST_MESSAGES, MOST_CHARS, MOST_TOTAL = 2000, 1_000_000, 4_000_000
ROLES = ("user", "assistant")


def _missing(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def whole_time(timestamp: Column) -> Column:
    """Whether a message's time, read as a variant, is a whole number or absent. (Truth values count as whole numbers.)"""
    return timestamp.isNull() | F.coalesce(F.schema_of_variant(timestamp).isin("BIGINT", "BOOLEAN", "VOID"), F.lit(True))


def _message_reason(role: Column, content: Column, time_ok: Column) -> Column:
    """Why one message is refused, the first reason winning."""
    return F.when(role.isNull() | ~role.isin(*ROLES), "role").when(content.isNull(), "content").when(F.length(content) > MOST_CHARS, "content_length").when(~time_ok, "timestamp")


def _chain(request_id: Column, user_id: Column, session_id: Column, n: Column, first_bad: Column, total: Column) -> Column:
    chain = F.when(_missing(request_id), "request_id").when(_missing(user_id), "user_id").when(_missing(session_id), "session_id")
    chain = chain.when(F.coalesce(n, F.lit(0)) <= 0, "messages_empty").when(n > MOST_MESSAGES, "messages_many")
    return chain.when(first_bad.isNotNull(), first_bad).when(total > MOST_TOTAL, "total_length")


def reject_reason(request_id: Column, user_id: Column, session_id: Column, messages: Column, variant_times: bool = False) -> Column:
    """Why an Add request is refused, the first reason winning; null where it is valid. messages: array of
    struct(role, content, timestamp); with variant_times the timestamps are variants, whose kind is checked."""
    total = F.aggregate(messages, F.lit(0).cast("long"), lambda s, m: s + F.coalesce(F.length(m["content"]), F.lit(0)))
    reasons = F.transform(messages, lambda m: _message_reason(m["role"], m["content"], whole_time(m["timestamp"]) if variant_times else F.lit(True)))
    return _chain(request_id, user_id, session_id, F.size(messages), F.try_element_at(F.filter(reasons, lambda r: r.isNotNull()), F.lit(1)), total)


def reject_reasons(rows: DataFrame) -> DataFrame:
    """rows: request_id, user_id, session_id, message_index, role, content; one row per message, as they arrive in a table. request_id, user_id,
    session_id, reason: as reject_reason, by counts and the first bad message, so that a request that is too large is refused without
    being gathered."""
    bad = _message_reason(F.col("role"), F.col("content"), F.lit(True))
    key = ["request_id", "user_id", "session_id"]
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(bad, F.when(bad.isNotNull(), F.col("message_index"))).alias("bad"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("total"))
    return per.select(*key, _chain(*map(F.col, key), F.col("n"), F.col("bad"), F.col("total")).alias("reason"))


def content_hashes(rows: DataFrame) -> DataFrame:
    """rows: request_id, message_index, role, content. request_id, content_hash of requests that validation leaves: counts come first, so what is
    gathered of a request is bounded by them."""
    fits = rows.groupBy("request_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("total")).where((F.col("n") <= MOST_MESSAGES) & (F.col("total") <= MOST_TOTAL)).select("request_id")
    part = F.concat("role", F.lit("\x1e"), "content", F.lit("\x1e\x1d"))
    parts = F.array_sort(F.collect_list(F.struct("message_index", part.alias("part"))))
    held = rows.join(fits, "request_id", "left_semi").groupBy("request_id")
    return held.agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["part"]), "").cast("binary"), 256).alias("content_hash"))


def search_reject_reason(user_id: Column, query: Column, top_k: Column, options: Column | None = None) -> Column:
    """Why a Search request is refused; top_k has been read as a whole number (null: absent or no such number), options as an array of texts
    (with a null where one is none)."""
    chain = F.when(_missing(user_id), "user_id").when(F.coalesce(query, F.lit("")).rlike(r"(?U)^\s*$"), "query").when(top_k.isNull() | ~top_k.between(0, 100), "top_k")
    return chain if options is None else chain.when(F.coalesce(F.exists(options, lambda o: o.isNull()), F.lit(False)), "options")


def deduplicated(requests: DataFrame) -> DataFrame:
    """requests: user_id, request_id, content_hash, seq. Adds outcome: the first row of a key is fresh, later rows are replays
    where the content is the same and conflicts where it isn't."""
    of = Window.partitionBy("user_id", "request_id").orderBy("seq")
    first = F.first("content_hash").over(of)
    return requests.withColumn("outcome", F.when(F.row_number().over(of) == 1, "fresh").when(F.col("content_hash") == first, "replay").otherwise("conflict"))


def sessions(chunks: DataFrame) -> DataFrame:
    """chunks: user_id, session_id, seq. One row per session: chunk_count, first_seq, last_seq."""
    return chunks.groupBy("user_id", "session_id").agg(F.count("*").alias("chunk_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def closed_by_change(rolled: DataFrame) -> DataFrame:
    """rolled: sessions(). A session is closed once a later one of its user has begun. The window sees one row per session."""
    later = F.lead("session_id").over(Window.partitionBy("user_id").orderBy("first_seq", "session_id"))
    return rolled.withColumn("next_session", later).withColumn("closed", later.isNotNull())


def islands(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds island: a number for each run of rows with equal value, from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w).cast("int")).drop("_c")


def neighbours(rows: DataFrame, key: list[str], order: str, reach: int = 1) -> DataFrame:
    """Pairs (order, neighbour) of rows of one message no further than reach apart."""
    a, b = rows.select(*key, F.col(order).alias("at")), rows.select(*key, F.col(order).alias("neighbour"))
    spread = a.withColumn("neighbour", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))).where("neighbour != at")
    return spread.join(b, [*key, "neighbour"])


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row with the highest order: the live publication."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select(*key, "_r.*")


def without_scope(rows: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """rows of all scopes but those purged."""
    return rows.join(scopes.select(scope).distinct(), scope, "left_anti")


def lease_state(status: Column, lease_expires: Column, now: Column) -> Column:
    """A request in work whose lease has run out has failed."""
    return F.when((status == "processing") & (lease_expires < now), "failed").otherwise(status)
