"""The store's tables as operators: scans, index rows, replacement of a session's cards, vectors, claims, lifecycle, purge.

A store is a set of tables under one publication (sources.tables.Publications): what a transaction changes is written as new
tables and made live by one rename, so that a visible card always has its whole index. Keys are (user_id, card_id),
(user_id, session_id), (user_id, request_id).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.operators import cards as card_ops
from engram.operators import extraction, retrieval
from engram.operators.rendering import card_columns

#: Tables that belong to a user, in the order in which a purge reports them.
SCOPED = ("vectors", "anchors", "entities", "terms", "cards", "chunks", "sessions", "ingestions")
CARD_TABLES = ("cards", "terms", "entities", "anchors", "vectors")
#: Seconds of a lease: at least LEASE_LEAST, else LEASE_BUDGETS times the budget of a request.
LEASE_LEAST, LEASE_BUDGETS = 60, 3


# -- scans ------------------------------------------------------------------------------------------------------------


def session_chunks(chunks: DataFrame, ingestions: DataFrame, limit: int = -1) -> DataFrame:
    """chunks: user_id, request_id, message_index, ord, char_start; ingestions: user_id, request_id, session_id, received_seq. The chunks of
    each session with their position from 1, in order of arrival and place; the first `limit` (-1: all)."""
    rows = chunks.join(ingestions.select("user_id", "request_id", "session_id", "received_seq"), ["user_id", "request_id"])
    order = Window.partitionBy("user_id", "session_id").orderBy("received_seq", "message_index", "ord", "char_start")
    rows = rows.withColumn("position", F.row_number().over(order))
    return rows if limit < 0 else rows.where(F.col("position") <= limit)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids. A list of ids is broadcast where it is measured to be short."""
    wanted, _ = retrieval.small(ids.select(key).distinct())
    return rows.join(wanted, key, "left_semi")


def live(index: DataFrame, cards: DataFrame, key: tuple[str, ...] = ("user_id", "card_id")) -> DataFrame:
    """Rows of an index whose card still exists."""
    return index.join(cards.select(*key).distinct(), list(key), "left_semi")


def live_vectors(vectors: DataFrame, cards: DataFrame, model: str, key: tuple[str, ...] = ("user_id", "card_id")) -> DataFrame:
    """vectors: key, model, dim, vec. Those of live cards by one model, as long as they say."""
    good = vectors.where((F.col("model") == model) & (F.col("dim") > 0) & (F.size("vec") == F.col("dim")))
    return live(good, cards, key)


def versions(cards: DataFrame) -> DataFrame:
    """cards: user_id, session_id, extraction_version. user_id, session_id, versions (sorted)."""
    return cards.groupBy("user_id", "session_id").agg(F.array_sort(F.collect_set("extraction_version")).alias("versions"))


def last_ingestions(ingestions: DataFrame) -> DataFrame:
    """user_id, session_id and ingestion_id of each user's latest ingestion."""
    return ingestions.groupBy("user_id").agg(F.max_by("session_id", "ingestion_id").alias("session_id"), F.max("ingestion_id").alias("ingestion_id"))


def sequenced(requests: DataFrame) -> DataFrame:
    """requests: user_id, received_at, request_id. Adds received_seq: 1, 2, ... of each user in order of arrival."""
    return requests.withColumn("received_seq", F.row_number().over(Window.partitionBy("user_id").orderBy("received_at", "request_id")))


# -- index rows -------------------------------------------------------------------------------------------------------


def card_terms(cards: DataFrame) -> DataFrame:
    """user_id, card_id, field, n, terms: what each field of a card is indexed under."""
    faces = cards.select("user_id", "card_id", F.explode(card_ops.faces(cards)).alias("field", "text")).where(F.length("text") > 0)
    return faces.select("user_id", "card_id", "field", X.term_counts(F.col("text")).alias("t")).select("user_id", "card_id", "field", "t.n", "t.terms")


def card_entities(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """cards: columns of rendering.CARD and source_ids; chunks: chunk_id, text. user_id, card_id, kind, value of problem, locate, implement
    and the cited chunks."""
    c = card_columns(cards)
    told = cards.select("user_id", "card_id", F.concat_ws("\n", c("problem"), c("locate"), c("implement")).alias("text"))
    cited = cards.select("user_id", "card_id", F.explode("source_ids").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id").select("user_id", "card_id", "text")
    found = told.unionByName(cited).select("user_id", "card_id", F.explode_outer(extraction.entities(F.col("text"), F.lit(True))).alias("e")).where("e IS NOT NULL")
    return found.select("user_id", "card_id", "e.kind", "e.value").distinct()


def card_anchors(cards: DataFrame) -> DataFrame:
    """user_id, card_id, kind, value (lower case): files, symbols and conditions."""
    c = card_columns(cards)
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))
    facts = F.transform(c("conditions"), lambda x: F.struct(x["type"].alias("kind"), F.lower(x["value"]).alias("value")))
    rows = cards.select("user_id", "card_id", F.explode(F.array_distinct(F.concat(tag("file", c("files")), tag("symbol", c("symbols")), facts))).alias("a"))
    return rows.select("user_id", "card_id", "a.kind", "a.value").where(F.length("value") > 0)


def index_rows(cards: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The card table and its term, entity and anchor rows, to be published together. Of rows with one key the last by created_at."""
    columns = [c for c in cards.columns if c not in ("user_id", "card_id")]
    newest = cards.groupBy("user_id", "card_id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "session_id")).alias("_r")).select("user_id", "card_id", "_r.*").select(*cards.columns)
    newest = retrieval.kept(newest)
    return {"cards": newest, "terms": card_terms(newest), "entities": card_entities(newest, chunks), "anchors": card_anchors(newest)}


# -- changes ----------------------------------------------------------------------------------------------------------


def closable(cards: DataFrame, sessions: DataFrame, version: str) -> DataFrame:
    """sessions: user_id, session_id. Adds conflict: the session has cards of another extraction version, which stay."""
    held = cards.where(F.col("extraction_version") != version).select("user_id", "session_id").distinct().withColumn("conflict", F.lit(True))
    return sessions.join(held, ["user_id", "session_id"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def finalised(tables: dict[str, DataFrame], new_cards: DataFrame, attempted: DataFrame, chunks: DataFrame, version: str) -> dict[str, DataFrame]:
    """tables: the live ones (cards, terms, entities, anchors, vectors, sessions). attempted: user_id, session_id of sessions whose extraction
    came to an end, with or without cards. Their old cards and index rows go, the new ones come in, and the sessions are marked; sessions with cards
    of another version stay as they are."""
    done = retrieval.kept(closable(tables["cards"], attempted.select("user_id", "session_id").distinct(), version).where("NOT conflict").drop("conflict"))
    gone = retrieval.kept(tables["cards"].join(done, ["user_id", "session_id"], "left_semi").select("user_id", "card_id"))
    fresh = index_rows(new_cards.join(done, ["user_id", "session_id"], "left_semi"), chunks)
    out = {}
    for name in CARD_TABLES:
        rest = tables[name].join(gone, ["user_id", "card_id"], "left_anti").select(*tables[name].columns)
        out[name] = rest.unionByName(fresh[name].select(*tables[name].columns)) if name in fresh else rest
    counts = fresh["cards"].groupBy("user_id", "session_id").agg(F.count("*").alias("_count"))
    marked = tables["sessions"].join(done.withColumn("_done", F.lit(True)), ["user_id", "session_id"], "left").join(counts, ["user_id", "session_id"], "left")
    marked = marked.withColumns({
        "status": F.when(F.col("_done"), F.lit("extracted")).otherwise(F.col("status")),
        "card_count": F.when(F.col("_done"), F.coalesce("_count", F.lit(0))).otherwise(F.col("card_count"))})
    return out | {"sessions": marked.select(*tables["sessions"].columns)}


def upserted(rows: DataFrame, new: DataFrame, key: tuple[str, ...] = ("user_id", "card_id", "model")) -> DataFrame:
    """rows with those of new in place of rows of the same key; of several new ones of a key the greatest."""
    rest = rows.join(new.select(*key).distinct(), list(key), "left_anti").select(*rows.columns)
    columns = [c for c in rows.columns if c not in key]
    return rest.unionByName(new.groupBy(*key).agg(F.max(F.struct(*columns)).alias("_r")).select(*key, "_r.*").select(*rows.columns))


def purged(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of users (user_id), and how many went: user_id, table, removed. Every user has a row for each table."""
    who = users.select("user_id").distinct()
    rest = {n: t.join(who, "user_id", "left_anti").select(*t.columns) for n, t in tables.items()}
    gone = None
    for name in (n for n in SCOPED if n in tables):
        one = who.join(tables[name].groupBy("user_id").agg(F.count("*").alias("removed")), "user_id", "left").select("user_id", F.lit(name).alias("table"), F.coalesce("removed", F.lit(0)).alias("removed"))
        gone = one if gone is None else gone.unionByName(one)
    return rest, gone


def claims(ingestions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """ingestions: user_id, request_id, content_hash, status, lease_expires; requests: user_id, request_id, content_hash, seq. Adds outcome: fresh,
    conflict (another body under the key), replay (committed before), in_progress (leased), takeover (failed, or its lease ran
    out). Of requests of one key in a job the first is judged by the store, later ones by it: conflict, or in_progress."""
    held = ingestions.select("user_id", "request_id", F.col("content_hash").alias("_hash"), F.col("status").alias("_status"), F.col("lease_expires").alias("_until"))
    rows = requests.join(held, ["user_id", "request_id"], "left")
    of = Window.partitionBy("user_id", "request_id").orderBy("seq")
    rows = rows.withColumn("_n", F.row_number().over(of)).withColumn("_first", F.coalesce("_hash", F.first("content_hash").over(of)))
    leased = (F.col("_status") == "processing") & (F.col("_until") > now)
    said = F.when(F.col("content_hash") != F.col("_first"), "conflict").when(F.col("_status") == "committed", "replay").when(F.coalesce(leased, F.lit(False)) | (F.col("_n") > 1), "in_progress")
    return rows.withColumn("outcome", said.when(F.col("_status").isNull(), "fresh").otherwise("takeover")).drop("_hash", "_status", "_until", "_n", "_first")


def lease_seconds(budget: Column) -> Column:
    return F.greatest(F.lit(float(LEASE_LEAST)), budget * LEASE_BUDGETS)


def lifecycle(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """chunks: user_id, session_id, seq; attempts: user_id, session_id, seq (how far the session was read), cards. One row per session: status,
    card_count, chunk_count. A session is extracted once an attempt has read its last chunk, even without cards; a later chunk opens
    it again."""
    per = chunks.groupBy("user_id", "session_id").agg(F.count("*").alias("chunk_count"), F.max("seq").alias("last"))
    done = attempts.groupBy("user_id", "session_id").agg(F.max("seq").alias("_read"), F.max_by("cards", "seq").alias("card_count"))
    rows = per.join(done, ["user_id", "session_id"], "left")
    return rows.select("user_id", "session_id", F.when(F.col("_read") >= F.col("last"), "extracted").otherwise("pending").alias("status"), F.coalesce("card_count", F.lit(0)).alias("card_count"), "chunk_count")


def own_evidence(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """cards: card_id, user_id, session_id, source_ids; chunks: chunk_id, user_id, session_id. The cards all of whose known sources are of their own
    user and session."""
    cited = cards.select("card_id", "user_id", "session_id", F.explode("source_ids").alias("chunk_id"))
    theirs = chunks.select("chunk_id", F.col("user_id").alias("_user"), F.col("session_id").alias("_session"))
    foreign = cited.join(theirs, "chunk_id").where("_user != user_id OR _session != session_id").select("card_id").distinct()
    return cards.join(foreign, "card_id", "left_anti")


# -- values -----------------------------------------------------------------------------------------------------------


def packed(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.arrow_udf(T.BinaryType())
    def pack(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else np.asarray(x, dtype="<f4").tobytes() for x in v.to_pylist()], pa.binary())

    return pack(vector)


def unpacked(blob: Column, dim: Column) -> Column:
    """packed() undone; null where the length isn't that of dim floats."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unpack(b):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, dtype="<f4") for x in b.to_pylist()], pa.list_(pa.float32()))

    return F.when((dim > 0) & (F.octet_length(blob) == dim * 4), unpack(blob))


def iso_seconds(at: Column) -> Column:
    """A time in UTC to the second, with a Z."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


PAYLOAD = """problem string, mechanism string, locate string, implement string, implement_shape string, implement_boundaries string, implement_acceptance string,
 source_chunk_ids array<string>, conditions array<struct<type:string,value:string>>, files array<string>, symbols array<string>, patch string, pitfalls array<string>"""
MOST = {"files": 8, "symbols": 12, "pitfalls": 3}


def payload(cards: DataFrame) -> Column:
    """A card as JSON, without what it lacks."""
    c = card_columns(cards)
    names = {"implement_shape": "shape", "implement_boundaries": "boundaries", "implement_acceptance": "acceptance"}
    texts = [F.nullif(c(names.get(n, n)), F.lit("")).alias(n) for n in ("problem", "mechanism", "locate", "implement", *names, "patch")]
    lists = [F.when(F.size(c(n)) > 0, c(n)).alias(n) for n in (*MOST, "conditions")]
    sources = [F.col("source_ids").alias("source_chunk_ids")] if "source_ids" in cards.columns else []
    return F.to_json(F.struct(*texts, *lists, *sources), {"ignoreNullFields": "true"})


def from_payload(json: Column) -> Column:
    """payload() undone, as a struct: lists of distinct trimmed texts up to their most, conditions of known types. Null where there is no JSON
    object."""
    p = F.from_json(json, PAYLOAD)
    text = lambda n: F.nullif(F.trim(p[n]), F.lit("")).alias(n)
    clean = lambda n, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(p[n], F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.length(v) > 0)), 1, most).alias(n)
    known = F.filter(F.coalesce(p["conditions"], F.array().cast("array<struct<type:string,value:string>>")), lambda x: x["type"].isin(card_ops.CONDITION_TYPES))
    return F.struct(*[text(n) for n in ("problem", "mechanism", "locate", "implement", "implement_shape", "implement_boundaries", "implement_acceptance")], *[clean(n, m) for n, m in MOST.items()], known.alias("conditions"), p["patch"].alias("patch"),
                    F.filter(F.coalesce(p["source_chunk_ids"], F.array().cast("array<string>")), lambda v: F.length(v) > 0).alias("source_ids"))


def unescaped(literal: Column) -> Column:
    """The inside of a JSON string, decoded; where it doesn't parse only its quotes are."""
    decoded = F.from_json(F.concat(F.lit('{"v":"'), literal, F.lit('"}')), "v string", {"mode": "PERMISSIVE"})["v"]
    return F.coalesce(decoded, F.regexp_replace(literal, r'\\"', '"'))


def authorised(authorization: Column, api_key: Column, expected: str | None) -> Column:
    """Whether a request shows the configured key, as a bearer or token, or (without one) as an API key; all do where none is configured."""
    if not expected:
        return F.lit(True)
    scheme = F.lower(F.split(F.coalesce(authorization, F.lit("")), " ", 2)[0])
    rest = F.regexp_extract(F.coalesce(authorization, F.lit("")), r"^\S* ?(.*)$", 1)
    shown = F.when(scheme.isin("bearer", "token"), F.trim(rest)).otherwise(F.nullif(F.trim(api_key), F.lit("")))
    return F.coalesce(shown == expected, F.lit(False))


STATUS = {"shape": 422, "conflict": 400, "in_progress": 409, "model_unavailable": 503, "unauthorised": 401}


def http_status(reason: Column) -> Column:
    """200 without a reason; those of STATUS by name, any other reason is a value that was refused."""
    out = F.when(reason.isNull(), F.lit(200))
    for name, status in STATUS.items():
        out = out.when(reason == name, status)
    return out.otherwise(F.lit(400))


def retry_after(status: Column) -> Column:
    """Seconds, for what may be tried again."""
    return F.when(status.isin(409, 503), F.lit(2))
