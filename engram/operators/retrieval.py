"""Recall channels over a table of queries, rank fusion and rank boosts.

Every operator takes all queries of a job as one table. Query terms are the small side: they are broadcast where they are
measured to be small, and rows of the index that match no query term go before anything is shuffled. Scores are rounded to 9 digits before a cut, so that
the order of float sums never decides a rank; ties go to the smaller id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.session import ensure_checkpoint_dir

# Fixed values of the ranking.
K1, B, RRF_K = 1.2, 0.75, 60
CHANNEL_QUOTA, POOL_SIZE = 400, 200
FIELD_WEIGHTS = {"problem": 1.0, "locate": 1.0, "implement": 0.5, "mechanism": 0.6, "test": 0.8}
PLAIN_TERM_WEIGHT, ANCHOR_BOOST = 0.25, 1.6
CHANNEL_WEIGHTS = {"field": 1.0, "entity": 0.8, "vector": 1.0, "anchor": 1.2, "options_field": 0.35, "options_entity": 0.35}
ANCHOR_WEIGHTS = {"file": 1.3, "symbol": 1.4, "error": 1.6, "issue": 1.1, "module": 1.0, "version": 1.0, "config": 0.8, "test_name": 1.2}
BOOST_SCALE = 0.004


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: what several branches read is computed once and outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def top(scored: DataFrame, by: list[str], k: int, item: str = "item_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows of short strings and numbers: some 20 MB as a hashed relation.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows written down, and whether they are few and short enough to be broadcast (measured); if so they are marked for it."""
    rows = kept(rows)
    size = F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))
    n, length = rows.limit(BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    few = n <= BROADCAST_ROWS and (length or 0) <= BROADCAST_BYTES
    return (F.broadcast(rows) if few else rows), few


TERMS = "array<struct<term:string,tf:int>>"


def index_face(docs: DataFrame) -> DataFrame:
    """docs: scope, item_id, field, text. Adds n (tokens) and terms (term, tf) in place of text: what a term index holds."""
    return docs.select("scope", "item_id", "field", X.term_counts(F.col("text")).alias("t")).select("scope", "item_id", "field", "t.n", "t.terms")


def bm25(faces: DataFrame, queries: DataFrame) -> DataFrame:
    """faces: scope, item_id, field, n, terms (index_face); queries: scope, query_id, field, term, weight, each term once per
    field. Returns scope, query_id, item_id, score. An item's length counts tokens of all its fields; the number of items counts
    those without tokens too, the mean length doesn't; a term's document frequency is that of its field.

    Terms are counted within their row, so only postings of asked terms are ever shuffled. Where the asked terms are few, faces
    are read once: each row adds a posting without a term that carries its length past the broadcast join."""
    asked, few = small(queries.select("scope", "field", "term").distinct().withColumn("hit", F.lit(True)))
    if few:
        length = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("n").alias("tf")))
        both = faces.select("scope", "item_id", "field", F.explode(F.concat("terms", length)).alias("t")).select("scope", "item_id", "field", "t.term", "t.tf")
        both = kept(both.join(asked, ["scope", "field", "term"], "left").where("hit OR term IS NULL").drop("hit"))
        lengths, tf = both.where("term IS NULL"), both.where("term IS NOT NULL")
    else:
        faces = kept(faces)
        lengths = faces.select("scope", "item_id", F.col("n").alias("tf"))
        tf = faces.select("scope", "item_id", "field", F.explode("terms").alias("t")).select("scope", "item_id", "field", "t.term", "t.tf")
        tf = tf.join(asked, ["scope", "field", "term"], "left_semi")
    per_item = lengths.groupBy("scope", "item_id").agg(F.sum("tf").alias("dl"))
    scopes = per_item.groupBy("scope").agg(F.count("*").alias("items"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
    df = tf.groupBy("scope", "field", "term").agg(F.count("*").alias("df"))
    terms = df.join(scopes, "scope").withColumn("idf", F.log1p((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed, _ = small(queries.join(terms, ["scope", "field", "term"]).select("scope", "query_id", "field", "term", "weight", "idf", "avgdl"))
    tf_norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.col("avgdl")))
    rows = tf.join(per_item, ["scope", "item_id"]).join(weighed, ["scope", "field", "term"])
    return rows.groupBy("scope", "query_id", "item_id").agg(F.sum(F.col("weight") * F.col("idf") * tf_norm).alias("score"))


#: The field of terms that cards without fields are indexed under.
PLAIN = ""
ANCHOR_FIELDS = {"error": "problem", "path": "locate", "symbol": "locate", "test_name": "test"}


def query_terms(queries: DataFrame, fields: dict[str, float] | None = None, terms: str | None = None, boosted: str | None = None) -> DataFrame:
    """queries: scope, query_id, and text, or the column `terms` (array) in its place; the column `boosted` holds a query's anchors
    as (kind, value). One row per field and term with the field's weight: a term counts once however often it occurs. Terms also
    ask the PLAIN field, at PLAIN_TERM_WEIGHT; those of an anchor weigh ANCHOR_BOOST times as much in their kind's field."""
    weights = {**(fields or FIELD_WEIGHTS)}
    if fields is None:
        weights[PLAIN] = PLAIN_TERM_WEIGHT
    faces = lambda w: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("weight")) for f, v in w.items()])).alias("face")
    own = F.array_distinct(F.col(terms)) if terms else X.term_counts(F.col("text"))["terms"]["term"]
    out = queries.select("scope", "query_id", own.alias("terms")).select("scope", "query_id", F.explode("terms").alias("term"))
    out = out.select("scope", "query_id", "term", faces(weights)).select("scope", "query_id", "face.field", "term", "face.weight")
    if boosted:
        more = queries.select("scope", "query_id", F.explode(boosted).alias("a")).select("scope", "query_id", "a.kind", X.term_counts(F.col("a.value"))["terms"]["term"].alias("terms"))
        more = more.select("scope", "query_id", "kind", F.explode("terms").alias("term"))
        field = F.create_map(*[F.lit(x) for kv in ANCHOR_FIELDS.items() for x in kv])[F.col("kind")]
        weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w * ANCHOR_BOOST)])[F.col("field")]
        more = more.withColumn("field", field).where("field IS NOT NULL").withColumn("weight", weight).where("weight IS NOT NULL")
        out = out.unionByName(more.select("scope", "query_id", "field", "term", "weight")).groupBy("scope", "query_id", "field", "term").agg(F.max("weight").alias("weight"))
    return out


def entity_hits(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """entities: scope, item_id, kind, value; asked: scope, query_id, value. Different values that match, whatever their kind."""
    return entities.select("scope", "item_id", "value").join(asked.select("scope", "query_id", "value").distinct(), ["scope", "value"]).groupBy(
        "scope", "query_id", "item_id").agg(F.countDistinct("value").cast("double").alias("score"))


def anchor_scores(anchors: DataFrame, asked: DataFrame, items: DataFrame) -> DataFrame:
    """anchors: scope, item_id, kind, value; asked: scope, query_id, kind, value; items: scope, item_id. Kind and value match,
    without case and surrounding blanks; each match adds its inverse document frequency times its kind's weight."""
    norm = lambda d, *c: d.select("scope", *c, "kind", F.lower(F.trim("value")).alias("value")).distinct()
    a, q = norm(anchors, "item_id"), norm(asked, "query_id")
    n = items.groupBy("scope").agg(F.count("*").alias("items"))
    df = a.groupBy("scope", "kind", "value").agg(F.count("*").alias("df")).join(n, "scope")
    weights = F.create_map(*[F.lit(x) for kv in ANCHOR_WEIGHTS.items() for x in kv])
    idf = F.log1p((F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.coalesce(weights[F.col("kind")], F.lit(1.0))
    terms = q.join(df, ["scope", "kind", "value"]).withColumn("w", idf)
    return a.join(terms, ["scope", "kind", "value"]).groupBy("scope", "query_id", "item_id").agg(F.sum("w").alias("score"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """In double and to length 1; null where the length is zero."""
    x = vector.cast("array<double>")
    norm = F.sqrt(_dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda c: c / norm))


def cosine(a: Column, b: Column) -> Column:
    """In double; null where a norm is zero or the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), _dot(x, y) / norm)


#: Parts that the vectors of a scope are dealt into where the queries are too many to be broadcast.
SCOPE_PARTS = 32


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vectors: scope, item_id, vec; queries: scope, query_id, qvec. Vectors of one scope only meet queries of the same. Each norm is
    taken once; where the queries are few the vectors stay where they are, else each scope is dealt into parts, so that a large one
    is no single task."""
    rows = vectors.select("scope", "item_id", unit(F.col("vec")).alias("x")).where("x IS NOT NULL")
    asked, few = small(queries.select("scope", "query_id", unit(F.col("qvec")).alias("q")).where("q IS NOT NULL"))
    if few:
        pairs = rows.join(asked, "scope")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SCOPE_PARTS - 1))).alias("part")
        pairs = rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(SCOPE_PARTS)).cast("int")).join(asked.select("*", every), ["scope", "part"])
    return pairs.where(F.size("x") == F.size("q")).select("scope", "query_id", "item_id", _dot(F.col("x"), F.col("q")).alias("score"))


def rank_lists(channels: dict[str, DataFrame], k: int = CHANNEL_QUOTA) -> DataFrame:
    """query_id, item_id, channel, rank: the k best of each channel."""
    out = None
    for name, scored in channels.items():
        ranked = top(scored, ["query_id"], k).select("query_id", "item_id", F.lit(name).alias("channel"), "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: query_id, item_id, fused, ranks (map of channel to rank). Channels without a positive
    weight add nothing, but their items stay."""
    table = F.create_map(*[F.lit(x) for kv in (weights or CHANNEL_WEIGHTS).items() for x in kv])
    w = F.greatest(F.coalesce(table[F.col("channel")], F.lit(0.0)), F.lit(0.0))
    return ranked.groupBy("query_id", "item_id").agg(
        F.sum(w / (F.lit(RRF_K) + F.col("rank"))).alias("fused"), F.map_from_entries(F.collect_list(F.struct("channel", "rank"))).alias("ranks"))


def with_all_items(fused: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Items that no channel found enter with 0. queries and items carry a scope, so a query meets its own scope's items."""
    every = queries.select("scope", "query_id").join(items.select("scope", "item_id"), "scope").drop("scope")
    return every.join(fused, ["query_id", "item_id"], "left").withColumn("fused", F.coalesce("fused", F.lit(0.0)))


def fill_items(queries: DataFrame, items: DataFrame, most: int = POOL_SIZE) -> DataFrame:
    """query_id, item_id: the `most` newest items of each query's scope, which enter a pool with 0 where no channel found them. items may
    have a column newness; ties and tables without it go by item_id. A scope gives `most` rows before it meets its queries."""
    order = Window.partitionBy("scope").orderBy(*([F.desc("newness")] if "newness" in items.columns else []), "item_id")
    newest = items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("scope", "item_id")
    return queries.select("scope", "query_id").distinct().join(newest, "scope").select("query_id", "item_id")


def boost(ranks: Column, has_patch: Column, has_files: Column) -> Column:
    """What rank and form of a card add to its fused score."""
    term = lambda channel, top_: F.coalesce(F.lit(top_) / (1.0 + F.log1p(ranks[channel])), F.lit(0.0))
    found = F.coalesce(ranks["field"], ranks["entity"], ranks["anchor"], ranks["vector"])
    missed = F.when(found.isNull(), F.lit(-1.5)).otherwise(F.lit(0.0))
    form = F.when(has_patch, F.lit(0.8)).when(has_files, F.lit(0.3)).otherwise(F.lit(0.0))
    return F.lit(BOOST_SCALE) * (term("entity", 1.0) + term("anchor", 1.2) + term("field", 0.7) + missed + F.lit(0.4) + form)


def word_overlap(sessions: DataFrame, queries: DataFrame) -> DataFrame:
    """sessions: session_id, text (any number of rows each); queries: query_id, words (distinct, of [a-z0-9_], three characters or more).
    query_id, session_id, ratio: the share of a query's words that occur anywhere in a session's text, parts of longer words
    included; pairs without any don't appear. An occurrence lies within one run of word characters, so the distinct
    runs meet the distinct query words by three-character parts, and nothing is compared with everything."""
    runs = sessions.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0)))).alias("run")).distinct()
    words = queries.select("query_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    parts = lambda run: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(run) - 2), lambda i: F.substr(run, i, F.lit(3))))
    by_part = runs.select("run").distinct().select("run", F.explode(parts(F.col("run"))).alias("part"))
    wanted = words.select("word", F.substring("word", 1, 3).alias("part")).distinct()
    held = by_part.join(wanted, "part").where(F.col("run").contains(F.col("word"))).select("run", "word")
    found = runs.join(held, "run").select("session_id", "word").distinct()
    hits = found.join(words, "word").groupBy("query_id", "session_id").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    return hits.select("query_id", "session_id", (F.col("hits") / F.col("n")).alias("ratio"))
