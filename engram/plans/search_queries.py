"""Search from a query's text to its response, each step as a query of its own. Ids in brackets name the operators of the inventory."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import retrieval, search, selection, store
from engram.plans.registry import documents, query
from engram.sources.tables import table

# -- the corpus of the flagship: documents as cards of two fields, with entities, anchors and vectors ------------------

_WEIGHTS = {"problem": 1.0, "locate": 1.0, "implement": 0.5, "mechanism": 0.6, "test": 0.8}
_ASKED_SQL = "SELECT item_id, text || ' see lib/src' || (item_id % 20) || '.py for #1' || (item_id % 40) AS text, 'src' || ((item_id + 7) % 20) || '.py' AS option FROM benchmark"
_STOP = f"{X.STOPWORDS!r}"


def _content(tokens: str) -> str:
    return f"list_filter(list_distinct({tokens}), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _path(source: Column) -> Column:
    return F.concat(F.lit("lib/"), source, F.lit(".py"))


def _asked(spark, sf) -> DataFrame:
    b, number = table(spark, sf, "benchmark"), lambda k: (F.col("item_id") % k).cast("string")
    text = F.concat("text", F.lit(" see "), _path(F.concat(F.lit("src"), number(20))), F.lit(" for #1"), number(40))
    option = F.concat(F.lit("B) src"), ((F.col("item_id") + 7) % 20).cast("string"), F.lit(".py"))
    return b.select(F.lit("all").alias("scope"), F.col("item_id").alias("query_id"), text.alias("text"), F.array(option).alias("options"))


def _corpus(spark, sf) -> dict[str, DataFrame]:
    d, one = documents(spark, sf), table(spark, sf, "documents")
    row = lambda rows, *c: rows.select(F.lit("all").alias("scope"), F.col("doc_id").alias("item_id"), *c)
    field = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("text"))
    faces = row(d, F.explode(F.array(field("problem", F.col("text")), field("locate", _path(F.col("source"))))).alias("f")).select("scope", "item_id", "f.field", "f.text")
    tagged = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs])).alias("e")
    entities = row(one.where("doc_id % 2 = 0"), tagged(("path", _path(F.col("source"))), ("config_key", F.concat("source", F.lit(".py")))))
    anchors = row(one, tagged(("file", F.when(F.col("doc_id") % 3 == 0, _path(F.col("source")))), ("issue", F.concat(F.lit("#1"), (F.col("doc_id") % 40).cast("string")))))
    flat = lambda rows: rows.select("scope", "item_id", "e.kind", "e.value").where("value IS NOT NULL")
    return {
        "faces": retrieval.index_face(faces), "entities": flat(entities), "anchor_index": flat(anchors), "items": row(one, (F.col("doc_id") % 2 == 0).alias("has_files")),
        "vectors": table(spark, sf, "embeddings").select(F.lit("all").alias("scope"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))}


def _pool(spark, sf) -> DataFrame:
    asked = search.features(_asked(spark, sf))
    qv = table(spark, sf, "embeddings").join(table(spark, sf, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id"), "left_semi")
    corpus = _corpus(spark, sf)
    scored = search.channels(asked, query_vectors=qv.select(F.lit("all").alias("scope"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), **corpus)
    return search.pool(asked, scored, corpus["items"])


_POOL = f"""a AS ({_ASKED_SQL}),
fa AS (SELECT doc_id, 'problem' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'locate', 'lib/' || source || '.py' FROM documents),
tk AS MATERIALIZED (SELECT doc_id, field, {X.sql_tokens('t')} AS ts FROM fa),
terms AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, field, unnest(ts) AS term FROM tk) GROUP BY ALL),
dls AS (SELECT doc_id, sum(len(ts)) AS dl FROM tk GROUP BY doc_id),
stats AS (SELECT count(*) AS n, avg(CASE WHEN dl > 0 THEN dl END) AS avgdl FROM dls),
dfs AS (SELECT field, term, count(*) AS df FROM terms GROUP BY ALL),
fields(field) AS (VALUES ('problem'), ('locate')),
qt AS (SELECT 'field' AS channel, item_id, field, term, 1.0 AS w FROM (SELECT item_id, unnest({_content(X.sql_tokens('text'))}) AS term FROM a), fields
  UNION ALL SELECT 'field', item_id, 'locate', unnest({X.sql_tokens("'lib/src' || (item_id % 20) || '.py'")}), 1.6 FROM a
  UNION ALL SELECT 'options_field', item_id, field, term, 1.0 FROM (SELECT item_id, unnest({_content(X.sql_tokens('option'))}) AS term FROM a), fields),
qw AS (SELECT channel, item_id, field, term, max(w) AS w FROM qt GROUP BY ALL),
bm AS (SELECT channel, item_id, doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score
  FROM qw JOIN terms USING (field, term) JOIN dfs USING (field, term) JOIN dls USING (doc_id), stats GROUP BY ALL),
en AS (SELECT doc_id, unnest(['lib/' || source || '.py', source || '.py']) AS value FROM documents WHERE doc_id % 2 = 0),
qe AS (SELECT 'entity' AS channel, item_id, unnest(['lib/src' || (item_id % 20) || '.py', 'src' || (item_id % 20) || '.py']) AS value FROM a UNION ALL SELECT 'options_entity', item_id, option FROM a),
eh AS (SELECT channel, item_id, doc_id, count(DISTINCT value)::DOUBLE AS score FROM qe JOIN en USING (value) GROUP BY ALL),
an AS (SELECT doc_id, 'file' AS kind, 'lib/' || source || '.py' AS value FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'issue', '#1' || (doc_id % 40) FROM documents),
ad AS (SELECT kind, value, count(*) AS df FROM an GROUP BY ALL), nn AS (SELECT count(*) AS n FROM documents),
qa AS (SELECT item_id, 'file' AS kind, 'lib/src' || (item_id % 20) || '.py' AS value FROM a UNION ALL SELECT item_id, 'issue', '#1' || (item_id % 40) FROM a),
ah AS (SELECT 'anchor' AS channel, item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * CASE kind WHEN 'file' THEN 1.3 ELSE 1.1 END) AS score FROM qa JOIN an USING (kind, value) JOIN ad USING (kind, value), nn GROUP BY ALL),
vh AS (SELECT 'vector' AS channel, q.vec_id AS item_id, v.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id IN (SELECT item_id FROM benchmark)),
every AS (SELECT * FROM bm UNION ALL SELECT * FROM eh UNION ALL SELECT * FROM ah UNION ALL SELECT * FROM vh),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel, item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM every QUALIFY r <= 400),
w(channel, w) AS (VALUES ('field', 1.0), ('entity', 0.8), ('vector', 1.0), ('anchor', 1.2), ('options_field', 0.35), ('options_entity', 0.35)),
fused AS (SELECT item_id, doc_id, sum(w::DOUBLE / (60 + r)) AS f, min(r) FILTER (channel = 'entity') AS re, min(r) FILTER (channel = 'anchor') AS ra, min(r) FILTER (channel = 'field') AS rf, min(r) FILTER (channel = 'vector') AS rv
  FROM ranked JOIN w USING (channel) GROUP BY ALL),
fill AS (SELECT item_id, doc_id FROM a, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200)),
pooled AS (SELECT item_id, doc_id, coalesce(f, 0.0) AS f, re, ra, rf, rv FROM fused FULL JOIN fill USING (item_id, doc_id)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(f, 0.0), 9) DESC, doc_id) <= 200),
boosted AS (SELECT item_id, doc_id, f + 0.004 * (coalesce(1.0 / (1 + ln(1 + re)), 0) + coalesce(1.2 / (1 + ln(1 + ra)), 0) + coalesce(0.7 / (1 + ln(1 + rf)), 0)
  - CASE WHEN re IS NULL AND ra IS NULL AND rf IS NULL AND rv IS NULL THEN 1.5 ELSE 0 END + 0.4 + CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM documents) THEN 0.3 ELSE 0 END) AS score FROM pooled),
pl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM boosted)"""


@query(rf"""WITH {_POOL},
once AS (SELECT item_id, doc_id, score, rank FROM pl JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY rank) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place, max(score) OVER (PARTITION BY item_id) AS best FROM once)
SELECT item_id, place::INTEGER AS rank, doc_id, round(score, 6) AS score FROM placed WHERE place <= 10 AND (score >= 0.15 * best OR place <= 2)""")
def flagship_search(spark, sf):
    """[R1-R9, O2, O3, P3, P25, J1, J7] For each benchmark passage: features, six channels (field, entity, anchor and vector of the text;
    field and entity of its options), fusion, the pool filled in, boosts, selection, final cut, floor. Vectors without a document go
    where texts are joined."""
    ranked = retrieval.kept(_pool(spark, sf))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", F.lit(None).cast("array<string>").alias("files"))
    few, _ = retrieval.small(ranked)
    chosen = search.selected(texts.join(few, "item_id"), limit=20)
    best = chosen.withColumn("rank", F.col("position")).where(F.col("position") <= selection.effective_top_k(F.lit(10)))
    return selection.admit(best).select(F.col("query_id").alias("item_id"), "rank", F.col("item_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_POOL} SELECT item_id, channel, count(*) AS hits FROM ranked GROUP BY ALL")
def channel_hits(spark, sf):
    """[A13, D1, O1]"""
    asked = search.features(_asked(spark, sf))
    qv = table(spark, sf, "embeddings").join(table(spark, sf, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id"), "left_semi")
    scored = search.channels(asked, query_vectors=qv.select(F.lit("all").alias("scope"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), **_corpus(spark, sf))
    return retrieval.rank_lists(scored).groupBy(F.col("query_id").alias("item_id"), "channel").agg(F.count("*").alias("hits"))


@query(f"""WITH a AS ({_ASKED_SQL}) SELECT item_id, list_sort({_content(X.sql_tokens('text'))}) AS terms, list_sort({_content(X.sql_tokens('option'))}) AS option_terms,
 ['config_key=src' || (item_id % 20) || '.py', 'path=lib/src' || (item_id % 20) || '.py'] AS entities,
 list_sort(['config=src' || (item_id % 20) || '.py', 'file=lib/src' || (item_id % 20) || '.py', 'issue=#1' || (item_id % 40), 'module=lib/src' || (item_id % 20) || '.py']) AS anchors FROM a""")
def query_features(spark, sf):
    """[F13, R19, R5, P7, P10, F12, F31]"""
    f = search.features(_asked(spark, sf)).withColumn("mapped", search.anchor_terms(F.col("anchors")))
    said = lambda c: F.array_sort(F.transform(c, lambda e: F.concat_ws("=", e["kind"], e["value"])))
    return f.select(F.col("query_id").alias("item_id"), F.array_sort("terms").alias("terms"), F.array_sort("option_terms").alias("option_terms"), said("entities").alias("entities"), said("mapped").alias("anchors"))


@query("""WITH d AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY rank) AS n FROM d WHERE rank <= 200),
p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY rank) AS position FROM o WHERE n = 1) SELECT source, doc_id, position::INTEGER AS position FROM p WHERE position <= 20""")
def complementary_selection(spark, sf):
    """[R9, D4] The documents of each source in order of id as its ranked list."""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), (-F.col("doc_id").cast("double")).alias("score"), "text")
    ranked = retrieval.top(d, ["query_id"], retrieval.POOL_SIZE).withColumn("files", F.array().cast("array<string>"))
    return search.selected(ranked, limit=20).select(F.col("query_id").alias("source"), F.col("item_id").alias("doc_id"), "position")


_HEAD = "'[历史修复案例] · debug' || chr(10) || '问题：' || p_name"


@query(f"""WITH c AS (SELECT p_brand AS query_id, p_partkey AS item_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, 1.0 / (1 + p_size) AS score, {_HEAD} AS t FROM part),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, floor(length(t) / 3.2)::INTEGER + 1 AS k FROM c WHERE position <= 30),
i AS (SELECT query_id, item_id, score, t, position FROM b WHERE score >= 0.15 * best)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place, t AS content, round(score, 6) AS score FROM i""")
def response_items(spark, sf):
    """[R15, P24, F18] Cards with a problem alone, thirty of each brand; no seat is given by right, and the whole fits the cap."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("item_id"), (1.0 / (1 + F.col("p_size"))).alias("score"), F.col("p_name").alias("problem"), "p_size")
    rows = retrieval.top(p.withColumn("order", -F.col("item_id").cast("double")), ["query_id"], 30, score="order").withColumnRenamed("rank", "position").drop("order", "p_size")
    out = search.assembled(rows, least_items=0)
    return out.where("place IS NOT NULL").select("query_id", "item_id", "place", "content", "score")


@query("""WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE length(trim(text)) >= 40 AND role = 'assistant'),
q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS ws FROM benchmark),
s AS (SELECT q.item_id, c.conv_id, c.turn, c.t, len(list_filter(ws, lambda w: contains(lower(c.t), w))) / (1.0 + length(c.t) / 2000.0) AS score, len(list_filter(ws, lambda w: contains(lower(c.t), w))) AS n FROM q JOIN c ON c.conv_id % 40 = q.item_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, conv_id, substr(regexp_replace(lower(t), '\\s+', ' ', 'g'), 1, 80) ORDER BY turn) AS d FROM s WHERE n >= 2 OR regexp_matches(t, '(?m)^\\s*(FAILED|E\\s+|\\d+\\s+(passed|failed))')),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, conv_id ORDER BY score DESC, turn) AS k FROM o WHERE d = 1)
SELECT item_id, conv_id, list(substr(t, 1, 200) ORDER BY k) AS evidence FROM r WHERE k <= 3 GROUP BY ALL""")
def evidence_snippets(spark, sf):
    """[O8] The chunks of a card are its conversation's turns, those of the assistant being logs."""
    c = table(spark, sf, "conversations")
    chunks = c.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.when(F.col("role") == "assistant", "log").otherwise("prose").alias("kind"), "text")
    ids = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat_ws(":", "conv_id", t))
    cards = c.groupBy("conv_id").agg(ids.alias("source_ids")).select((F.col("conv_id") % 40).alias("query_id"), F.col("conv_id").alias("item_id"), "source_ids")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("terms"), F.array().cast("array<struct<kind:string,value:string>>").alias("anchors"))
    return search.snippets(cards, chunks, asked, 3).select(F.col("query_id").alias("item_id"), F.col("item_id").alias("conv_id"), "evidence")


@query(f"""WITH {_POOL}, j AS (SELECT item_id, doc_id, score FROM pl JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) <= 20),
v AS (SELECT item_id, doc_id, score + CASE WHEN doc_id % 40 <> item_id THEN 0 WHEN doc_id % 3 = 0 THEN 0.010 * 0.75 WHEN doc_id % 3 = 1 THEN 0.010 * 0.35 * 0.75 ELSE 0 END AS score FROM j),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM v),
s AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM p WHERE position <= 10)
SELECT item_id AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY item_id ORDER BY position) AS place, '[历史修复案例] · debug' || chr(10) || '问题：case ' || doc_id AS content, round(score, 6) AS score FROM s WHERE score >= 0.15 * best OR position <= 2""")
def search_responses(spark, sf):
    """[R7, R10, R15, R18, R21] From each benchmark passage to its response: all channels, a judge who has seen one in forty of all pairs, final cut,
    floor, rendered cards."""
    qv = table(spark, sf, "embeddings").join(table(spark, sf, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id"), "left_semi")
    told = F.concat(F.lit("case "), F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents")
    cards = d.select(F.col("doc_id").alias("item_id"), told.alias("text"), told.alias("problem"), F.array().cast("array<string>").alias("files"))
    said = F.when(F.col("doc_id") % 3 == 0, "yes").when(F.col("doc_id") % 3 == 1, "unknown").otherwise("no")
    verdicts = d.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item_id"), said.alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    qv = qv.select(F.lit("all").alias("scope"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return search.respond(_asked(spark, sf), _corpus(spark, sf), cards, query_vectors=qv, verdicts=verdicts)


@query("""SELECT s_nationkey AS query_id, p_partkey AS item_id, p_name AS problem, 'text ' || p_partkey AS cited FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_size % 5 <> 0""")
def materialised_pools(spark, sf):
    """[R7, J7, S10, S12] Suppliers are pools of their nation; every fifth card's payload is broken, and cards cite a chunk that is there and one that isn't."""
    p = table(spark, sf, "part").withColumn("source_ids", F.array(F.concat(F.lit("c"), F.col("p_partkey").cast("string")), F.lit("gone"))).withColumn("problem", F.col("p_name"))
    cards = p.select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 5 == 0, "{broken").otherwise(store.payload(p)).alias("payload"), F.lit("2024-01-01").alias("created_at"))
    chunks = p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat(F.lit("text "), F.col("p_partkey").cast("string")).alias("text"))
    ranked = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").cast("long").alias("item_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    out = search.materialised(ranked, cards, chunks)
    return out.select("query_id", "item_id", "problem", F.array_join(F.map_values("cited"), ",").alias("cited"))
