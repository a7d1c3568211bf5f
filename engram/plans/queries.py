"""One query per operator on the driver's tables, each with the SQL that DuckDB checks it by where SQL can express it.

Mapping: conversations are messages (user = conv_id modulo 8, session = conv_id, message index = turn), documents are
cards with one field, benchmark passages are search queries, embeddings are card vectors, events are requests and load
samples, labels are verdicts. Ids in brackets name the operators of the inventory.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.operators import cards, chunking, evidence, extraction, health, ingest, rendering, retrieval, selection
from engram.sources import models
from engram.plans.registry import FILE as _FILE
from engram.plans.registry import ORACLES, QUERIES, query
from engram.plans.registry import PATCH as _PATCH
from engram.plans.registry import documents as _documents
from engram.plans.registry import events as _events
from engram.plans.registry import messages as _messages
from engram.plans.registry import parts as _parts
from engram.plans.registry import patch as _patch
from engram.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


# -- A: texts ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({X.sql_latin('text')}) AS term FROM documents) GROUP BY doc_id, term")
def term_frequency(spark, sf):
    """[F2, F29, A1]"""
    counts = _documents(spark, sf).select("doc_id", X.term_counts(F.col("text"), latin_only=True).alias("t"))
    return counts.select("doc_id", F.explode("t.terms").alias("t")).select("doc_id", "t.term", F.col("t.tf").cast("long").alias("tf"))


@query(f"SELECT page_id, unnest({X.sql_paths('url')}) AS token FROM pages")
def tokenize_paths(spark, sf):
    """[F4]"""
    return table(spark, sf, "pages").select("page_id", F.explode(X.path_tokens(F.col("url"))).alias("token"))


@query("""WITH t AS (SELECT p_partkey, substr('检索记忆系统的历史经验与修复案例', p_size % 9 + 1, p_size % 6) || p_name || substr('测试验证', 1, p_size % 4) AS t FROM part),
r AS (SELECT p_partkey, unnest(regexp_extract_all(t, '[一-鿿]+')) AS run FROM t)
SELECT p_partkey, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END) AS bigram FROM r""")
def cjk_bigrams(spark, sf):
    """[F3]"""
    text = F.concat(F.expr("substr('检索记忆系统的历史经验与修复案例', p_size % 9 + 1, p_size % 6)"), F.col("p_name"), F.expr("substr('测试验证', 1, p_size % 4)"))
    return table(spark, sf, "part").select("p_partkey", F.explode(X.cjk_bigrams(text)).alias("bigram"))


@query(f"""WITH d AS (SELECT doc_id, lang, len({X.sql_tokens('text')})::BIGINT AS dl FROM documents)
SELECT doc_id, dl, round(avg(dl) OVER (PARTITION BY lang), 6) AS avgdl, count(*) OVER (PARTITION BY lang) AS items FROM d""")
def doc_length(spark, sf):
    """[A2, A3, A4]"""
    d = _documents(spark, sf).select("doc_id", "lang", X.term_counts(F.col("text"))["n"].cast("long").alias("dl"))
    d = retrieval.kept(d)
    of = d.groupBy("lang").agg(F.round(F.avg("dl"), 6).alias("avgdl"), F.count("*").alias("items"))
    return d.join(of, "lang").select("doc_id", "dl", "avgdl", "items")


@query(f"""SELECT item_id, list_filter(list_distinct({X.sql_latin('text')}), lambda t: length(t) >= 2 AND NOT list_contains({X.STOPWORDS!r}, t)).list_sort() AS terms FROM benchmark""")
def content_tokens(spark, sf):
    """[P5, A19]"""
    return table(spark, sf, "benchmark").select("item_id", F.array_sort(X.content_tokens(X.latin_tokens(F.col("text")))).alias("terms"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?s)<!--.*?-->', ' ', 'g'), '(?i)\b(?:https?|ftp)://\S+', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*[-*]\s*\[[ xX]\]\s*.*$', '', 'g'),
 '(?mi)^\s*(?:##\s*(?:PR summary|PR checklist|Checklist|Description)\s*)$', '', 'g'), '</?[A-Za-z][^>\n]{0,80}>', ' ', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'),
 '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM pages""")
def denoise_pages(spark, sf):
    """[P6, P7]"""
    return table(spark, sf, "pages").select("page_id", X.denoise(F.col("html")).alias("clean"))


@query("""WITH t AS (SELECT p_partkey, '<!-- ' || p_name || ' -->' || substr('a longer text that stays as it is', 1, p_size) AS t FROM part)
SELECT p_partkey, CASE WHEN length(trim(regexp_replace(t, '<!--.*?-->', ' '))) < 20 THEN t ELSE trim(regexp_replace(t, '<!--.*?-->', ' ')) END AS used FROM t""")
def denoise_fallback(spark, sf):
    """[P7] A query that is mostly noise stays as it is."""
    text = F.concat(F.lit("<!-- "), "p_name", F.lit(" -->"), F.expr("substr('a longer text that stays as it is', 1, p_size)"))
    return table(spark, sf, "part").select("p_partkey", X.denoised_or_raw(text).alias("used"))


@query("""SELECT conv_id AS session_id, sha256(string_agg(role || chr(30) || text || chr(30) || chr(29), '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id""")
def content_hash(spark, sf):
    """A request's messages are bounded by validation, so is its group."""
    m = _messages(spark, sf).select(F.col("session_id").alias("request_id"), F.col("seq").alias("message_index"), "role", F.col("text").alias("content"))
    return ingest.content_hashes(m).withColumnRenamed("request_id", "session_id")


@query("""SELECT conv_id, turn, 'm:' || substr(sha256((conv_id % 8) || chr(31) || conv_id || chr(31) || turn || chr(31)), 1, 24) AS message_id FROM conversations""")
def message_ids(spark, sf):
    """[F22]"""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.message_id(F.col("conv_id") % 8, F.col("conv_id"), F.col("turn")).alias("message_id"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.2)::INTEGER + 1 END AS tokens FROM documents")
def token_estimate(spark, sf):
    """[F17]"""
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_DOMAIN = r"(?i)^(?:[\w-]+\.)+(?:com|org|net|io|ai|dev|cn|edu|gov)$"


@query(rf"""WITH u AS (SELECT page_id, url, unnest([{{'kind': 'host', 'value': regexp_extract(url, '://([^/]+)', 1)}}, {{'kind': 'path', 'value': url}}, {{'kind': 'path', 'value': regexp_extract(url, '://(.*)$', 1)}}, {{'kind': 'path', 'value': 'docs/p' || page_id || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.HTML' END}},
 {{'kind': 'config_key', 'value': CASE page_id % 2 WHEN 0 THEN 'docs.page' ELSE 'app.page' END || page_id}}, {{'kind': 'error', 'value': CASE page_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'ab' WHEN 2 THEN 'null' ELSE 'KeyError' END}}]) AS e FROM pages),
l AS (SELECT page_id, e.kind AS kind, e.value AS value, lower(trim(e.value)) AS low FROM u)
SELECT page_id, kind, value, (length(low) < 3 OR low IN ('n/a', 'na', 'none', 'null', 'http', 'https', 'www') OR contains(low, '://') OR starts_with(low, 'www.') OR regexp_matches(low, '{_DOMAIN}')
 OR (kind = 'path' AND regexp_extract(low, '[^.]*$') IN ('html', 'md', 'rst', 'txt', 'css', 'scss')) OR (kind = 'config_key' AND (starts_with(low, 'www.') OR starts_with(low, 'docs.')))) AS junk,
 regexp_replace('A. ' || value, '^\s*(?:[A-Za-z]|[0-9]{{1,2}})\s*[.):、]\s*', '') AS option FROM l""")
def junk_entities(spark, sf):
    """[P8, P9] Whole urls, their hosts and paths, and made-up documents, keys and errors."""
    n, pick = F.col("page_id").cast("string"), lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("page_id") % k + 1).cast("int"))
    said = {("host", 0): F.regexp_extract("url", "://([^/]+)", 1), ("path", 1): F.col("url"), ("path", 2): F.regexp_extract("url", "://(.*)$", 1), ("path", 3): F.concat(F.lit("docs/p"), n, pick(3, ".md", ".py", ".HTML")),
            ("config_key", 4): F.concat(pick(2, "docs.page", "app.page"), n), ("error", 5): pick(4, "N/A", "ab", "null", "KeyError")}
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for (k, _), v in said.items()]))
    p = table(spark, sf, "pages").select("page_id", e.alias("e")).select("page_id", "e.kind", "e.value")
    return p.select("page_id", "kind", "value", X.is_junk_entity(F.col("kind"), F.col("value")).alias("junk"), X.strip_option(F.concat(F.lit("A. "), "value")).alias("option"))


# -- B: recall --------------------------------------------------------------------------------------------------------


def _cards(spark, sf) -> DataFrame:
    return retrieval.index_face(_documents(spark, sf).select(F.lit("all").alias("scope"), F.col("doc_id").alias("item_id"), F.lit("problem").alias("field"), "text"))


def _asked(spark, sf) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.lit("all").alias("scope"), F.col("item_id").alias("query_id"), "text")
    return retrieval.query_terms(q, {"problem": 1.0})


_BM25 = f"""terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({X.sql_tokens('text')}) AS term FROM documents) GROUP BY ALL),
dls AS (SELECT doc_id, len({X.sql_tokens('text')}) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(CASE WHEN dl > 0 THEN dl END) AS avgdl FROM dls),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest({X.sql_tokens('text')}) AS term FROM benchmark),
bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score
  FROM qt JOIN terms USING (term) JOIN dfs USING (term) JOIN dls USING (doc_id), stats GROUP BY item_id, doc_id)"""


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def bm25_topk(spark, sf):
    """[A5, A6, R1, J6, O1]"""
    scored = retrieval.bm25(_cards(spark, sf), _asked(spark, sf))
    return retrieval.top(scored, ["query_id"], 10).select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT o_custkey AS item_id, o_orderpriority AS kind, lower(o_orderstatus || '-' || (o_orderkey % 50)) AS value FROM orders),
q AS (SELECT n_nationkey AS query_id, lower('O-' || (n_nationkey + g)) AS value FROM nation, range(5) t(g))
SELECT query_id, item_id, count(DISTINCT e.value)::DOUBLE AS score FROM e JOIN q USING (value) GROUP BY query_id, item_id""")
def entity_hits(spark, sf):
    """[A7, R2, J2]"""
    e = table(spark, sf, "orders").select(F.lit(0).alias("scope"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("kind"), F.lower(F.concat_ws("-", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string"))).alias("value"))
    q = table(spark, sf, "nation").select(F.lit(0).alias("scope"), F.col("n_nationkey").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("g"), "n_nationkey")
    q = q.select("scope", "query_id", F.lower(F.concat(F.lit("O-"), (F.col("n_nationkey") + F.col("g")).cast("string"))).alias("value"))
    return retrieval.entity_hits(e, q).drop("scope")


@query("""WITH a AS (SELECT DISTINCT p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'error' ELSE 'misc' END AS kind, lower(trim(p_brand)) AS value FROM part),
n AS (SELECT count(*) AS n FROM part), d AS (SELECT kind, value, count(*) AS df FROM a GROUP BY kind, value),
q AS (SELECT DISTINCT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'error' ELSE 'misc' END AS kind, lower('Brand#' || (11 + s_suppkey % 40)) AS value FROM supplier)
SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * CASE kind WHEN 'file' THEN 1.3 WHEN 'error' THEN 1.6 ELSE 1.0 END), 6) AS score
FROM a JOIN d USING (kind, value) JOIN q USING (kind, value), n GROUP BY query_id, item_id""")
def anchor_idf(spark, sf):
    """[A8, R3, J3, P10]"""
    kind = lambda c: F.when(c % 3 == 0, "file").when(c % 3 == 1, "error").otherwise("misc")
    p = table(spark, sf, "part").select(F.lit(0).alias("scope"), F.col("p_partkey").alias("item_id"), kind(F.col("p_size")).alias("kind"), F.col("p_brand").alias("value"))
    q = table(spark, sf, "supplier").select(F.lit(0).alias("scope"), F.col("s_suppkey").alias("query_id"), kind(F.col("s_suppkey")).alias("kind"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 40 + 11).cast("string")).alias("value"))
    return retrieval.anchor_scores(p, q, p).select("query_id", "item_id", F.round("score", 6).alias("score"))


_COSINE = """cs AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.label = v.label),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM cs)"""


def _vector_scores(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return retrieval.vector_scores(e, e.where("item_id % 50 = 0").select("scope", F.col("item_id").alias("query_id"), F.col("vec").alias("qvec")))


@query(f"WITH {_COSINE} SELECT query_id, item_id, rank::INTEGER AS rank, round(score, 6) AS score FROM cr WHERE rank <= 20")
def cosine_topk(spark, sf):
    """[F20, R4, J4, J13] label stands for the user whose rows a search is held to: a query meets only vectors of its own
    label, about a tenth of the rows, and nearer ones of other labels can't appear. bm25_topk has one scope for all."""
    return retrieval.top(_vector_scores(spark, sf), ["query_id"], 20).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


_EVENT_LISTS = """l AS (SELECT user_id AS query_id, event_type AS channel, hour(ts) AS item_id, sum(value) AS score FROM events GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, item_id) AS rank FROM l),
w(channel, w) AS (VALUES ('view', 1.0), ('click', 0.8), ('purchase', 1.2), ('error', 0.0)),
f AS (SELECT query_id, item_id, sum(coalesce(w, 0.0)::DOUBLE / (60 + rank)) AS fused FROM lr LEFT JOIN w USING (channel) WHERE rank <= 5 GROUP BY query_id, item_id)"""
_EVENT_WEIGHTS = {"view": 1.0, "click": 0.8, "purchase": 1.2, "error": 0.0}


def _event_lists(spark, sf) -> DataFrame:
    l = _events(spark, sf).groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("channel"), F.hour("ts").cast("long").alias("item_id")).agg(F.sum("value").alias("score"))
    return retrieval.top(l, ["query_id", "channel"], 5)


@query(f"WITH {_EVENT_LISTS} SELECT query_id, item_id, round(fused, 9) AS fused FROM f")
def rrf_fusion(spark, sf):
    """[A9, R6, J8, D1, W1]"""
    return retrieval.fuse(_event_lists(spark, sf), _EVENT_WEIGHTS).select("query_id", "item_id", F.round("fused", 9).alias("fused"))


@query(f"""WITH {_EVENT_LISTS} SELECT q.query_id, i.item_id, round(coalesce(fused, 0.0), 9) AS fused
FROM (SELECT DISTINCT user_id AS query_id FROM events) q CROSS JOIN (SELECT unnest(range(24)) AS item_id) i LEFT JOIN f USING (query_id, item_id)""")
def pool_fill_zero(spark, sf):
    """[J9, O2]"""
    fused = retrieval.fuse(_event_lists(spark, sf), _EVENT_WEIGHTS).drop("ranks")
    users = _events(spark, sf).select(F.lit(0).alias("scope"), F.col("user_id").alias("query_id")).distinct()
    return retrieval.with_all_items(fused, users, spark.range(24).select(F.lit(0).alias("scope"), F.col("id").alias("item_id"))).select("query_id", "item_id", F.round("fused", 9).alias("fused"))


@query("""SELECT o_orderkey, round(0.004 * (
 CASE WHEN o_orderkey % 4 = 0 THEN 1.0 / (1 + ln(1 + o_custkey % 400 + 1)) ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1.2 / (1 + ln(1 + o_custkey % 100 + 1)) ELSE 0 END
 + CASE WHEN o_orderkey % 5 = 0 THEN 0.7 / (1 + ln(1 + o_custkey % 200 + 1)) ELSE 0 END - CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 1.5 ELSE 0 END
 + 0.4 + CASE WHEN o_orderstatus = 'F' THEN 0.8 WHEN o_orderstatus = 'O' THEN 0.3 ELSE 0 END), 9) AS boost FROM orders""")
def rank_boost(spark, sf):
    """[W2, R8]"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rank = lambda m, n: F.when(k % m == 0, (c % n + 1).cast("int"))
    ranks = F.create_map(F.lit("entity"), rank(4, 400), F.lit("anchor"), rank(3, 100), F.lit("field"), rank(5, 200), F.lit("vector"), F.lit(None).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(retrieval.boost(ranks, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"), 9).alias("boost"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, n::INTEGER AS n FROM r WHERE n <= 5""")
def list_current(spark, sf):
    """[S13]"""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 5").select("o_custkey", "o_orderkey", "n")


@query("""SELECT d.lang AS scope, count(*) AS cards, count(l.doc_id) AS judged, round(count(l.doc_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def coverage(spark, sf):
    """[A10, A11]"""
    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select(F.col("doc_id").alias("l_id"))
    j = d.join(l, d["doc_id"] == l["l_id"], "left").groupBy(F.col("lang").alias("scope")).agg(F.count("*").alias("cards"), F.count("l_id").alias("judged"))
    return j.withColumn("coverage", F.round(F.try_divide("judged", "cards"), 4))


# -- C: selection -----------------------------------------------------------------------------------------------------

_LINES = """rl AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS item_id, l_extendedprice AS price, (1 - l_discount) / l_linenumber AS score, l_suppkey FROM lineitem)"""


def _lines(spark, sf) -> DataFrame:
    score = (1 - F.col("l_discount")) / F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("item_id"), score.alias("score"), "l_suppkey", "l_extendedprice")


@query(r"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) SELECT source, doc_id FROM r WHERE n = 1""")
def dedup_fingerprint(spark, sf):
    """[D4]"""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return selection.first_of_each_text(d).select(F.col("query_id").alias("source"), F.col("rank").alias("doc_id"))


@query(f"WITH {_LINES}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM rl) SELECT query_id, rank, round(score, 6) AS score FROM b WHERE score >= greatest(0.3, 0.5 * best) OR rank <= 2")
def relative_floor(spark, sf):
    """[P25, A16]"""
    return selection.admit(_lines(spark, sf), 0.5, 0.3).select("query_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT n AS rank, CASE WHEN n <= 10 THEN 1600 WHEN n <= 30 THEN 1000 WHEN n <= 60 THEN 700 ELSE 450 END AS cap, greatest(0, least(n, 100, 10)) AS top_k FROM (SELECT unnest(range(1, 101)) AS n)")
def budget_tiers(spark, sf):
    """[W4, P3]"""
    n = spark.range(1, 101).select(F.col("id").alias("rank"))
    return n.select("rank", selection.tier_cap(F.col("rank")).alias("cap"), selection.effective_top_k(F.col("rank")).alias("top_k"))


@query("""WITH l AS (SELECT l_orderkey AS q, l_partkey, l_suppkey % 5 AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem),
f AS (SELECT *, rank <= 2 OR row_number() OVER (PARTITION BY q, file ORDER BY rank) = 1 AS picked FROM l)
SELECT q AS query_id, l_partkey AS item_id, rank::INTEGER AS rank, (row_number() OVER (PARTITION BY q ORDER BY picked DESC, rank))::INTEGER AS position FROM f""")
def file_mmr(spark, sf):
    """[D5] Each line has one file, so it waits unless it is among the first two or the first of its file."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id", "l_extendedprice"))
    rows = _lines(spark, sf).select("query_id", "item_id", place.alias("rank"), F.array((F.col("l_suppkey") % 5).cast("string")).alias("files"))
    return selection.spread_files(rows).select("query_id", "item_id", "rank", "position")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS q, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice))::INTEGER AS rank, (l_extendedprice)::BIGINT AS tokens FROM lineitem),
s AS (SELECT q, 0 AS rank, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT q FROM l)
  UNION ALL SELECT s.q, l.rank, CASE WHEN s.used + l.tokens <= 96000 THEN s.used + l.tokens ELSE s.used END, s.used + l.tokens <= 96000 FROM s JOIN l ON l.q = s.q AND l.rank = s.rank + 1)
SELECT q AS query_id, rank FROM s WHERE taken""")
def token_budget(spark, sf):
    """[R15, A17]"""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id", "l_extendedprice"))
    rows = _lines(spark, sf).select("query_id", place.alias("rank"), F.rint("l_extendedprice").cast("long").alias("tokens"))
    return selection.within_budget(rows).select("query_id", "rank")


@query("""SELECT d.source AS query_id, d.doc_id AS item_id, round(1.0 / (60 + d.doc_id % 50) + coalesce(0.010 * CASE l.quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 END * (0.5 + 0.5 * CASE WHEN l.toxic = 1 THEN 1.0 ELSE 0.5 END), 0), 9) AS score
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def judge_fuse(spark, sf):
    """[R10, R11, R21, D9]"""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), (1.0 / (60 + F.col("doc_id") % 50)).alias("score"))
    v = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"), F.when(F.col("toxic") == 1, 1.0).alias("confidence"))
    return selection.judged(d, v).select("query_id", "item_id", F.round("score", 9).alias("score"))


@query("""WITH l AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rank, l_partkey, l_tax * 20 AS rr,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
k AS (SELECT *, CASE WHEN rank <= 4 THEN 0.3 * greatest(0.0, least(1.0, rr)) + 0.7 * (least(n, 4) - rank + 1) / least(n, 4) END AS s FROM l)
SELECT query_id, l_partkey || '-' || rank AS item_id, round(CASE WHEN n < 2 THEN NULL ELSE coalesce(s, min(s) OVER (PARTITION BY query_id) - 0.001) END, 6) AS score FROM k""")
def rerank_fuse(spark, sf):
    """[R12, W3, S22] Every order: its lines are numbered, since line numbers have gaps and parts repeat."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    l = table(spark, sf, "lineitem").withColumn("rank", place)
    l = l.select(F.col("l_orderkey").alias("query_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("rank").cast("string")).alias("item_id"), "rank", (F.col("l_tax") * 20).alias("rerank"))
    return selection.reranked(l.drop("rerank"), l.select("query_id", "item_id", "rerank"), candidates=4).select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT d.source AS query_id, d.doc_id AS item_id, CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 0 ELSE 1 END AS g FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY g, item_id))::INTEGER AS position FROM v""")
def transfer_grouping(spark, sf):
    """[R14, O5]"""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("rank"))
    v = table(spark, sf, "labels").join(d, F.col("doc_id") == F.col("item_id")).select("query_id", "item_id", F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "transferable").otherwise("topic").alias("verdict"))
    return selection.grouped_by_transfer(d, v).select("query_id", "item_id", "position")


@query("SELECT d.lang, CASE l.quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE 'unknown' END AS verdict, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def verdict_histogram(spark, sf):
    """[A12, A13]"""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang", F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").otherwise("unknown").alias("verdict")).agg(F.count("*").alias("n"))


# -- D: requests and sessions -----------------------------------------------------------------------------------------


@query("""SELECT conv_id AS session_id, CASE WHEN bool_or(role NOT IN ('user', 'assistant')) THEN 'role' WHEN sum(length(text)) > 4000000 THEN 'total_length' END AS reason FROM conversations GROUP BY conv_id""")
def validate_messages(spark, sf):
    """[P1, S1, T25]"""
    m = _messages(spark, sf).select(F.col("session_id").alias("request_id"), "user_id", "session_id", F.col("seq").alias("message_index"), "role", F.col("text").alias("content"))
    return ingest.reject_reasons(m).select("session_id", "reason")


@query("""SELECT event_id, CASE WHEN user_id % 50 = 0 THEN 'user_id' WHEN event_type = 'error' THEN 'query' WHEN value::INTEGER NOT BETWEEN 0 AND 100 THEN 'top_k' WHEN event_id % 7 = 0 THEN 'options' END AS reason FROM events""")
def validate_search(spark, sf):
    """[P2, S2]"""
    user, text = F.when(F.col("user_id") % 50 != 0, F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", " \t").otherwise(F.col("props"))
    options = F.when(F.col("event_id") % 7 == 0, F.array("props", F.lit(None).cast("string"))).when(F.col("event_id") % 7 == 1, F.array("props"))
    return _events(spark, sf).select("event_id", ingest.search_reject_reason(user, text, F.rint("value").cast("int"), options).alias("reason"))


@query("""WITH w AS (SELECT event_id, user_id, date_trunc('day', ts) AS d, props, first(props) OVER o AS f, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'fresh' WHEN props = f THEN 'replay' ELSE 'conflict' END AS outcome FROM w""")
def idempotent_dedup(spark, sf):
    """[D6, T1]"""
    r = _events(spark, sf).select("event_id", "user_id", F.date_trunc("day", "ts").alias("request_id"), F.col("props").alias("content_hash"), F.col("event_id").alias("seq"))
    return ingest.deduplicated(r).select("event_id", "outcome")


@query("SELECT conv_id % 8 AS user_id, conv_id AS session_id, count(*) AS chunk_count, min(conv_id * 1000 + turn) AS first_seq, max(conv_id * 1000 + turn) AS last_seq FROM conversations GROUP BY conv_id")
def session_rollup(spark, sf):
    """[A14, S18]"""
    return ingest.sessions(_messages(spark, sf).withColumn("seq", F.col("session_id") * 1000 + F.col("seq")))


@query("""WITH s AS (SELECT conv_id % 8 AS user_id, conv_id AS session_id FROM conversations GROUP BY conv_id)
SELECT user_id, session_id, lead(session_id) OVER w AS next_session, lead(session_id) OVER w IS NOT NULL AS closed FROM s WINDOW w AS (PARTITION BY user_id ORDER BY session_id)""")
def session_closed_by_change(spark, sf):
    """[J11, T3, T4]"""
    m = _messages(spark, sf).withColumn("seq", F.col("session_id") * 1000 + F.col("seq"))
    return ingest.closed_by_change(ingest.sessions(m)).select("user_id", "session_id", "next_session", "closed")


@query("""WITH l AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, (sum(c) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS island FROM l""")
def message_islands(spark, sf):
    """[W8]"""
    return ingest.islands(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "island")


@query("""SELECT conv_id, arg_min(text, turn) AS problem, arg_max(text, turn) FILTER (role = 'assistant' AND length(text) >= 40) AS summary FROM conversations GROUP BY conv_id""")
def session_evidence(spark, sf):
    """[W9, X18: first message, last qualifying message]"""
    last = F.max_by("text", F.when((F.col("role") == "assistant") & (F.length("text") >= 40), F.col("turn")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("problem"), last.alias("summary"))


@query("SELECT a.conv_id, a.turn AS at, b.turn AS neighbour FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 2")
def neighbour_window(spark, sf):
    """[S11]"""
    return ingest.neighbours(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 2).select("conv_id", "at", "neighbour")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def latest_publication(spark, sf):
    """[T5, T19, S7, T20]"""
    return ingest.latest(_events(spark, sf).select("user_id", "event_type", "event_id", "props", F.col("event_id").alias("o")), ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id", "props")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def purge_scope(spark, sf):
    """[S26]"""
    gone = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return ingest.without_scope(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), gone, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 60 DAY < TIMESTAMP '1998-06-01' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'committed' END AS state FROM orders")
def lease_expiry(spark, sf):
    """[T8, T9, F24]"""
    status = F.when(F.col("o_orderstatus") == "O", "processing").otherwise("committed")
    until = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")
    return table(spark, sf, "orders").select("o_orderkey", ingest.lease_state(status, until, F.lit("1998-06-01").cast("timestamp")).alias("state"))


# -- E: chunks and facts ----------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(CASE WHEN length(text) = 0 THEN [] ELSE string_split(rtrim(text, chr(10)), chr(10)) END) AS line FROM conversations)
SELECT CASE WHEN regexp_matches(line, '^[ \t]*(diff --git|@@ |--- |\+\+\+ |Index: )') OR regexp_matches(line, '^[ \t]*[+-][^+-]') THEN 'diff'
  WHEN regexp_matches(line, '^\s*(\$|>|PS [A-Z]:|#\s|\w+@[\w.-]+:.*[$#])\s*\S') THEN 'command' ELSE 'prose' END AS kind, count(*) AS n FROM l GROUP BY 1""")
def classify_lines(spark, sf):
    """[F5]"""
    lines = table(spark, sf, "conversations").select(F.explode(chunking.lines(F.regexp_replace("text", "\n+$", ""))).alias("line"))
    return lines.groupBy(chunking.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS whole, length(text) AS n FROM documents WHERE length(text) > 0")
def chunk_lossless(spark, sf):
    """[F6-F9, S5] The chunks of each document, put together again."""
    m = _documents(spark, sf).select(F.lit("u").alias("user_id"), F.col("doc_id").alias("request_id"), F.lit(0).alias("message_index"), F.col("text").alias("content"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    whole = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return chunking.chunks(m).groupBy(F.col("request_id").alias("doc_id")).agg(F.sha2(whole.cast("binary"), 256).alias("whole"), F.max("char_end").cast("long").alias("n"))


@query("""WITH t AS (SELECT p_partkey, p_size, 'intro ' || p_name || chr(10) AS a, '```' || chr(10) || 'code ' || p_size || chr(10) || '```' || chr(10) AS b, '$ pytest' || chr(10) AS c, p_size || ' passed' || chr(10) AS d FROM part),
k AS (SELECT p_partkey, p_size, length(a) AS a, length(a || b) AS b, length(a || b || c) AS c, length(a || b || c || d) AS d FROM t),
f AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS ord, unnest(['prose', 'code', 'command', 'test_result']) AS kind, unnest([0, a, b, c]) AS char_start, unnest([a, b, c, d]) AS char_end FROM k)
SELECT p_partkey, ord, kind, char_start, char_end FROM f UNION ALL
SELECT p_partkey, (4 + i)::INTEGER, 'prose', (d + 2000 * i)::INTEGER, least(d + 500 * p_size, d + 2000 * (i + 1))::INTEGER FROM k, (SELECT unnest(range(20)) AS i) WHERE 2000 * i < 500 * p_size""")
def chunk_cuts(spark, sf):
    """[F6, F7, F8, F9] Prose, a fence, a command, a test's outcome, and prose of 100 to 5000 words in one line, cut behind blanks."""
    text = F.concat(F.lit("intro "), "p_name", F.lit("\n```\ncode "), F.col("p_size").cast("string"), F.lit("\n```\n$ pytest\n"), F.col("p_size").cast("string"), F.lit(" passed\n"), F.repeat(F.lit("word "), F.col("p_size") * 100))
    m = table(spark, sf, "part").select(F.lit("u").alias("user_id"), F.col("p_partkey").alias("request_id"), F.lit(0).alias("message_index"), text.alias("content"))
    return chunking.chunks(m).select(F.col("request_id").alias("p_partkey"), "ord", "kind", "char_start", "char_end")


@query(r"""WITH t AS (SELECT p_partkey, p_size % 4 AS n, CASE p_size % 4 WHEN 0 THEN 'lines' WHEN 1 THEN 'short' WHEN 2 THEN 'mixed' ELSE 'blocks' END AS form, p_name FROM part)
SELECT p_partkey, CASE form WHEN 'short' THEN ['prose:' || p_name || repeat(' x', 20) || chr(10) || 'more' || chr(10)] WHEN 'lines' THEN ['prose:' || repeat('a', 1200) || chr(10), 'prose:' || repeat('b', 900) || chr(10)]
 WHEN 'mixed' THEN ['log:' || 'INFO start' || chr(10), 'diff:' || '@@ -1 +1 @@' || chr(10) || '+new' || chr(10), 'stack:' || 'KeyError: x' || chr(10), 'prose:' || 'end'] ELSE ['prose:' || repeat('c', 30) || chr(10) || chr(10) || repeat('d', 1500) || chr(10), 'prose:' || '## Head' || chr(10) || repeat('e', 1090) ] END AS told FROM t""")
def chunk_merges(spark, sf):
    """[F5, F6, F8] Lines that make one chunk, long lines that don't, kinds side by side, and a heading behind a short start."""
    n, rep = F.col("p_size") % 4, lambda c, k: F.repeat(F.lit(c), F.lit(k))
    text = F.when(n == 1, F.concat("p_name", rep(" x", 20), F.lit("\nmore\n"))).when(n == 0, F.concat(rep("a", 1200), F.lit("\n"), rep("b", 900), F.lit("\n"))).when(
        n == 2, F.lit("INFO start\n@@ -1 +1 @@\n+new\nKeyError: x\nend")).otherwise(F.concat(rep("c", 30), F.lit("\n\n"), rep("d", 1500), F.lit("\n## Head\n"), rep("e", 1090)))
    m = table(spark, sf, "part").select(F.lit("u").alias("user_id"), F.col("p_partkey").alias("request_id"), F.lit(0).alias("message_index"), text.alias("content"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat("kind", F.lit(":"), "text").alias("t")))), lambda x: x["t"])
    return chunking.chunks(m).groupBy(F.col("request_id").alias("p_partkey")).agg(told.alias("told"))


@query()
def entities(spark, sf):
    """[F10, F11, F12, D8, D10]"""
    e = extraction.capped(extraction.entities(F.col("text"), F.lit(True)))
    return _documents(spark, sf).select("doc_id", F.explode_outer(e).alias("e")).where("e IS NOT NULL").select("doc_id", "e.kind", "e.value")


@query(f"WITH p AS (SELECT p_partkey, {_PATCH} AS t FROM part) SELECT p_partkey, regexp_extract(t, 'b/(\\S+)', 1) AS file, regexp_extract(t, 'def (\\w+)', 1) || ',' || regexp_extract(t, 'class (\\w+)', 1) AS symbols FROM p")
def patch_facts(spark, sf):
    """[X4, X5, X6, P11, P12, P14]"""
    p = table(spark, sf, "part").select("p_partkey", _patch().alias("t")).where(extraction.is_real_diff(F.col("t")))
    return p.select("p_partkey", F.array_join(extraction.files_of_patch(F.col("t")), ",").alias("file"), F.array_join(extraction.symbols_of_patch(F.col("t")), ",").alias("symbols"))


@query("SELECT s_suppkey, 'pytest tests/test_' || s_nationkey || '.py' AS cmd, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7) || ' passed' ELSE '1 failed, ' || (s_suppkey % 7) || ' passed' END AS expect FROM supplier")
def verify_recipe(spark, sf):
    """[X7, P13]"""
    k = (F.col("s_suppkey") % 7).cast("string")
    result = F.when(F.col("s_suppkey") % 2 == 0, F.concat(k, F.lit(" passed"))).otherwise(F.concat(F.lit("1 failed, "), k, F.lit(" passed")))
    t = F.concat(F.lit("$ python repro.py\n$ pytest  tests/test_"), F.col("s_nationkey").cast("string"), F.lit(".py\n"), result)
    return table(spark, sf, "supplier").select("s_suppkey", extraction.verification(t).alias("v")).select("s_suppkey", "v.cmd", "v.expect")


_TOLD = "CASE turn % 7 WHEN 0 THEN '```x' WHEN 1 THEN 'run pip install it' WHEN 2 THEN 'in a/b_' || conv_id || '.py' WHEN 3 THEN 'at line ' || turn WHEN 4 THEN 'the fix works' WHEN 5 THEN 'obj at 0x7f00' || lpad(turn::VARCHAR, 4, '0') ELSE '' END || ' ' || text"


@query(rf"""WITH t AS (SELECT conv_id, turn, {_TOLD} AS t FROM conversations), h AS (SELECT conv_id, turn, t,
 regexp_matches(t, '(?m)(^\s*```|^\s*diff --git\b|^\s*@@)') AS code, regexp_matches(t, '(?i)(^\s*\$\s+\S|\bpytest\b|\bpython(3(\.\d+)?)?\s+-m\b|\bpip\s+install\b|\bgit\s+(checkout|diff|apply|clone|log|show)\b|\bnpm\s+|\bcargo\s+test\b|\bgo\s+test\b)') AS command,
 regexp_matches(t, '[A-Za-z0-9_./\\~-]+\.({extraction._EXTENSIONS}|gradle|mod|lock)\b') AS path, regexp_matches(t, '(?i)\bline\s+\d+\b|\bL\d{{1,6}}\b|:\d{{2,5}}\b') AS line,
 regexp_matches(t, '(?i)\b(the\s+)?(fix|patch|solution|implementation)\b|\bchanges?\s+made\b|\b(we|i)\s+(added|changed|modified|removed|created|updated|replaced|wrapped|introduced|implemented|fixed|set|moved|renamed|deleted)\b|\bthis\s+(fix|patch|change|solution)\b') AS narration,
 regexp_matches(t, '(?i)^\s*(add|modify|change|remove|replace|set|use|ensure|wrap|guard|check|call|initialize|initialise|update|fix|implement|introduce|make|apply|insert|delete|move|rename|refactor|run|test)\b') AS imperative,
 regexp_matches(t, '(?i)0x[0-9a-f]{{6,}}|OrderedDict\(\[|array\(\[[^\]]{{20,}}') AS dump FROM t)
SELECT conv_id, turn, concat_ws(',', CASE WHEN code THEN 'code' END, CASE WHEN command THEN 'command' END, CASE WHEN path THEN 'path' END, CASE WHEN line THEN 'line' END, CASE WHEN narration THEN 'narration' END, CASE WHEN imperative THEN 'imperative' END) AS hazards,
 concat_ws(',', CASE WHEN code THEN 'code' END, CASE WHEN line THEN 'line' END, CASE WHEN dump THEN 'dump' END, CASE WHEN narration THEN 'narration' END) AS of_problem FROM h""")
def admission_hazards(spark, sf):
    """[P19, P20] Every message, with a hazard of each kind written before some."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    said = {0: F.lit("```x"), 1: F.lit("run pip install it"), 2: F.concat(F.lit("in a/b_"), conv, F.lit(".py")), 3: F.concat(F.lit("at line "), turn), 4: F.lit("the fix works"), 5: F.concat(F.lit("obj at 0x7f00"), F.lpad(turn, 4, "0"))}
    told = F.concat(F.coalesce(*[F.when(F.col("turn") % 7 == k, v) for k, v in said.items()], F.lit("")), F.lit(" "), "text")
    t = table(spark, sf, "conversations").select("conv_id", "turn", told.alias("t"))
    return t.select("conv_id", "turn", F.array_join(extraction.hazards(F.col("t")), ",").alias("hazards"), F.array_join(extraction.problem_hazards(F.col("t")), ",").alias("of_problem"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'keyerror,my_fn_' || p_size ELSE 'my_fn_' || p_size END AS missing FROM part")
def ground_identifiers(spark, sf):
    """[P15, P21]"""
    size = F.col("p_size").cast("string")
    value = F.concat(F.lit("KeyError in my_fn_"), size)
    evidence = F.when(F.col("p_size") % 2 == 0, F.lit("nothing")).otherwise(F.lit("Raised  KEYERROR here"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(extraction.ungrounded(value, evidence), ",").alias("missing"))


@query("""SELECT p_partkey, 'assert f(' || p_size || ') == 1' || '|' || 'def test_' || p_size || '():' AS digest FROM part""")
def test_digest(spark, sf):
    """[X20, X30]"""
    size = F.col("p_size").cast("string")
    t = F.concat(F.lit("  assert f("), size, F.lit(")   == 1\nprose\ndef test_"), size, F.lit("():\nassert f("), size, F.lit(") == 1"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(extraction.test_digest(chunking.lines(t)), "|").alias("digest"))


@query("""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), d AS (SELECT DISTINCT w FROM q),
c AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS r FROM conversations), v AS (SELECT DISTINCT r FROM c),
h AS (SELECT DISTINCT conv_id, w FROM c JOIN (SELECT r, w FROM v JOIN d ON contains(r, w)) USING (r))
SELECT item_id, conv_id, round(count(*) / any_value(n), 4) AS ratio FROM h JOIN q USING (w) JOIN n USING (item_id) GROUP BY item_id, conv_id""")
def pending_overlap(spark, sf):
    """[A18, R17, J12, F14] The words of every query against every session; pairs without overlap are dropped."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.content_words(F.col("text")).alias("words"))
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "text")
    return retrieval.word_overlap(c, q).select(F.col("query_id").alias("item_id"), F.col("session_id").alias("conv_id"), F.round("ratio", 4).alias("ratio"))


# -- G: cards ---------------------------------------------------------------------------------------------------------

@query(f"SELECT p_partkey, '文件：' || {_FILE} || chr(10) || '位置：第 1 行' || chr(10) || '修改前：' || chr(10) || '(无)' || chr(10) || '修改后：' || chr(10) || 'def fn_' || p_size || '(x):' || chr(10) || 'class C' || p_size || ':' AS change FROM part")
def change_blocks(spark, sf):
    """[X12, X32]"""
    return _parts(spark, sf).select("p_partkey", rendering.change_blocks(F.col("patch")).alias("change"))


@query(f"""SELECT p_partkey, '涉及文件：' || {_FILE} || chr(10) || '变更涉及的标识符：def, fn_' || p_size || ', class' || CASE WHEN p_size >= 10 THEN ', C' || p_size ELSE '' END || chr(10)
 || '符号：fn_' || p_size || ', C' || p_size || chr(10) || '{rendering.SUMMARY_END}' AS summary FROM part""")
def change_summary(spark, sf):
    """[X13]"""
    return _parts(spark, sf).select("p_partkey", rendering.change_summary(F.col("patch"), F.array("file"), extraction.symbols_of_patch(F.col("patch"))).alias("summary"))


@query(f"""WITH t AS (SELECT p_partkey, p_size, '{rendering.IDEA_HEAD}' || chr(10) || '问题：' || p_name || chr(10) || '{rendering.IDEA_MECHANISM}' || p_type || chr(10) || '{rendering.IDEA_VERIFY}' || chr(10) || '- ' || p_brand || chr(10)
 || '边界：' || chr(10) || '- ' || p_size || ' → 期望：ok' AS t FROM part) SELECT p_partkey, CASE WHEN floor(length(t) / 3.2) + 1 <= 45 + p_size % 10 THEN t ELSE '' END AS content FROM t""")
def idea_cards(spark, sf):
    """[X15, X16]"""
    edges = F.array(F.struct(F.col("size").alias("case"), F.lit("ok").alias("expected")))
    return _parts(spark, sf).select("p_partkey", rendering.idea(F.col("p_name"), F.col("p_type"), F.array("p_brand"), edges, 45 + F.col("p_size") % 10).alias("content"))


_SYMBOLS = "'fn_' || p_size || '{sep}C' || p_size"


@query(f"""SELECT p_partkey, '[历史修复案例] · debug' || chr(10) || CASE WHEN p_size % 3 <> 0 THEN '问题：' || p_name || chr(10) || '文件：' || {_FILE} || chr(10) || '{rendering.HINT}' || chr(10) || '文件：' || {_FILE} || chr(10) || '位置：第 1 行' || chr(10) || '修改前：' || chr(10) || '(无)' || chr(10) || '修改后：' || chr(10) || 'def fn_' || p_size || '(x):' || chr(10) || 'class C' || p_size || ':'
 ELSE '问题（历史线索，需在当前仓库确认）：' || p_name || chr(10) || '确认方式：在当前仓库检索 ' || {_SYMBOLS.format(sep='、')} || '，确认它们现在所在的文件后再编辑；不要直接使用历史文件。' END
 || chr(10) || '验证：`pytest tests/test_' || p_size || '.py`' || chr(10) || '符号：' || {_SYMBOLS.format(sep=', ')} AS content FROM part""")
def whole_packets(spark, sf):
    """[X9, X14, X31, F18] Packets with room for all they hold."""
    rows = _parts(spark, sf).select(
        "p_partkey", "p_size", F.col("p_name").alias("problem"), F.array("file").alias("files"), extraction.symbols_of_patch(F.col("patch")).alias("symbols"), "patch", F.concat(F.lit("pytest tests/test_"), "size", F.lit(".py")).alias("cmd"))
    return rendering.rendered(rows, F.lit(1600), F.col("p_size") % 3 != 0).select("p_partkey", "content")


@query()
def packets(spark, sf):
    """[X9, X14, X31, W4] Packets under the cap of their rank's tier, scaled down so that all steps of giving way occur."""
    rows = _parts(spark, sf).select(
        "p_partkey", "p_size", F.col("p_name").alias("problem"), F.array("file").alias("files"), extraction.symbols_of_patch(F.col("patch")).alias("symbols"), "patch", F.concat(F.lit("pytest tests/test_"), "size", F.lit(".py")).alias("cmd"))
    return rendering.rendered(rows, selection.tier_cap(F.col("p_size")) / 16, F.col("p_size") % 3 != 0).select("p_partkey", "content")


@query(f"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, '<case id="experience:' || doc_id || '">' || chr(10) || 'id=experience:' || doc_id
 || CASE WHEN length(text) > 0 THEN chr(10) || '问题：' || substr(text, 1, 200) ELSE '' END || chr(10) || '</case>' AS c FROM documents),
u AS (SELECT *, '# 当前 issue' || chr(10) || trim(source) || chr(10) || chr(10) || '{rendering.JUDGE_CASES}' AS head, sum(length(c) + 1) OVER (PARTITION BY source ORDER BY rank) AS used FROM r WHERE rank <= 200)
SELECT source, any_value(head) || coalesce(string_agg(chr(10) || c, '' ORDER BY rank) FILTER (length(head) + used <= 9000), '') AS prompt FROM u GROUP BY source""")
def judge_prompts(spark, sf):
    """[X17, O4]"""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("source").alias("query"), F.col("doc_id").alias("item_id"), F.lit(0.0).alias("score"), F.col("text").alias("problem"))
    ranked = retrieval.top(d, ["query_id"], retrieval.POOL_SIZE)
    return rendering.judge_prompts(ranked).select(F.col("query_id").alias("source"), "prompt")


@query(f"SELECT conv_id, turn FROM conversations WHERE NOT (regexp_matches(substr(text, 1, 600), '{cards.SETUP}') AND length(text) < 2000)")
def setup_filter(spark, sf):
    """[P4]"""
    return table(spark, sf, "conversations").where(~cards.is_setup(F.col("text"))).select("conv_id", "turn")


@query("""SELECT p_partkey, 'see src/a_' || p_size || '.py and, then ok (pkg.mod_' || p_size || ')' AS told FROM part""")
def strip_anchors(spark, sf):
    """[P17]"""
    p = _parts(spark, sf)
    text = F.concat(F.lit("see src/a_"), "size", F.lit(".py and lib/b_"), "size", F.lit(".py , then ok (pkg.mod_"), "size", F.lit(" KeyError)"))
    return p.select("p_partkey", cards.strip_ungrounded(text, F.concat(F.lit("src/a_"), "size", F.lit(".py pkg.mod_"), "size")).alias("told"))


@query("SELECT p_partkey, p_size % 2 = 0 AS grounded FROM part")
def pitfalls(spark, sf):
    """[P16]"""
    evidence_ = F.when(F.col("p_size") % 2 == 0, F.lit("calls cache_reset twice")).otherwise(F.lit("an error in a file"))
    return table(spark, sf, "part").select("p_partkey", cards.pitfall_grounded(F.lit("cache_reset failed with error"), evidence_).alias("grounded"))


@query("SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 AND p_size % 2 = 0 AS shown FROM part")
def patch_gate(spark, sf):
    """[P24, R20]"""
    kind, value = F.when(F.col("p_size") % 3 == 0, "path").otherwise("symbol"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("lib/"), F.element_at(F.split("file", "/"), -1))).when(F.col("p_size") % 3 == 1, F.lit("even_fn")).otherwise(F.lit("Grid"))
    text = F.when(F.col("p_size") % 2 == 0, "uses Even_Fn").otherwise("uses nothing")
    return _parts(spark, sf).select("p_partkey", cards.shows_patch(F.array(F.struct(kind.alias("kind"), value.alias("value"))), F.array("file"), text, F.col("patch")).alias("shown"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'old/' || lower(p_type[1:3]) || '_' || p_size || '.py' ELSE 'a.py,b.py' END AS files FROM part")
def clamp_files(spark, sf):
    """[P27, X24]"""
    p = _parts(spark, sf).select("p_partkey", F.col("p_partkey").alias("session_id"), "p_size", "file", F.col("patch").alias("text"))
    final = evidence.last_diff(p.select("session_id", "text", F.lit(0).alias("pos")))
    own = F.when(F.col("p_size") % 2 == 0, F.array(F.replace("file", F.lit("src/"), F.lit("old/")), F.lit("b.py"))).otherwise(F.array(F.lit("a.py"), F.lit("b.py")))
    return p.join(final, "session_id").select("p_partkey", F.array_join(cards.clamped_files(own, F.col("files")), ",").alias("files"))


@query(f"SELECT p_partkey, 'module=src/' || lower(p_type[1:3]) || '_' || p_size || '.py,version=1.' || p_size || ',test_name=tests/t.py::test_' || p_size || ',frame=src/x.py:' || p_size || ',error=KeyError' AS facts FROM part")
def card_conditions(spark, sf):
    """[X8, P26]"""
    text = F.concat(F.lit('File "src/x.py", line '), "size", F.lit("\nFAILED tests/t.py::test_"), "size", F.lit("\nTypeError KeyError"))
    c = cards.conditions(F.lit(None), F.array("file"), F.concat(F.lit("version 1."), "size", F.lit(" KeyError")), text)
    return _parts(spark, sf).select("p_partkey", F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("="), x["value"])), ",").alias("facts"))


@query(f"SELECT p_partkey, {_PATCH} AS patch FROM part")
def session_patches(spark, sf):
    """[X1, X2, X3] Each patch told twice, between prose."""
    p = _parts(spark, sf)
    twice = p.select(F.col("p_partkey").alias("session_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.concat(F.lit("intro\n"), "patch", F.lit("\nAll done")).alias("text"))
    return evidence.patches(twice.withColumn("message_id", F.col("pos"))).select(F.col("session_id").alias("p_partkey"), "patch")


_CAUSE = "'The bug occurs because the cache keeps ' || p_name || repeat(' and again', 40)"
_BETTER = "'assert f(' || p_size || ') == 1' || chr(10) || p_size || ' passed in tests/test_' || p_size || '.py' || repeat('.', 40)"
_TRACE = "'Traceback of test_' || p_size || '.py ends here' || repeat(' and on', 10)"


@query(f"""SELECT p_partkey AS session_id, 'It fails for ' || p_name AS problem, CASE WHEN p_size % 2 = 0 THEN '### Root Cause' || chr(10) || {_CAUSE} ELSE '' END AS summary, CASE WHEN p_size % 2 = 0 THEN {_CAUSE} ELSE '' END AS root_cause,
 CASE WHEN p_size % 2 = 0 THEN 'ran all of it' ELSE '' END AS testing, CASE WHEN p_size % 2 = 1 THEN {_PATCH} ELSE '' END AS diff, '' AS tail, {_BETTER} || chr(10) || {_TRACE} AS verify, 'assert f(' || p_size || ') == 1' AS digest, p_size % 2 = 1 AS reconstructed FROM part""")
def told_sessions(spark, sf):
    """[X18, X19, X20, X29, W9, W10, W11, O7] A session for each part: an issue, then a closing summary or a change, then test output, of which each message gives its
    best chunk. Without a summary the change stands for it."""
    p, even = _parts(spark, sf), F.col("p_size") % 2 == 0
    cause = F.concat(F.lit("The bug occurs because the cache keeps "), "p_name", F.repeat(F.lit(" and again"), F.lit(40)))
    closing = F.concat(F.lit("## Root Cause\n"), cause, F.lit("\n## The Fix\nWe changed it.\n## Testing\nran all of it"))
    better = F.concat(F.lit("assert f("), "size", F.lit(") == 1\n"), "size", F.lit(" passed in tests/test_"), "size", F.lit(".py"), F.repeat(F.lit("."), F.lit(40)))
    trace = F.concat(F.lit("Traceback of test_"), "size", F.lit(".py ends here"), F.repeat(F.lit(" and on"), F.lit(10)))
    row = lambda pos, message, role, kind, text: F.struct(F.lit(pos).alias("pos"), F.lit(message).alias("message_id"), F.lit(role).alias("role"), kind.alias("kind"), text.alias("text"))
    rows = F.array(
        row(0, 0, "user", F.lit("prose"), F.concat(F.lit("It fails for "), "p_name")), row(1, 1, "assistant", F.when(even, "prose").otherwise("diff"), F.when(even, closing).otherwise(F.col("patch"))),
        row(2, 2, "user", F.lit("test_result"), F.concat("size", F.lit(" passed"), F.repeat(F.lit(" "), F.lit(9)), F.repeat(F.lit("-"), F.lit(60)))), row(3, 2, "user", F.lit("test_result"), better), row(4, 3, "user", F.lit("stack"), trace))
    c = p.select(F.col("p_partkey").alias("session_id"), F.explode(rows).alias("r")).select("session_id", "r.*")
    return evidence.windows(c.withColumn("chunk_id", F.concat_ws(":", "session_id", "pos")))


@query()
def session_windows(spark, sf):
    """[X18, X19, X29, W10, W11, O7]"""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("turn").alias("message_id"), "role", F.lit("prose").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "text")
    return evidence.windows(c)


@query("""SELECT conv_id * 1000 + turn AS card_id, CASE WHEN turn % 4 = 0 THEN 'src/x.py' ELSE '' END AS files, CASE WHEN turn % 4 = 0 THEN 'KeyError' ELSE '' END AS conditions, 'fails in' || CASE WHEN bool_or(turn % 4 = 0) OVER (PARTITION BY conv_id) THEN ' src/x.py' ELSE '' END AS problem
FROM conversations WHERE turn % 2 = 0 AND turn % 6 <> 2""")
def admitted_cards(spark, sf):
    """[X10, X11, P15, P17, P18, P26] A proposal for each turn: odd turns cite nothing known, and of the others every third has no change. The facts are
    in the text of every fourth turn; problems keep what the session holds."""
    c = table(spark, sf, "conversations")
    chunk, facts = F.concat_ws(":", "conv_id", "turn"), F.when(F.col("turn") % 4 == 0, F.lit(" src/x.py raised KeyError")).otherwise(F.lit(""))
    chunks = c.select(F.col("conv_id").alias("session_id"), chunk.alias("chunk_id"), F.concat("text", facts).alias("text"))
    lists = {"files": F.array(F.lit("src/x.py"), F.lit("y.py")), "symbols": F.array(F.lit("zap_zap")), "pitfalls": F.array(F.lit("vagueness")), "source_ids": F.array(F.when(F.col("turn") % 2 == 0, chunk).otherwise(F.lit("zz")))}
    told = {"problem": F.lit("fails in src/x.py"), "implement": F.when(F.col("turn") % 6 != 2, F.lit("guard it")), **{n: F.lit(None).cast("string") for n in ("locate", "shape", "boundaries", "acceptance", "mechanism")}}
    said = F.array(F.struct(F.lit("symbol").alias("type"), F.lit("KeyError").alias("value")), F.struct(F.lit("line").alias("type"), F.lit("src").alias("value")))
    proposed = c.select(F.col("conv_id").alias("session_id"), "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("card_id")).withColumn("conv_id", F.col("session_id"))
    proposed = proposed.withColumns({"conditions": said, **lists, **told})
    return cards.admitted(proposed, chunks).select("card_id", F.array_join("files", ",").alias("files"), F.array_join(F.transform("conditions", lambda x: x["value"]), ",").alias("conditions"), "problem")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'feature' WHEN p_size % 4 = 1 THEN 'debug' WHEN p_size % 4 = 2 THEN 'feature' ELSE 'debug' END AS kind FROM part")
def card_kinds(spark, sf):
    """[F27]"""
    m = F.col("p_size") % 4
    said = F.when(m == 0, " Enhancement").when(m == 1, "bugfix").when(m == 2, "debug")
    text = F.when(m == 0, "an error").when(m == 1, "nothing known").when(m == 2, "Support more").otherwise("add what fails")
    return table(spark, sf, "part").select("p_partkey", cards.kind_of(said, text).alias("kind"))


@query(f"SELECT p_partkey, p_name || ' KeyError' AS problem, {_FILE} || ' fn_' || p_size || ' C' || p_size AS locate FROM part")
def card_faces(spark, sf):
    """[F28, F30, R23]"""
    facts = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in (("error", "KeyError"), ("error", "keyerror"), ("module", "src/"))])
    p = _parts(spark, sf).select("p_partkey", F.col("p_name").alias("problem"), F.array("file", F.element_at(F.split("file", "/"), -1)).alias("files"), extraction.symbols_of_patch(F.col("patch")).alias("symbols"), facts.alias("conditions"))
    return p.withColumn("f", cards.faces(p)).select("p_partkey", F.col("f")["problem"].alias("problem"), F.col("f")["locate"].alias("locate"))


_SENTENCE = r"^(?s:(.*?))(?:[.!?。！？;；](?:\s|$)|\n)"


@query(rf"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS start, 0 AS stop, '' AS w FROM documents UNION ALL
  SELECT doc_id, text, stop, stop + CASE WHEN regexp_matches(n, '{_SENTENCE}') THEN length(regexp_extract(n, '{_SENTENCE}', 1)) + 1
    WHEN stop + 240 < length(text) AND length(regexp_extract(n, '^(?s:(.*\S))\s+\S*$', 1)) >= 120 THEN length(regexp_extract(n, '^(?s:(.*\S))\s+\S*$', 1)) ELSE length(n) END, n
  FROM (SELECT doc_id, text, stop, substr(text, stop + 1, 240) AS n FROM c WHERE stop < length(text))),
p AS (SELECT doc_id, start, regexp_replace(substr(text, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS text FROM c WHERE stop > start)
SELECT doc_id, 'Q' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM p WHERE text <> '')""")
def source_spans(spark, sf):
    """[F15, F16, R13] Whole texts in numbered pieces."""
    return table(spark, sf, "documents").select("doc_id", F.explode(cards.spans(F.col("text"), "Q", 1 << 30)).alias("s")).select("doc_id", "s.id", "s.text")


@query("""SELECT doc_id, CASE WHEN length(text) = 0 OR text IS NULL THEN 0 WHEN strpos(text, chr(10) || chr(10)) > 0 THEN CASE WHEN length(text) = strpos(text, chr(10) || chr(10)) + 1 THEN 0 ELSE floor((length(text) - strpos(text, chr(10) || chr(10)) - 1) / 3.2)::INTEGER + 1 END
 ELSE floor(length(text) / 3.2)::INTEGER + 1 END AS tokens FROM documents""")
def body_tokens(spark, sf):
    """[F19]"""
    return table(spark, sf, "documents").select("doc_id", rendering.body_tokens(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || '适用性提示（模型判断，非事实）：' || CASE WHEN p_size % 3 = 1 THEN 'no' ELSE 'unknown' END || '：' || p_type END AS hint FROM part")
def judge_hints(spark, sf):
    """[R16]"""
    verdict = F.when(F.col("p_size") % 3 == 0, "yes").when(F.col("p_size") % 3 == 1, "no").otherwise("unknown")
    return table(spark, sf, "part").select("p_partkey", rendering.judgement_hint(verdict, F.col("p_type")).alias("hint"))


@query("SELECT l_orderkey, l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_suppkey")
def cards_once(spark, sf):
    """[D7]"""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").cast("string").alias("problem"), F.array(F.lit("a.py")).alias("files"), F.col("l_partkey").alias("card_id"), "l_suppkey")
    return cards.once_per_session(l).select(F.col("session_id").alias("l_orderkey"), "l_suppkey", F.col("card_id").alias("l_partkey"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn % 3 = 0 OR contains(text, 'diff --git') OR contains(text, 'Traceback') OR contains(text, '[工具调用]') OR contains(text, 'passed')")
def evidence_scan(spark, sf):
    """[S9]"""
    c = table(spark, sf, "conversations").withColumn("kind", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "stack").otherwise("prose"))
    return cards.evidence_chunks(c).select("conv_id", "turn")


@query("SELECT p_partkey, p_size % 2 = 0 AS quotes FROM part")
def patch_quotes(spark, sf):
    """[P22]"""
    told = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("it now runs Return fn of "), "size", F.lit("  twice"))).otherwise("it changes")
    return _parts(spark, sf).select("p_partkey", cards.quotes_patch(told, F.concat(F.lit("+  return fn of "), "size", F.lit("\n+x = 1"))).alias("quotes"))


# -- H: models --------------------------------------------------------------------------------------------------------


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model that SQL can follow: length, and how often two letters occur."""
    return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, [length(text), length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', ''))]::DOUBLE[] AS vec FROM documents")
def embedded_documents(spark, sf):
    """[S20, J10, T17, T20] The cache holds the texts of even ids before; each other text is embedded once, in batches."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    none = spark.createDataFrame([], "key string, vec array<double>")
    cache = retrieval.kept(models.missing_vectors(d.where("item_id % 2 = 0"), none, _letters, "letters", 3))
    new = retrieval.kept(models.missing_vectors(d, cache, _letters, "letters", 3))
    return models.vectors(d, cache.unionByName(new), "letters", 3).select(F.col("item_id").alias("doc_id"), "vec")


@query("SELECT item_id, 'read: ' || coalesce(text, '') AS answer FROM benchmark")
def model_answers(spark, sf):
    """[S21]"""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return models.answers(b, "read: ".__add__).select(F.col("prompt_id").alias("item_id"), "answer")


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN round(least(1.0, p_size / 40.0), 6) END AS second FROM part")
def rerank_response(spark, sf):
    """[S22]"""
    results = F.concat(F.lit('{"results": [{"index": 1, "score": '), (F.col("p_size") / 40).cast("string"), F.lit("}"), F.when(F.col("p_size") % 3 != 0, F.lit(', {"index": 0, "score": -1}')).otherwise(F.lit("")), F.lit("]}"))
    body = F.when(F.col("p_size") % 2 == 0, results).otherwise(F.concat(F.lit('{"output": '), results, F.lit("}")))
    return table(spark, sf, "part").select("p_partkey", F.round(models.rerank_scores(body, F.lit(2))[F.lit(1)], 6).alias("second"))


# -- F: load ----------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT user_id, event_id, avg(CASE WHEN event_type = 'error' OR value > 40 THEN 1 ELSE 0 END) OVER o AS slow, list_sort(list(value) OVER o) AS v FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT user_id AS scope, event_id AS seq, round(slow, 6) AS slow_ratio, v[len(v) // 2 + 1] AS p50 FROM w""")
def guard_window(spark, sf):
    """[W5, A20]"""
    return health.figures(_samples(spark, sf), 40.0).select("scope", "seq", F.round("slow_ratio", 6).alias("slow_ratio"), "p50")


def _samples(spark, sf) -> DataFrame:
    return _events(spark, sf).select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), F.col("value").alias("elapsed"), (F.col("event_type") == "error").alias("overran"))


@query("""WITH RECURSIVE w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, avg(CASE WHEN event_type = 'error' OR value > 40 THEN 1 ELSE 0 END) OVER o AS slow, list_sort(list(value) OVER o) AS v
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT user_id, event_id, n, slow, v[len(v) // 2 + 1] / 40.0 AS near FROM w),
s AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS n, 'full' AS mode, 0 AS healthy FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT f.user_id, f.event_id, f.n, CASE WHEN near > 0.8 THEN 'lex_only' WHEN slow > 0.2 THEN 'extract_lite' WHEN slow < 0.1 AND near < 0.6 THEN CASE WHEN healthy + 1 >= 10 THEN 'full' WHEN mode = 'lex_only' THEN 'extract_lite' ELSE mode END ELSE mode END,
   CASE WHEN near > 0.8 OR slow > 0.2 THEN 0 WHEN slow < 0.1 AND near < 0.6 THEN healthy + 1 ELSE healthy END FROM s JOIN f ON f.user_id = s.user_id AND f.n = s.n + 1)
SELECT user_id AS scope, event_id AS seq, mode FROM s WHERE event_id IS NOT NULL""")
def guard_modes(spark, sf):
    """[W6, T14]"""
    return health.modes(_samples(spark, sf), 40.0).select("scope", "seq", "mode")


@query("SELECT event_type, count(*) AS attempted, count(*) FILTER (value > 40) AS failed, count(DISTINCT user_id) AS scopes FROM events GROUP BY event_type")
def call_accounting(spark, sf):
    """[A21, A15, T22]"""
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("value") > 40).alias("failed"), F.countDistinct("user_id").alias("scopes"))


from engram.plans import model_queries, search_queries, store_queries, stream_queries  # noqa: E402, F401  (they enter their queries)
