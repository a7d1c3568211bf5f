"""What models are asked and which of their answers count. Ids in brackets name the operators of the inventory.

Answers are made of the tables' columns, so that SQL can tell which of them must count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import judging, prompts
from engram.plans.registry import PATCH, parts, query
from engram.sources import models
from engram.sources.tables import table

_HYP = '{"hypotheses":[{"subsystem":"  sub  one","defect_shape":"shape","evidence_id":"Q01"},{"subsystem":"","defect_shape":"d","evidence_id":"Q01"},{"subsystem":"x","defect_shape":"y","evidence_id":"Q77"}]}'


def _queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _candidates(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").where("doc_id < 240")
    return judging.candidates(d.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item_id"), F.col("doc_id").alias("rank"), F.col("source").alias("problem"), F.col("text").alias("mechanism")))


def _hypotheses(spark, sf) -> DataFrame:
    q = _queries(spark, sf)
    return judging.hypotheses(q, q.select("query_id", F.concat(F.lit("Thus:\n```json\n" + _HYP + "\n```")).alias("answer")))


def _item(alias: str, verdict: str, unit: str, matched: str, reason: str = "because") -> str:
    quoted = lambda v: "null" if v == "null" else f'"{v}"'
    return f'{{"id":"{alias}","verdict":"{verdict}","root_cause_unit_id":{quoted(unit)},"matched_hypothesis":{quoted(matched)},"reason":{quoted(reason)}}}'


#: Counts, counts, counts (unknown), a span of another candidate, answered twice, no such hypothesis, no such candidate.
_ITEMS = '{"items":[' + ",".join([
    _item("C01", "transferable", "C01.M01", "H1"), _item("C02", "irrelevant", "C02.M01", "null"), _item("C03", "unknown", "null", "null", ""), _item("C04", "topic_related", "C01.M01", "H1"),
    _item("C05", "irrelevant", "C05.M01", "null"), _item("C05", "irrelevant", "C05.M01", "null"), _item("C06", "transferable", "C06.M01", "H9"), _item("C99", "irrelevant", "C99.M01", "null")]) + "]}"


@query("""WITH c AS (SELECT doc_id % 40 AS query_id, doc_id, text, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents WHERE doc_id < 240 AND doc_id % 40 IN (SELECT item_id FROM benchmark))
SELECT query_id, doc_id, CASE n WHEN 1 THEN 'transferable' WHEN 2 THEN 'irrelevant' ELSE 'unknown' END AS verdict, CASE n WHEN 1 THEN 'H1' END AS matched, CASE WHEN n <= 2 THEN true END AS quoted FROM c WHERE n = 3 OR n <= 2 AND length(trim(text)) > 0""")
def transfer_verdicts(spark, sf):
    """[R13, J7, T21] Of eight answers to each query three count."""
    c = _candidates(spark, sf)
    answers = _queries(spark, sf).select("query_id", F.lit(_ITEMS).alias("answer"))
    said = judging.verdicts(c, _hypotheses(spark, sf), answers).join(c.select("query_id", "item_id", "mechanism"), ["query_id", "item_id"])
    return said.select("query_id", F.col("item_id").alias("doc_id"), "verdict", F.col("hypothesis")["id"].alias("matched"), F.when(F.col("unit") != "", F.col("mechanism").contains(F.col("unit"))).alias("quoted"))


@query("""SELECT item_id, 'H1' AS id, 'sub one' AS subsystem, true AS quoted FROM benchmark""")
def transfer_hypotheses(spark, sf):
    """[R13, F16] Of three hypotheses one names a span and says what it is about; the answer is fenced."""
    h = _hypotheses(spark, sf).join(_queries(spark, sf), "query_id").select("query_id", "text", F.explode("hypotheses").alias("h"))
    return h.select(F.col("query_id").alias("item_id"), "h.id", "h.subsystem", F.col("text").contains(F.col("h.evidence")).alias("quoted"))


@query("""WITH c AS (SELECT doc_id % 40 AS q, doc_id, source, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM documents WHERE doc_id < 240)
SELECT item_id, trim(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 700)) AS issue, count(*)::INTEGER AS expected_items, list('C' || lpad(n::VARCHAR, 2, '0') ORDER BY n) AS candidate_ids, list(source ORDER BY n) AS problems
FROM benchmark JOIN c ON q = item_id WHERE n <= 20 GROUP BY item_id, text""")
def transfer_requests(spark, sf):
    """[R13] What the second stage is told."""
    r = judging.second_requests(_queries(spark, sf), _hypotheses(spark, sf), _candidates(spark, sf))
    body = F.from_json("request", "issue string, expected_items int, candidate_ids array<string>, cards array<struct<problem:string>>")
    return r.select(F.col("query_id").alias("item_id"), body.alias("b")).select("item_id", "b.issue", "b.expected_items", "b.candidate_ids", F.col("b.cards.problem").alias("problems"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '[查询时适用性推测：非历史事实，未经当前代码验证]' || chr(10) || '判定：可能可迁移。' || chr(10) || '目标根因假设：' || p_type || '；' || p_brand || '。' || chr(10) || '问题原文依据：e' || chr(10) || '历史机制摘录：' || p_name || chr(10) || '对应理由（推测）：r' ELSE '' END AS hint FROM part""")
def transfer_hints(spark, sf):
    """[R16]"""
    h = F.struct(F.col("p_type").alias("subsystem"), F.col("p_brand").alias("defect_shape"), F.lit("e").alias("evidence"))
    verdict = F.when(F.col("p_size") % 2 == 0, "transferable").otherwise("irrelevant")
    return table(spark, sf, "part").select("p_partkey", judging.transfer_hint(verdict, F.col("p_name"), h, F.lit("r")).alias("hint"))


def _timeline(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("position"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "role", "text")


_BATCHES = """t AS (SELECT conv_id, turn, (turn // 3)::INTEGER AS batch, role, text FROM conversations WHERE turn < 6),
h AS (SELECT conv_id, turn, role, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE turn < 3),
b AS (SELECT conv_id, batch, turn, role, text, 1 AS own FROM t UNION ALL SELECT conv_id, 1, turn, role, text, 0 FROM h WHERE before < 1200 AND conv_id IN (SELECT conv_id FROM t WHERE batch = 1))"""


@query(f"WITH {_BATCHES} SELECT conv_id AS session_id, batch, turn, (row_number() OVER (PARTITION BY conv_id, batch ORDER BY own, turn))::INTEGER AS place FROM b")
def extraction_batches(spark, sf):
    """[X22, T16] Batches of three chunks, two calls at most; the second begins with the session's opening."""
    return prompts.batches(_timeline(spark, sf), 3, 2).select("session_id", "batch", (F.col("position") - 1).alias("turn"), "place")


@query(f"""WITH {_BATCHES} SELECT conv_id AS session_id, batch, 'schema' || chr(10) || '{prompts.PIECES_LABEL}' || chr(10) || string_agg('<<<CHUNK ' || conv_id || ':' || turn || ' | session ' || conv_id || ' | role ' || role || '>>>' || chr(10) || text, chr(10) ORDER BY own, turn)
 || chr(10) || chr(10) || '{prompts.CLOSING}' AS prompt FROM b GROUP BY conv_id, batch""")
def extraction_prompts(spark, sf):
    """[X25] The conversations hold neither diffs nor assertions, so there is no digest."""
    return prompts.extraction_prompts(prompts.batches(_timeline(spark, sf), 3, 2), "schema")


@query(f"""SELECT p_partkey, '{prompts.DIGEST_DIFF_LABEL.rstrip()}' || chr(10) || '@@ -1 +1 @@ | +def fn_' || p_size || '(x): | +class C' || p_size || ':' || chr(10) || '{prompts.DIGEST_TEST_LABEL.rstrip()}' || chr(10) || 'assert f(' || p_size || ') | 3 PASSED' AS digest FROM (SELECT *, {PATCH} AS t FROM part)""")
def evidence_digest(spark, sf):
    """[X21] A diff, prose without either, and a text that asserts twice."""
    test = F.concat(F.lit("  assert f("), "size", F.lit(")\nprose\n3 PASSED"))
    return parts(spark, sf).select("p_partkey", prompts.digest(F.array("patch", F.lit("only prose"), test)).alias("digest"))


_SECTION = {name: label for name, label, _ in prompts.SECTIONS}


@query(f"""SELECT p_partkey AS session_id, 'head' || chr(10) || chr(10) || '{_SECTION['problem']}' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '{_SECTION['summary']}' || chr(10) || p_type ELSE '' END
 || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '{_SECTION['diff']}' || chr(10) || 'changed ' || p_size ELSE '' END || chr(10) || chr(10) || '{_SECTION['verify']}' || chr(10) || CASE WHEN p_size % 5 = 0 THEN '{prompts.NO_TESTS}' ELSE p_brand END || chr(10) || chr(10) || 'rules' AS prompt FROM part""")
def window_prompts(spark, sf):
    """[X26, X27]"""
    n, empty = F.col("p_size"), F.lit("")
    w = parts(spark, sf).select(
        F.col("p_partkey").alias("session_id"), F.col("p_name").alias("problem"), F.when(n % 2 == 0, F.col("p_type")).otherwise(empty).alias("summary"), empty.alias("root_cause"), F.concat(F.lit("changed "), "size").alias("diff"),
        empty.alias("tail"), empty.alias("testing"), empty.alias("digest"), F.when(n % 5 != 0, F.col("p_brand")).otherwise(empty).alias("verify"), (n % 3 == 0).alias("reconstructed"))
    return prompts.window_prompts(w, "head", "rules")


_WHY = {"problem": "problem 含line——改写为问题描述", "mechanism": "mechanism 含narration——只保留因果解释"}


@query(f"""WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, p_size FROM part),
l AS (SELECT p_brand, place, 'card' || place || ': ' || CASE p_size % 4 WHEN 1 THEN '{_WHY['problem']}' WHEN 2 THEN '{_WHY['mechanism']}' WHEN 3 THEN 'mechanism 缺失' END AS line FROM p)
SELECT p_brand AS session_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (place <= 4 AND line IS NOT NULL), '{prompts.REFUSED}') AS notes FROM l GROUP BY p_brand""")
def refusal_notes(spark, sf):
    """[X28, P19] Cards of a brand: fit, a line number in the problem, a fix in the mechanism, no mechanism."""
    n = F.col("p_size") % 4
    p = table(spark, sf, "part").withColumn("at", F.row_number().over(prompts.Window.partitionBy("p_brand").orderBy("p_partkey")))
    told = p.select(F.col("p_brand").alias("session_id"), "at", F.when(n == 1, "fails at line 3").otherwise(F.lit("it fails")).alias("problem"), F.when(n == 2, "we added a guard").when(n != 3, F.lit("a cache is stale")).alias("mechanism"))
    return prompts.notes(prompts.card_problems(told))


def _obedient(prompt: str) -> str:
    """A stand-in for a model: it mends its answer when it is told why."""
    return "mended" if "card1:" in prompt else prompt[-1]


@query("""SELECT p_partkey, CASE WHEN p_size % 10 < 5 THEN 'mended' ELSE (p_size % 10)::VARCHAR END AS answer, CASE WHEN p_size % 10 < 5 THEN 2 ELSE 1 END AS calls FROM part""")
def repaired_answers(spark, sf):
    """[X23, X28, T13] Answers below 5 are refused once."""
    p = parts(spark, sf).select(F.col("p_partkey").alias("prompt_id"), F.concat(F.lit("n="), "size").alias("prompt"))
    check = lambda a: a.where("answer < '5'").select("prompt_id", F.lit("card1: too small").alias("notes"))
    return models.repaired(models.limited(p, 4), _obedient, check).select(F.col("prompt_id").alias("p_partkey"), "answer", "calls")


@query("SELECT item_id FROM benchmark WHERE item_id % 2 = 1")
def cached_verdicts(spark, sf):
    """[T21, J10] Every second request was judged before."""
    asked = judging.first_requests(_queries(spark, sf))
    before = models.unjudged(asked, spark.createDataFrame([], "key string")).where("query_id % 2 = 0").select("key")
    return models.unjudged(asked, before).select(F.col("query_id").alias("item_id"))
