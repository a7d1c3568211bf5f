"""The two-stage judge of whether a past case carries over: what it is asked, and which of its answers count.

Stage one asks for hypotheses on a query's numbered spans, stage two for a verdict on each candidate that names a span of the
candidate's own mechanism. Answers are tables of texts; ids are checked here and texts filled in from the spans, so a
verdict can't quote what nobody wrote. Candidates of a query are cut to MOST_CANDIDATES before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import cards
from engram.operators.rendering import strip
from engram.sources import models

# Sizes, labels, texts of the hint.
MOST_CANDIDATES, MOST_HYPOTHESES = 20, 4
ISSUE_CHARS, MECHANISM_CHARS, SHORT_ISSUE, SHORT_PROBLEM, HYPOTHESIS_CHARS, REASON_CHARS = 1800, 900, 700, 600, 140, 160
VERDICTS = ("transferable", "topic_related", "irrelevant", "unknown")
HYPOTHESES = "hypotheses array<struct<subsystem:string,defect_shape:string,evidence_id:string>>"
ITEMS = "items array<struct<id:string,verdict:string,root_cause_unit_id:string,matched_hypothesis:string,reason:string>>"


def clipped(text: Column, most: int) -> Column:
    """White space collapsed, at most so many characters."""
    return F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, most)


def first_requests(queries: DataFrame) -> DataFrame:
    """queries: query_id, text. query_id, request: the spans of each query."""
    return queries.select("query_id", F.to_json(F.struct(cards.spans(F.col("text"), "Q", ISSUE_CHARS).alias("issue_evidence"))).alias("request"))


def hypotheses(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """queries: query_id, text; answers: query_id, answer. query_id, hypotheses: of the first MOST_HYPOTHESES that were given, those that name a span
    and say what and how, numbered H1, H2, ...; queries without any don't appear."""
    said = models.parsed_answer(F.col("answer"), HYPOTHESES)["hypotheses"]
    spans = cards.spans(F.col("text"), "Q", ISSUE_CHARS)
    rows = queries.join(answers, "query_id").select("query_id", spans.alias("spans"), F.slice(F.coalesce(said, F.array().cast("array<struct<subsystem:string,defect_shape:string,evidence_id:string>>")), 1, MOST_HYPOTHESES).alias("said"))
    text = lambda h: F.try_element_at(F.transform(F.filter("spans", lambda s: s["id"] == h["evidence_id"]), lambda s: s["text"]), F.lit(1))
    full = F.transform("said", lambda h: F.struct(clipped(h["subsystem"], HYPOTHESIS_CHARS).alias("subsystem"), clipped(h["defect_shape"], HYPOTHESIS_CHARS).alias("defect_shape"), h["evidence_id"].alias("evidence_id"), text(h).alias("evidence")))
    good = F.filter(full, lambda h: h["evidence"].isNotNull() & (h["subsystem"] != "") & (h["defect_shape"] != ""))
    numbered = F.transform(good, lambda h, i: F.struct(F.concat(F.lit("H"), (i + 1).cast("string")).alias("id"), h["subsystem"].alias("subsystem"), h["defect_shape"].alias("defect_shape"), h["evidence_id"].alias("evidence_id"), h["evidence"].alias("evidence")))
    return rows.select("query_id", numbered.alias("hypotheses")).where(F.size("hypotheses") > 0)


def candidates(ranked: DataFrame) -> DataFrame:
    """ranked: query_id, item_id, rank, problem, mechanism. Adds alias (C01, C02, ... in order of rank) and units, the spans of the mechanism; the first
    MOST_CANDIDATES of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id"))
    rows = ranked.withColumn("_n", place).where(F.col("_n") <= MOST_CANDIDATES).withColumn("alias", F.format_string("C%02d", "_n")).drop("_n")
    own = F.transform(cards.spans(F.col("mechanism"), "M", MECHANISM_CHARS), lambda s: F.struct(F.concat("alias", F.lit("."), s["id"]).alias("id"), s["text"].alias("text")))
    return rows.withColumn("units", own)


def second_requests(queries: DataFrame, found: DataFrame, candidates_: DataFrame) -> DataFrame:
    """query_id, request: the query in short, its hypotheses and its candidates."""
    card = F.struct(F.col("alias").alias("id"), clipped(F.col("problem"), SHORT_PROBLEM).alias("problem"), F.col("units").alias("mechanism_evidence"))
    per = candidates_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("alias", card.alias("card")))).alias("c"))
    rows = queries.join(found, "query_id").join(per, "query_id")
    ids = F.transform("c", lambda x: x["alias"])
    body = F.struct(clipped(F.col("text"), SHORT_ISSUE).alias("issue"), "hypotheses", ids.alias("candidate_ids"), F.size("c").alias("expected_items"), F.transform("c", lambda x: x["card"]).alias("cards"))
    return rows.select("query_id", F.to_json(body).alias("request"))


def verdicts(candidates_: DataFrame, found: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: query_id, answer of stage two. query_id, item_id, verdict, unit, hypothesis (struct or null), reason. A verdict counts if its candidate was
    asked for and answered once, its label is known, and (but for unknown) it names a span of the candidate's own and a reason; one
    that carries over must match a hypothesis."""
    said = answers.select("query_id", F.explode(models.parsed_answer(F.col("answer"), ITEMS)["items"]).alias("s")).where("s.id IS NOT NULL")
    once = Window.partitionBy("query_id", "s.id")
    said = said.withColumn("_n", F.count("*").over(once)).where("_n = 1").select("query_id", F.col("s")["id"].alias("alias"), "s")
    rows = candidates_.select("query_id", "item_id", "alias", "units").join(said, ["query_id", "alias"]).join(found, "query_id")
    first = lambda values: F.try_element_at(values, F.lit(1))
    unit = F.coalesce(first(F.transform(F.filter("units", lambda u: u["id"] == F.col("s")["root_cause_unit_id"]), lambda u: u["text"])), F.lit(""))
    matched = first(F.filter("hypotheses", lambda h: h["id"] == F.col("s")["matched_hypothesis"]))
    rows = rows.select("query_id", "item_id", F.col("s")["verdict"].alias("verdict"), unit.alias("unit"), matched.alias("hypothesis"), clipped(F.col("s")["reason"], REASON_CHARS).alias("reason"))
    told = (F.col("verdict") == "unknown") | ((F.col("unit") != "") & (F.col("reason") != ""))
    return rows.where(F.col("verdict").isin(*VERDICTS) & told & ((F.col("verdict") != "transferable") | F.col("hypothesis").isNotNull()))


def transfer_hint(verdict: Column, unit: Column, hypothesis: Column, reason: Column) -> Column:
    """What is said of a case that may carry over; empty for others."""
    text = F.concat(
        F.lit("\n\n[查询时适用性推测：非历史事实，未经当前代码验证]\n判定：可能可迁移。\n目标根因假设："), hypothesis["subsystem"], F.lit("；"), hypothesis["defect_shape"],
        F.lit("。\n问题原文依据："), hypothesis["evidence"], F.lit("\n历史机制摘录："), F.coalesce(unit, F.lit("")), F.lit("\n对应理由（推测）："), F.coalesce(reason, F.lit("")))
    return F.when((verdict == "transferable") & hypothesis.isNotNull(), text).otherwise(F.lit(""))
