"""What happens to a ranked list: deduplication, judgements, floors, budgets.

Judgements (verdicts, rerank scores) are tables joined by query and item, so each result can be reproduced offline.
Steps in which a pick depends on earlier picks run as one fold over the at most POOL_SIZE rows of a query.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed values of the output stage.
POOL_SIZE = 200
TIERS = ((10, 1600), (30, 1000), (60, 700))
LAST_TIER = 450
SCORE_RATIO, LEAST_ITEMS, TOKEN_CAP = 0.15, 2, 96_000
JUDGE_SCALE, RERANK_ALPHA, RERANK_CANDIDATES = 0.010, 0.3, 20
VERDICT_BASE = {"yes": 1.0, "unknown": 0.35, "no": 0.0}


def effective_top_k(asked: Column, most: int = 100, shown: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(asked, F.lit(most), F.lit(shown)))


def fingerprint(text: Column) -> Column:
    """Of a text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")).cast("binary"), 256)


def first_of_each_text(ranked: DataFrame, text: str = "text") -> DataFrame:
    """ranked: query_id, rank, text. Of equal texts of a query the best ranked stays."""
    order = Window.partitionBy("query_id", fingerprint(F.col(text))).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tier_cap(rank: Column) -> Column:
    out = F.lit(LAST_TIER)
    for last, cap in reversed(TIERS):
        out = F.when(rank <= last, F.lit(cap)).otherwise(out)
    return out


def floor_of(scored: DataFrame, ratio: float = SCORE_RATIO, least: float = 0.0) -> DataFrame:
    """scored: query_id, score. Adds floor: the higher of least and ratio times the query's best; infinite where the best is
    not above 0."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("floor", F.when(best > 0, F.greatest(F.lit(least), best * max(0.0, ratio))).otherwise(F.lit(float("inf"))))


def admit(ranked: DataFrame, ratio: float = SCORE_RATIO, least: float = 0.0, least_items: int = LEAST_ITEMS) -> DataFrame:
    """ranked: query_id, rank, score, in order of score. Rows at or above the floor, and the first least_items in any case. As scores
    fall with rank, the number emitted before a row is its rank less one until the first row below the floor."""
    return floor_of(ranked, ratio, least).where((F.col("score") >= F.col("floor")) | (F.col("rank") <= max(0, least_items)))


def spread_files(ranked: DataFrame, after: int = 2) -> DataFrame:
    """ranked: query_id, item_id, rank, files (array); what lies beyond a pool's size in rank goes. Beyond the first `after` picks, an item
    that shares a file with the picked ones goes behind those that don't, in order; ties of rank go by item_id. Adds position."""
    ranked = ranked.where(F.col("rank") <= POOL_SIZE)
    row = F.struct("rank", "item_id", F.struct(*ranked.columns).alias("row"))
    before = lambda a, b: (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["item_id"] < b["item_id"]))
    rows = F.transform(F.array_sort("rows", lambda a, b: F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)), lambda r: r["row"])
    kind = f"array<{T.StructType([T.StructField(f.name, f.dataType) for f in ranked.schema.fields]).simpleString()}>"
    none, no_files = F.array().cast(kind), F.array().cast("array<string>")

    def step(state: Column, r: Column) -> Column:
        files = F.coalesce(r["files"], no_files)
        waits = (F.size(state["picked"]) >= after) & F.coalesce(F.arrays_overlap(files, state["seen"]), F.lit(False))
        late = F.struct(state["picked"].alias("picked"), F.concat(state["late"], F.array(r)).alias("late"), state["seen"].alias("seen"))
        return F.when(waits, late).otherwise(F.struct(F.concat(state["picked"], F.array(r)).alias("picked"), state["late"].alias("late"), F.array_union(state["seen"], files).alias("seen")))

    start = F.struct(none.alias("picked"), none.alias("late"), no_files.alias("seen"))
    order = ranked.groupBy("query_id").agg(F.collect_list(row).alias("rows")).select(F.aggregate(rows, start, step, lambda s: F.concat(s["picked"], s["late"])).alias("rows"))
    return order.select(F.posexplode("rows").alias("at", "row")).select("row.*", (F.col("at") + 1).cast("int").alias("position"))


def within_budget(ranked: DataFrame, cap: int = TOKEN_CAP) -> DataFrame:
    """ranked: query_id, rank, tokens; what lies beyond a pool's size in rank goes. An item that doesn't fit into what is left is passed
    over; later ones may fit."""
    ranked = ranked.where(F.col("rank") <= POOL_SIZE)
    rows = F.array_sort(F.collect_list(F.struct("rank", "tokens")))

    def step(state: Column, row: Column) -> Column:
        fits = state["used"] + row["tokens"] <= cap
        return F.when(fits, F.struct((state["used"] + row["tokens"]).alias("used"), F.concat(state["ranks"], F.array(row["rank"])).alias("ranks"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))
    typed = ranked.withColumn("tokens", F.col("tokens").cast("long")).withColumn("rank", F.col("rank").cast("int"))
    taken = typed.groupBy("query_id").agg(F.aggregate(rows, start, step, lambda s: s["ranks"]).alias("taken"))
    return ranked.join(taken.select("query_id", F.explode("taken").alias("rank")), ["query_id", "rank"], "left_semi")


def judged(ranked: DataFrame, verdicts: DataFrame, scale: float = JUDGE_SCALE) -> DataFrame:
    """ranked: query_id, item_id, score; verdicts: query_id, item_id, verdict, confidence. Unknown labels, items and repeated
    verdicts count as none; a missing confidence is one half."""
    ok = verdicts.where(F.col("verdict").isin(*VERDICT_BASE)).withColumn("_n", F.count("*").over(Window.partitionBy("query_id", "item_id"))).where("_n = 1")
    base = F.create_map(*[F.lit(x) for kv in VERDICT_BASE.items() for x in kv])[F.col("verdict")]
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    joined = ranked.join(ok.select("query_id", "item_id", "verdict", "confidence"), ["query_id", "item_id"], "left")
    return joined.withColumn("score", F.col("score") + F.coalesce(F.lit(scale) * base * (0.5 + 0.5 * confidence), F.lit(0.0))).drop("confidence")


def reranked(ranked: DataFrame, scores: DataFrame, alpha: float = RERANK_ALPHA, candidates: int = RERANK_CANDIDATES) -> DataFrame:
    """ranked: query_id, item_id, rank; scores: query_id, item_id, rerank. The first candidates mix their clamped score with
    a prior that falls with rank; the others get the least of those less 0.001. A query without a score for each of its
    candidates, or with a single item, keeps its ranks' order (score null); an item that is scored twice counts as without a
    score. The prior takes ranks for positions: rows whose ranks have gaps or repeat are to be numbered first."""
    of = Window.partitionBy("query_id")
    scores = scores.groupBy("query_id", "item_id").agg(F.when(F.count("*") == 1, F.max("rerank")).alias("rerank"))
    rows = ranked.join(scores, ["query_id", "item_id"], "left").withColumn("_in", F.col("rank") <= candidates)
    rows = rows.withColumn("_n", F.sum(F.col("_in").cast("int")).over(of)).withColumn("_ok", (F.count("*").over(of) >= 2) & (F.sum((F.col("_in") & F.col("rerank").isNull()).cast("int")).over(of) == 0))
    prior = (F.col("_n") - F.col("rank") + 1) / F.col("_n")
    mixed = alpha * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rerank"))) + (1 - alpha) * prior
    rows = rows.withColumn("score", F.when(F.col("_ok") & F.col("_in"), mixed))
    rows = rows.withColumn("score", F.when(F.col("_ok"), F.coalesce("score", F.min("score").over(of) - 0.001)))
    return rows.drop("_in", "_n", "_ok", "rerank")


def grouped_by_transfer(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Transferable items first, irrelevant ones last, the order within kept. Adds position."""
    place = F.when(F.col("verdict") == "transferable", 0).when(F.col("verdict") == "irrelevant", 2).otherwise(1)
    rows = ranked.join(verdicts, ["query_id", "item_id"], "left").withColumn("_g", place)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_g", "rank"))).drop("_g")
