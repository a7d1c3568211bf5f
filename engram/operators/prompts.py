"""What a model is asked when cards are drawn from sessions: batches of chunks, digests, prompts, notes on refused cards.

Chunks of a session come as one timeline (store.session_chunks). What is gathered per session or batch is bounded by the
validation of requests and by BATCH_CHUNKS.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import extraction
from engram.operators.rendering import strip

# Sizes, patterns and the texts of the prompts.
BATCH_CHUNKS, MOST_CALLS, PREFIX_CHUNKS, PREFIX_CHARS = 600, 5, 3, 1200
DIFF_DIGEST, TEST_DIGEST, MOST_DIGEST, MOST_HUNKS, MOST_TEST_LINES, LINE_CHARS = 1300, 1200, 2600, 12, 8, 120
CHANGE_LINE = r"(?m)^@@.*$|^[-+][^-+].*$"
TEST_LINE = r"(?i)(?:assert\b|def test_|raises\b|pytest\.raises|assert_equal|assert_allclose|assert_raises|FAILED|PASSED)"
DIGEST_DIFF_LABEL = "diff 分支结构（@@ 上下文与决定性增删行）:\n"
DIGEST_TEST_LABEL = "测试断言行（逐字）:\n"
DIGEST_LABEL = "证据预消化（机械提取，仅供 implement 三段断言引用，不得虚构其外内容）："
PIECES_LABEL = "历史片段（按来源顺序）："
CLOSING = "只输出 JSON。kind 只能是 debug 或 feature；字段没有依据时留空；files/conditions 必须来自上述 chunk；source_chunk_ids 必须来自上述 chunk。"
FEWER = "\n注意：本次最多输出 {} 张 card，优先保证 JSON 完整；放不下的内容留空，不要续写。"
SECTIONS = (
    ("problem", "## 历史问题原文（problem 的来源；保留 issue 词汇与报错串）", 4000), ("summary", "## 会话最终总结（mechanism 的首选来源；修复/方案段落已移除）", 5500),
    ("root_cause", "## 总结中的根因摘录（mechanism 的优先来源）", 5500), ("diff", "## 历史最终修复补丁（mechanism 的重构来源；只解释它为什么能修复，不得复述改动本身）", 4000),
    ("tail", "## 会话尾部分析（无最终总结时的辅助来源；只读）", 2500), ("testing", "## 总结中的验收/测试清单（verify 的来源之一；不是 mechanism）", 1600),
    ("digest", "## 机械提取的测试断言（verify 的来源之一）", 1800), ("verify", "## 历史测试/验证证据（verify 的来源；可能含历史命令，只读）", 3500))
NO_TESTS = "(未找到测试输出)"
REFUSED = "上一轮的 card 没有通过程序化准入"
MOST_CARDS, MOST_PROBLEMS = 4, 3


def batches(chunks: DataFrame, size: int = BATCH_CHUNKS, most: int = MOST_CALLS) -> DataFrame:
    """chunks: session_id, position (from 1), chunk_id, text. Adds batch (from 0, the first `most`) and place in it. Later batches begin with the
    opening of the session: its first chunks up to PREFIX_CHUNKS, as long as those before have less than PREFIX_CHARS characters."""
    rows = chunks.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int")).where(F.col("batch") < most)
    head = chunks.where(F.col("position") <= PREFIX_CHUNKS)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = head.withColumn("_before", before).where(F.col("_before") < PREFIX_CHARS).drop("_before")
    later = rows.where("batch > 0").select("session_id", "batch").distinct()
    both = rows.withColumn("_own", F.lit(1)).unionByName(head.join(later, "session_id").withColumn("_own", F.lit(0)).select(*rows.columns, "_own"))
    order = Window.partitionBy("session_id", "batch").orderBy("_own", "position")
    return both.withColumn("place", F.row_number().over(order)).drop("_own")


def digest(texts: Column) -> Column:
    """Of chunk texts in order: the lines that change something, and those that assert something, each kind until its budget is reached, with a
    label; empty where there are none. A diff counts as such until the budget of diffs is reached, then as any text."""
    clip = lambda values, most: F.nullif(F.array_join(F.transform(F.slice(values, 1, most), lambda x: F.substring(strip(x), 1, LINE_CHARS)), " | "), F.lit(""))
    asserted = lambda text: F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: x.rlike(TEST_LINE))
    blocks = F.transform(texts, lambda t: F.struct(t.contains("diff --git").alias("is_diff"), clip(F.regexp_extract_all(t, F.lit(CHANGE_LINE), F.lit(0)), MOST_HUNKS).alias("diff"), clip(asserted(t), MOST_TEST_LINES).alias("test")))
    size = lambda lines_: F.aggregate(lines_, F.lit(0), lambda n, x: n + F.length(x))

    def step(state: Column, b: Column) -> Column:
        as_diff = b["is_diff"] & (size(state["diffs"]) < DIFF_DIGEST)
        as_test = ~as_diff & (size(state["tests"]) < TEST_DIGEST)
        more = lambda lines_, x, ok: F.when(ok & x.isNotNull(), F.concat(lines_, F.array(x))).otherwise(lines_)
        return F.struct(more(state["diffs"], b["diff"], as_diff).alias("diffs"), more(state["tests"], b["test"], as_test).alias("tests"))

    none = F.array().cast("array<string>")
    label = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name), F.array_join(c, "\n")))
    finish = lambda s: F.substring(F.concat_ws("\n", label(DIGEST_DIFF_LABEL, s["diffs"]), label(DIGEST_TEST_LABEL, s["tests"])), 1, MOST_DIGEST)
    return F.aggregate(blocks, F.struct(none.alias("diffs"), none.alias("tests")), step, finish)


def extraction_prompts(batched: DataFrame, opening: str = "") -> DataFrame:
    """batched: batches() with role. session_id, batch, prompt: the opening (schema and rules), the digest, then the chunks in order under marks
    that name them."""
    block = F.concat(F.lit("<<<CHUNK "), "chunk_id", F.lit(" | session "), F.col("session_id").cast("string"), F.lit(" | role "), "role", F.lit(">>>\n"), "text")
    per = batched.groupBy("session_id", "batch").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block"), "text"))).alias("rows"))
    told = digest(F.transform("rows", lambda r: r["text"]))
    parts = F.array_compact(F.array(
        F.nullif(F.lit(opening), F.lit("")), F.when(told != "", F.concat(F.lit(DIGEST_LABEL + "\n"), told, F.lit("\n"))), F.lit(PIECES_LABEL), F.array_join(F.transform("rows", lambda r: r["block"]), "\n"), F.lit("\n" + CLOSING)))
    return per.select("session_id", "batch", F.array_join(parts, "\n").alias("prompt"))


def window_prompts(windows: DataFrame, head: str = "", rules: str = "") -> DataFrame:
    """windows: evidence.windows(). session_id, prompt: the evidence of an idea-level card by section, each under its ceiling; sections without
    text go, but for the problem and the tests. A session without a closing summary shows its changes in place of one."""
    cut = lambda name, most: F.substring(F.coalesce(F.col(name), F.lit("")), 1, most)
    parts = [F.nullif(F.lit(head), F.lit(""))]
    for name, label, most in SECTIONS:
        text = cut(name, most)
        if name == "verify":
            text = F.when(text == "", F.lit(NO_TESTS)).otherwise(text)
        shown = F.concat(F.lit(f"\n{label}\n"), text)
        if name in ("diff", "tail"):
            shown = F.when(F.col("reconstructed") & ((text != "") | F.lit(name == "diff")), shown)
        elif name not in ("problem", "verify"):
            shown = F.when(text != "", shown)
        parts.append(shown)
    parts.append(F.when(F.lit(rules != ""), F.lit(f"\n{rules}")))
    return windows.select("session_id", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("prompt"))


def system_prompt(version: Column, prompts: dict[str, str], other: str) -> Column:
    """The prompt of a version, `other` for versions without one."""
    out = F.lit(other)
    for name, text in prompts.items():
        out = F.when(version == name, F.lit(text)).otherwise(out)
    return out


def card_problems(proposed: DataFrame) -> DataFrame:
    """proposed: card_id, problem, mechanism. Adds problems: why an idea-level card is refused, by name."""
    missing = lambda c, name: F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.lit(f"{name} 缺失"))
    of = lambda name, found, after: F.when(F.size(found) > 0, F.concat(F.lit(f"{name} 含"), F.array_join(found, "/"), F.lit(after)))
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    absent = F.array_compact(F.array(missing("problem", "problem"), missing("mechanism", "mechanism")))
    found = F.array_compact(F.array(of("problem", extraction.problem_hazards(given("problem")), "——改写为问题描述"), of("mechanism", extraction.hazards(given("mechanism")), "——只保留因果解释")))
    return proposed.withColumn("problems", F.when(F.size(absent) > 0, absent).otherwise(found))


def notes(refused: DataFrame) -> DataFrame:
    """refused: session_id, at (place of the card in the answer, from 1), problems. session_id, notes: for the first MOST_CARDS cards up to
    MOST_PROBLEMS problems each, to be told to the model once more."""
    line = F.concat(F.lit("card"), F.col("at").cast("string"), F.lit(": "), F.array_join(F.slice("problems", 1, MOST_PROBLEMS), "；"))
    bad = F.when((F.col("at") <= MOST_CARDS) & (F.size("problems") > 0), F.struct("at", line.alias("line")))
    told = F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["line"])
    return refused.groupBy("session_id").agg(told.alias("t")).select("session_id", F.when(F.size("t") > 0, F.array_join("t", "\n")).otherwise(F.lit(REFUSED)).alias("notes"))
