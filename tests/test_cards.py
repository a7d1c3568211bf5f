"""Rendering, grounding, session evidence and model connectors on hand-written fixtures."""
import json

import pytest
from pyspark.sql import functions as F

from engram.operators import cards, evidence, rendering
from engram.sources import models

PATCH = "diff --git a/src/a.py b/src/a.py\nindex 1..2\n--- a/src/a.py\n+++ b/src/a.py\n@@ -10,3 +10,4 @@ def foo(x):\n context\n-    return x + value\n+    return x - value\n@@\n-old\n"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_change_blocks(spark):
    text = one(spark, rendering.change_blocks(F.col("p")), p=PATCH)
    first, second = text.split("\n\n")
    assert first.split("\n") == ["文件：src/a.py", "位置：第 10 行 · def foo(x):", rendering.ANCHOR_LABEL + "return x + value", "修改前：", "    return x + value", "修改后：", "    return x - value"]
    assert second.endswith("修改前：\nold\n修改后：\n(无)")
    assert one(spark, rendering.change_blocks(F.col("p")), p="") == "" and one(spark, rendering.change_blocks(F.col("p")), p="@@ -1 +1 @@\n+" + "y" * 2000).endswith(rendering.CHANGE_CUT)


def test_change_summary_holds_no_code(spark):
    text = one(spark, rendering.change_summary(F.col("p"), F.array(F.lit("src/a.py")), F.array(F.lit("foo"))), p=PATCH)
    assert "return x" not in text and "改动位置：def foo(x):" in text and "return, value, old" in text


@pytest.fixture(scope="module")
def card(spark):
    return spark.createDataFrame(
        [(1, "p" * 100, ["src/a.py"], ["foo"], PATCH, "pytest tests", "1 passed", ["pit"], [("test_name", "t.py::test_a"), ("error", "KeyError")])],
        "item_id int, problem string, files array<string>, symbols array<string>, patch string, cmd string, result string, pitfalls array<string>, conditions array<struct<type:string,value:string>>")


@pytest.mark.parametrize("cap,holds,lacks", [(1000, ["坑：pit", "修改前"], []), (60, ["p" * 100, "结果：1 passed"], ["坑", "修改前"]), (40, ["ppp …", "文件：src/a.py"], ["p" * 100]), (20, ["历史修复案例"], ["结果"])])
def test_packet_gives_way_in_order(spark, card, cap, holds, lacks):
    text = rendering.rendered(card, F.lit(cap)).first().content
    assert all(h in text for h in holds) and not any(x in text for x in lacks)
    assert int(len(text) / 3.2) + 1 <= cap + 1


def test_packet_edges(spark, card):
    closed = rendering.rendered(card.withColumn("locate", F.lit("look at src/a.py and test_zeta")), F.lit(1000), F.lit(False)).first().content
    assert "修改前" not in closed and "look at （历史文件） and （历史测试）" in closed and "文件：" not in closed
    assert rendering.rendered(card, F.lit(0)).first().content == ""
    assert rendering.rendered(spark.createDataFrame([(None,)], "problem string"), F.lit(100)).first().content == ""
    assert rendering.rendered(card.limit(0), F.lit(100)).count() == 0
    assert "历史改法（仅作参考" in rendering.rendered(card, F.lit(1000), change="summary").first().content


def test_idea_is_whole_or_absent(spark):
    text = lambda cap, m="why": one(spark, rendering.idea(F.lit("what"), F.lit(m), F.array(F.lit("holds")), F.array(F.struct(F.lit("edge").alias("case"), F.lit("ok").alias("expected"))), F.lit(cap)), x="")
    assert text(200).endswith("- holds\n边界：\n- edge → 期望：ok") and text(10) == "" and text(200, "") == ""


def test_judge_prompt_stops_at_the_first_case_that_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "broken", r, r, "x" * n) for r, n in ((1, 100), (2, 200), (3, 1))], "query_id int, query string, rank int, item_id int, problem string")
    prompt = rendering.judge_prompts(rows, 250).first().prompt
    assert "experience:1" in prompt and "experience:2" not in prompt and "experience:3" not in prompt and prompt.startswith("# 当前 issue\nbroken")


def test_prose_loses_what_the_evidence_lacks(spark):
    strip = lambda t: one(spark, cards.strip_ungrounded(F.col("t"), F.lit("in src/a.py foo.bar raised keyerror")), t=t)
    assert strip("see src/a.py and lib/b.py , then foo.bar (np.sum) KeyError TypeError") == "see src/a.py and, then foo.bar () KeyError"
    assert strip("lib/b.py") is None and strip(None) is None and strip("plain words") == "plain words"


def test_pitfall_grounding(spark):
    held = lambda t: one(spark, cards.pitfall_grounded(F.col("t"), F.lit("we tried cache_reset with this error")), t=t)
    assert held("calling cache_reset loops") and held("with  this ERROR") and not held("error test failed") and not held("something vague")


def test_admission_of_cards(spark):
    names = "card_id string, session_id string, problem string, locate string, implement string, shape string, boundaries string, acceptance string, mechanism string, files array<string>, symbols array<string>, pitfalls array<string>, conditions array<struct<type:string,value:string>>, source_ids array<string>"

    def proposal(i, **change):
        base = dict(problem="fails in src/a.py", locate=None, implement="guard foo", shape=None, boundaries=None, acceptance=None, mechanism=None, files=["src/a.py", "lib/x.py"], symbols=["foo", "zap"], pitfalls=["vague"],
                    conditions=[("symbol", "KeyError"), ("line", "foo"), ("error", "TypeError")], source_ids=["c1", "zz"])
        return (i, "s1", *{**base, **change}.values())

    chunks = spark.createDataFrame([("c1", "s1", "src/a.py foo raised KeyError"), ("c9", "s2", "other")], "chunk_id string, session_id string, text string")
    proposed = [proposal("ok"), proposal("no problem", problem=" "), proposal("foreign", source_ids=["c9"]), proposal("no change", implement=None), proposal("emptied", problem="lib/only.py"),
                proposal("labelled", implement="implement_shape: wraps it implement_boundaries: none"), proposal("nulls", files=None, symbols=None, pitfalls=None, conditions=None)]
    got = {r.card_id: r for r in cards.admitted(spark.createDataFrame(proposed, names), chunks).collect()}
    assert set(got) == {"ok", "labelled", "nulls"}
    ok = got["ok"]
    assert (ok.files, ok.symbols, ok.pitfalls, ok.source_ids, [tuple(c) for c in ok.conditions]) == (["src/a.py"], ["foo"], [], ["c1"], [("error", "KeyError")])
    assert (got["labelled"].implement, got["labelled"].shape, got["labelled"].boundaries) == (None, "wraps it", "none")


def test_conditions(spark):
    text = 'File "src/b.py", line 12\nFAILED tests/t.py::test_x\nKeyError TypeError tests/t.py::test_x'
    c = one(spark, cards.conditions(F.lit(None), F.array(F.lit("pkg/mod/a.py")), F.lit("version 1.2 gives KeyError"), F.col("t")), t=text)
    assert [tuple(x) for x in c] == [("module", "pkg/mod"), ("version", "1.2"), ("test_name", "tests/t.py::test_x"), ("frame", "src/b.py:12"), ("error", "KeyError")]


def test_small_predicates(spark):
    assert one(spark, cards.is_setup(F.col("t")), t="$ pip install x") and not one(spark, cards.is_setup(F.col("t")), t="git clone " + "y" * 2000)
    assert one(spark, cards.quotes_patch(F.lit("It does RETURN a plus  b today"), F.col("t")), t="+return a plus b") and not one(spark, cards.quotes_patch(F.lit("return a"), F.col("t")), t="+return a")
    assert one(spark, cards.clamped_files(F.col("f"), F.array(F.lit("x/a.py"))), f=["s/a.py", "b.py"]) == ["s/a.py"] and one(spark, cards.clamped_files(F.col("f"), F.array(F.lit("z.py"))), f=["b.py"]) == ["b.py"]
    gate = lambda anchors, patch="p": one(spark, cards.shows_patch(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in anchors]).cast("array<struct<kind:string,value:string>>"), F.array(F.lit("src/A.py")), F.lit("uses my_fn"), F.lit(patch)), x="")
    assert gate([]) and gate([("path", "lib/a.py")]) and gate([("symbol", "my_fn")]) and gate([("symbol", "Grid")], "")
    assert not gate([("symbol", "Grid")]) and not gate([("path", "b.py")])


SUMMARY = "## Problem\nThe cache was stale because keys were shared between tenants and nothing told them apart, so that one saw the other's rows.\n\n## The Fix\nAdded a prefix.\n\n## Testing\nTwo tenants read the same key.\n" + "More about the analysis of it. " * 12


def session(spark, summary=SUMMARY):
    rows = [("s", 0, "m0", "user", "prose", "c0", "It breaks"), ("s", 1, "m1", "assistant", "test_result", "c1", "3 passed, 1 failed\ndef test_cache():\n    assert cache.get(1) == 2\n" + "x" * 40),
            ("s", 2, "m1", "assistant", "test_result", "c2", "1 failed\nassert other == 2 " + "y" * 60), ("s", 3, "m2", "assistant", "diff", "c3", "diff --git a/tests/t.py b/tests/t.py\n@@ -1 +1 @@\n+def test_new():\n+    assert fresh\n"),
            ("s", 4, "m3", "assistant", "prose", "c4", "nothing to see here " * 5), ("s", 5, "m4", "assistant", "prose", "c5", summary)]
    return spark.createDataFrame(rows, "session_id string, pos int, message_id string, role string, kind string, chunk_id string, text string")


def test_session_window(spark):
    w = evidence.windows(session(spark)).first()
    assert w.problem == "It breaks" and not w.reconstructed and w.diff == "" and w.testing.startswith("Two tenants read the same key.")
    assert "stale because" in w.root_cause and "Added a prefix" not in w.summary
    assert "def test_new" in w.verify and "assert cache.get(1) == 2" in w.verify and "assert other" not in w.verify and "nothing to see" not in w.verify
    assert "assert fresh" in w.digest.split("\n")


def test_session_without_a_summary_is_rebuilt_from_its_changes(spark):
    w = evidence.windows(session(spark, "done")).first()
    assert w.reconstructed and w.diff.startswith("diff --git") and w.summary == "" and w.root_cause == ""


def test_patches(spark):
    text = "intro\ndiff --git a/src/a.py b/src/a.py\n@@ -1 +1 @@\n-a\n+b\nAll done\ndiff --git a/repro.py b/repro.py\n@@\n+x\n"
    call = lambda **k: "[工具调用] Edit " + json.dumps(k)
    rows = [("d", 1, "m", text), ("d", 2, "n", text), ("e", 1, "m", call(file_path="src/b.py", old_string="a", new_string="b\nc") + "\n" + call(path="repro.py", new_str="z") + "\n[工具调用] Edit {bad}"), ("none", 1, "m", "-rw listing")]
    got = {r.session_id: r.patch for r in evidence.patches(spark.createDataFrame(rows, "session_id string, pos int, message_id string, text string")).collect()}
    assert got == {"d": "diff --git a/src/a.py b/src/a.py\n@@ -1 +1 @@\n-a\n+b", "e": "--- a/src/b.py\n+++ b/src/b.py\n@@\n-a\n+b\n+c"}


def test_vectors_come_from_the_cache_first(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "gamma"), (4, None)], "item_id int, text string")
    empty = spark.createDataFrame([], "key string, vec array<double>")
    new = models.missing_vectors(items, empty, models.hashed_embedder(64), "m", 64)
    assert new.count() == 3
    held = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new
    assert models.missing_vectors(items, held, models.hashed_embedder(64), "m", 64).count() == 0
    got = {r.item_id: r.vec for r in models.vectors(items, held, "m", 64).collect()}
    assert len(got) == 4 and got[1] == got[2] != got[3]

    def broken(texts):
        raise OSError

    assert models.missing_vectors(items, empty, broken, "m", 64).count() == 0


def test_answers_and_rerank_scores(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "prompt_id int, prompt string")
    said = {r.prompt_id: r.answer for r in models.answers(asked, lambda p: f'x {{"a": "{p}"}} y' if p == "good" else None).collect()}
    assert said == {1: 'x {"a": "good"} y', 2: None}
    assert one(spark, models.parsed_answer(F.col("t"), "a string"), t=said[1]).a == "good"
    score = lambda body: one(spark, models.rerank_scores(F.col("t"), F.lit(2)), t=body if isinstance(body, str) else json.dumps(body))
    assert score({"results": [{"index": 1, "relevance_score": 1.5}, {"index": 0, "score": -1}]}) == {1: 1.0, 0: 0.0}
    assert score({"output": {"results": [{"index": 0, "relevance_score": 0.5}, {"index": 1, "relevance_score": 0.25}]}}) == {0: 0.5, 1: 0.25}
    assert score({"results": [{"index": 1, "score": 1}]}) is None and score("no json") is None


def test_cut_to_tokens(spark):
    cut = lambda t, cap: one(spark, rendering.cut_to_tokens(F.col("t"), F.lit(cap)), t=t)
    assert cut("short", 10) == "short" and cut("x" * 50, 0) == "" and cut("x" * 50, 1) == "xxx" and cut("x" * 50, 5) == "x" * 12 + " …"
    assert cut("abcdefghi\njk lmnopqrst", 5) == "abcdefghi …" and cut("ab cdefghijklmnopqrst", 5) == "ab cdefghijk …" and cut("abcdefghij klmnopqrst", 5) == "abcdefghij …"


def by_hand(text, most):
    out, at, text = [], 0, text[:most]
    while at < len(text):
        ends = [k + 1 for k in range(at, min(at + 240, len(text))) if text[k] == "\n" or text[k] in ".!?" and (k + 1 == min(at + 240, len(text)) or text[k + 1].isspace())]
        end = min(at + 240, len(text))
        if ends:
            end = ends[0]
        elif end < len(text):
            gaps = [k for k in range(at + 1, end) if text[k].isspace() and not text[k - 1].isspace()]
            end = gaps[-1] if gaps and gaps[-1] - at >= 120 else end
        out.append(text[at:end].strip())
        at = end
    return [t for t in out if t]


@pytest.mark.parametrize("text", ["", "One. Two? v1.2 three\nfour", "a" * 600, ("word " * 100).strip(), "b" * 239 + ".c" + "d" * 30, "w" * 130 + " " + "v" * 300, "  \n\n x."])
def test_spans_are_those_of_a_plain_walk(spark, text):
    got = one(spark, cards.spans(F.col("t"), "Q", 500), t=text)
    assert [s.text for s in got] == by_hand(text, 500) and [s.id for s in got] == [f"Q{i + 1:02d}" for i in range(len(got))]
