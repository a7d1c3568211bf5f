"""Search, judging, prompts and settings on small fixtures, where a query's SQL can't tell them apart."""
import re
import time

import pytest
from pyspark.sql import functions as F

from engram import session, settings
from engram.operators import extraction, judging, prompts, rendering, retrieval, search, selection, store

CARD = "query_id string, item_id long, position int, score double, problem string, idea boolean, hint string"


def chosen(spark, *rows):
    return spark.createDataFrame([("q", i, i, *r) for i, r in enumerate(rows, 1)], CARD)


def test_response_passes_over_what_does_not_fit(spark):
    size = lambda n: "w" * n
    rows = chosen(spark, (1.0, size(500), False, ""), (0.9, size(500), False, ""), (0.8, size(100), False, ""), (0.7, size(2000), False, ""), (0.01, size(50), False, ""))
    whole = {r.item_id: r for r in search.assembled(rows).collect()}
    assert [whole[k].outcome for k in range(1, 6)] == ["in"] * 4 + ["low_score"] and [whole[k].place for k in range(1, 5)] == [1, 2, 3, 4]
    tight = {r.item_id: r for r in search.assembled(rows, cap=260).collect()}
    estimate = lambda t: int(len(t) / 3.2) + 1
    assert tight[1].outcome == "in" and tight[2].outcome == "in" and len(tight[2].content) < len(whole[2].content)
    assert sum(estimate(r.content) for r in tight.values() if r.outcome == "in") <= 260
    assert {tight[k].outcome for k in (3, 4)} <= {"in", "budget", "empty"}


def test_ideas_have_no_seat_by_right_and_hints_are_paid_for(spark):
    rows = chosen(spark, (1.0, "a real problem", False, " (hint)"), (0.05, "weak idea", True, ""), (0.04, "weak packet", False, ""))
    got = {r.item_id: r for r in search.assembled(rows).collect()}
    assert got[1].content.endswith("(hint)") and got[2].outcome == "low_score" and got[3].outcome == "in"
    assert search.assembled(rows.limit(0)).count() == 0


def test_selection_spreads_files_and_drops_equal_texts(spark):
    rows = [("q", 1, 1, ["a"], "one"), ("q", 2, 2, ["b"], "two"), ("q", 3, 3, ["a"], "three"), ("q", 4, 4, ["c"], "t  wo"), ("q", 5, 5, ["d"], "two"), ("q", 6, 6, None, "six")]
    ranked = spark.createDataFrame(rows, "query_id string, item_id long, rank int, files array<string>, text string")
    order = lambda limit, **k: [r.item_id for r in search.selected(ranked, limit, **k).orderBy("position").collect()]
    assert order(20) == [1, 2, 4, 6, 3] and order(3) == [1, 2, 4] and order(0) == []
    assert order(20, target=0) == []  # past the target a body needs LEAST_BODY_PAST_TARGET tokens


def test_pool_is_filled_with_the_newest(spark):
    items = spark.createDataFrame([("s", k, k % 5) for k in range(20)], "scope string, item_id long, newness int")
    asked = spark.createDataFrame([("s", 1), ("t", 2)], "scope string, query_id long")
    assert [r.item_id for r in retrieval.fill_items(asked, items, 3).orderBy("item_id").collect()] == [4, 9, 14]


def test_features_of_noise_options_and_anchors(spark):
    text = "<!-- t --> `my_fn` fails in src/a/b.py, see #123 https://x.io/y and README.md n/a KeyError\n- [ ] done"
    q = spark.createDataFrame([("s", 1, text, ["A. lib/c.py", "2) other_fn"]), ("s", 2, "is it the", None), ("s", 3, None, [])], "scope string, query_id long, text string, options array<string>")
    got = {r.query_id: r for r in search.features(q).collect()}
    kinds = {(a.kind, a.value) for a in got[1].anchors}
    assert {("symbol", "my_fn"), ("path", "src/a/b.py"), ("issue", "#123"), ("error", "keyerror")} <= kinds and not any("README" in v or "x.io" in v for _, v in kinds)
    assert "lib/c.py" in got[1].option_terms and ("symbol", "other_fn") in {(e.kind, e.value) for e in got[1].option_entities}
    assert got[2].terms == ["is", "it", "the"] and got[3].terms == [] and got[3].anchors == []


def test_entities_equal_python_patterns(spark, sf):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rows += ['File "src/x.py", line 3\nKeyError: \'a b\' in os.path.join HTTP404 MY_CONF_KEY test_it_works() a/b/c camelCase', "see lib/a.md, docs\\b.TXT. `x`", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    got = {r.id: {(e.kind, e.value) for e in r.e} for r in frame.select("id", extraction.entities(F.col("text"), F.lit(True)).alias("e")).collect()}
    for i, text in enumerate(rows):
        found = set()
        for kind, pattern, group in extraction.ENTITIES:
            for m in re.finditer(pattern, text or ""):
                value = m[group].strip(" \t\r\n\x0b\x0c\"'`")
                if kind == "path":
                    value = value.rstrip(".,;:")
                    if not re.search(r"[/\\]", value) and not re.search(r"\.[A-Za-z]{1,6}$", value):
                        continue
                if kind == "config_key" and value.lower() in extraction.NOISE_SYMBOLS or not 3 <= len(value) <= 200:
                    continue
                found.add((kind, value.lower()))
        for m in re.finditer(extraction.SYMBOL, text or ""):
            if m[1].lower() not in extraction.NOISE_SYMBOLS and (re.search("^.+[A-Z]", m[1]) or "_" in m[1]):
                found.add(("symbol", m[1].lower()))
        assert got[i] == found, text


def test_harness_prefixes_go(spark):
    paths = ["/home/x/swebench_9_15/testbed/src/a.py", "testbed/src/a.py", "b/src/a.py", ".\\src\\a.py", "swebench_9_15/src/a.py", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(extraction.clean_path(F.col("p")).alias("c")).collect()
    assert [r.c for r in got] == ["src/a.py"] * 5 + [None]


def test_snippets_need_a_reason(spark):
    asked = spark.createDataFrame([("q", ["alpha", "beta"], [("symbol", "Gamma")])], "query_id string, terms array<string>, anchors array<struct<kind:string,value:string>>")
    text = lambda s: s + " " + "x" * 60
    chunks = spark.createDataFrame([("a", "log", text("alpha beta")), ("b", "log", text("alpha")), ("c", "prose", text("alpha beta")), ("d", "log", text("gamma")), ("e", "log", "FAILED t" + " " * 50), ("f", "log", text("3 passed")), ("g", "log", text("alpha  BETA"))], "chunk_id string, kind string, text string")
    cards = spark.createDataFrame([("q", 1, list("abcdefg"))], "query_id string, item_id long, source_ids array<string>")
    got = search.snippets(cards, chunks, asked, 9).first().evidence
    assert [t.split(" x")[0] for t in got] == ["gamma", "3 passed", "alpha beta"]


def test_verdicts_of_answers_that_are_no_json(spark):
    q = spark.createDataFrame([("q", "It breaks. Why?"), ("r", "")], "query_id string, text string")
    bad = spark.createDataFrame([("q", "no idea"), ("r", '{"hypotheses": 3}')], "query_id string, answer string")
    assert judging.hypotheses(q, bad).count() == 0
    good = spark.createDataFrame([("q", '{"hypotheses":[{"subsystem":"s","defect_shape":"d","evidence_id":"Q02"}]}')], "query_id string, answer string")
    found = judging.hypotheses(q, good)
    assert found.first().hypotheses[0].evidence == "Why?"
    ranked = spark.createDataFrame([("q", 1, 1, "p", "Because of x. And y.")], "query_id string, item_id long, rank int, problem string, mechanism string")
    c = judging.candidates(ranked)
    said = lambda unit: spark.createDataFrame([("q", f'{{"items":[{{"id":"C01","verdict":"transferable","root_cause_unit_id":"{unit}","matched_hypothesis":"H1","reason":"r"}}]}}')], "query_id string, answer string")
    assert judging.verdicts(c, found, said("C01.M02")).first().unit == "And y." and judging.verdicts(c, found, said("C01.M09")).count() == 0


def test_digest_budgets(spark):
    diff = "diff --git a/x b/x\n@@ -1 +1 @@ f\n" + "\n".join(f"+{'y' * 110}{i}" for i in range(30))
    texts = spark.createDataFrame([([diff] * 3 + ["assert 1\nnothing"] + [None],)], "t array<string>")
    got = texts.select(prompts.digest(F.filter("t", lambda x: x.isNotNull())).alias("d")).first().d
    assert got.count(" | ") == 22 and len(got) == prompts.MOST_DIGEST  # two blocks of diffs, then the cut
    both = texts.select(prompts.digest(F.slice("t", 3, 2)).alias("d")).first().d
    assert both.count(" | ") == 11 and both.endswith(prompts.DIGEST_TEST_LABEL + "assert 1")
    assert texts.select(prompts.digest(F.array(F.lit("prose"))).alias("d")).first().d == ""


def test_claims_of_one_job(spark):
    held = spark.createDataFrame([], "user_id int, request_id string, content_hash string, status string, lease_expires timestamp")
    asked = spark.createDataFrame([(1, "r", "h", 1), (1, "r", "h", 2), (1, "r", "other", 3), (2, "r", "x", 4)], "user_id int, request_id string, content_hash string, seq int")
    got = {r.seq: r.outcome for r in store.claims(held, asked, F.current_timestamp()).collect()}
    assert got == {1: "fresh", 2: "in_progress", 3: "conflict", 4: "fresh"}


def test_settings_fall_back_to_defaults(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nexport ENGRAM_POOL_TOTAL='50'\nENGRAM_SCORE_RATIO=abc\nENGRAM_JUDGE_MODEL=\"gpt-4o-mini\"\nnonsense\n")
    got = settings.load({"ENGRAM_DENOISE": "off", "ENGRAM_LEAST_ITEMS": "x", "ENGRAM_TRANSFERABILITY": "1"}, str(file))
    assert (got.pool_total, got.score_ratio, got.denoise, got.least_items, got.judges()) == (50, 0.15, False, 2, (True, True))
    assert settings.load({}).judges() == (False, False)


def test_deadline_and_counts(spark):
    slow = F.udf(lambda x: time.sleep(3) or x, "long")
    with session.deadline(spark, 0.5) as record:
        spark.range(8).select(slow("id").alias("x")).collect()
    assert record["expired"] and record["seconds"] < 30
    with session.deadline(spark, 60) as record:
        assert spark.range(3).count() == 3
    rows, seen = session.metered(spark.range(10), "step", even=F.count_if(F.col("id") % 2 == 0))
    rows.collect()
    assert seen.get == {"rows": 10, "even": 5} and session.log_line("step", **seen.get) == '{"even": 5, "event": "step", "rows": 10}'
    with pytest.raises(TypeError):
        session.log_line("step", text="x")


def test_empty_renders(spark):
    rows = spark.createDataFrame([(1, None), (2, "p")], "item_id long, problem string")
    assert [r.content for r in rendering.rendered(rows, F.lit(100)).orderBy("item_id").collect()][0] == ""
    assert selection.admit(spark.createDataFrame([], "query_id string, rank int, score double")).count() == 0
