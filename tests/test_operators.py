import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import health, retrieval, selection, store
from engram.sources import tables
from engram.streaming import sessions


def ranked(spark, scores):
    return spark.createDataFrame([("q", i + 1, float(s)) for i, s in enumerate(scores)], "query_id string, rank int, score double")


@pytest.mark.parametrize("scores,options,expected", [
    ([1.0, 0.9, 0.05, 0.04, 0.03], {}, 2), ([1.0, 0.9, 0.05, 0.04, 0.03], {"ratio": 0.0}, 5), ([0.0] * 5, {}, 2), ([0.0] * 2, {"least_items": 1}, 1), ([0.0] * 2, {"least_items": 9}, 2), ([1.0, 0.9, 0.4, 0.2], {"least": 0.5}, 2),
])
def test_admission(spark, scores, options, expected):
    assert selection.admit(ranked(spark, scores), **options).count() == expected


def test_bm25_counts_a_term_once_and_prefers_rare_ones(spark):
    docs = [("all", i, "problem", f"common w{i}") for i in range(30)] + [("all", 99, "problem", "common rare"), ("all", 100, "problem", None)]
    frame = retrieval.index_face(spark.createDataFrame(docs, "scope string, item_id long, field string, text string"))
    q = lambda t: retrieval.query_terms(spark.createDataFrame([("all", 1, t)], "scope string, query_id long, text string"), {"problem": 1.0})
    once, twice = (retrieval.top(retrieval.bm25(frame, q(t)), ["query_id"], 3).orderBy("rank").collect() for t in ("common rare", "common common rare rare"))
    assert once == twice and once[0].item_id == 99


def test_anchored_terms_weigh_the_maximum(spark):
    q = spark.createDataFrame([("a", 1, "alpha beta", [("error", "alpha"), ("test_name", "beta"), ("issue", "beta")])], "scope string, query_id long, text string, anchors array<struct<kind:string,value:string>>")
    got = {(r.field, r.term): r.weight for r in retrieval.query_terms(q, boosted="anchors").collect()}
    assert got["problem", "alpha"] == 1.6 and got["problem", "beta"] == 1.0 and got["test", "beta"] == pytest.approx(0.8 * 1.6) and got["", "alpha"] == 0.25


def test_counts_equal_the_native_tokens(spark):
    texts = ["readFileSync HTTPServer_v2 x.y 3.14 12", "src/a_b/C.py ./run.sh a\\b.TXT v1.2-rc http://x.io/a.html", "检索记忆 測 ok", "Hello WORLD __init__ _x_ snake_case camelCase " + "a" * 70, "", None, "１２.３ é ñandú Ünder_score"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = frame.select("id", X.tokens(F.col("t")).alias("native"), X.term_counts(F.col("t")).alias("c"), X.latin_tokens(F.col("t")).alias("latin"), X.term_counts(F.col("t"), latin_only=True).alias("l")).collect()
    for r in rows:
        assert Counter(r.native) == {x.term: x.tf for x in r.c.terms} and r.c.n == len(r.native)
        assert Counter(r.latin) == {x.term: x.tf for x in r.l.terms}


def test_vectors_stay_in_their_scope(spark):
    v = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("w", 2, [1.0, 0.0]), ("u", 3, [0.0, 0.0]), ("u", 4, [1.0])], "scope string, item_id long, vec array<double>")
    q = spark.createDataFrame([("u", 9, [2.0, 0.0])], "scope string, query_id long, qvec array<double>")
    assert [(r.item_id, r.score) for r in retrieval.vector_scores(v, q).collect()] == [(1, 1.0)]


def test_fusion_and_missing_items(spark):
    lists = spark.createDataFrame([(1, 10, "field", 1), (1, 10, "anchor", 2), (1, 11, "field", 2), (1, 12, "off", 1)], "query_id long, item_id long, channel string, rank int")
    fused = {r.item_id: r.fused for r in retrieval.fuse(lists).collect()}
    assert fused[10] == pytest.approx(1 / 61 + 1.2 / 62) and fused[11] == pytest.approx(1 / 62) and fused[12] == 0
    queries, items = spark.createDataFrame([("s", 1)], "scope string, query_id long"), spark.createDataFrame([("s", 10), ("s", 77)], "scope string, item_id long")
    assert {(r.item_id, r.fused > 0) for r in retrieval.with_all_items(retrieval.fuse(lists), queries, items).collect()} == {(10, True), (77, False)}


def test_boost_of_a_miss_is_negative_without_files(spark):
    ranks = F.create_map(F.lit("none"), F.lit(1))
    assert spark.range(1).select(retrieval.boost(ranks, F.lit(False), F.lit(False))).first()[0] == pytest.approx(-1.1 * 0.004)


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", i + 1, t) for i, t in enumerate((50, 40, 30, 20, 5))], "query_id string, rank int, tokens int")
    assert sorted(r.rank for r in selection.within_budget(rows, 100).collect()) == [1, 2, 5]


def test_files_are_spread(spark):
    rows = spark.createDataFrame([("q", f"i{k}", k, f) for k, f in enumerate((["a"], ["a"], ["a"], ["b"], None, ["b"]), 1)], "query_id string, item_id string, rank int, files array<string>")
    assert [r.rank for r in selection.spread_files(rows).orderBy("position").collect()] == [1, 2, 4, 5, 3, 6]


def test_judgements_and_grouping(spark):
    rows = spark.createDataFrame([("q", f"i{k:02d}", k, 1.0) for k in range(25)], "query_id string, item_id string, rank int, score double")
    v = [("q", "i00", "irrelevant"), ("q", "i01", "transferable")] + [("q", f"i{k:02d}", "topic") for k in range(2, 20)]
    order = [r["rank"] for r in selection.grouped_by_transfer(rows, spark.createDataFrame(v, "query_id string, item_id string, verdict string")).orderBy("position").collect()]
    assert order == [1, *range(2, 25), 0]
    verdicts = spark.createDataFrame([("q", "i01", "yes", 1.0), ("q", "i02", "maybe", 1.0), ("q", "i03", "yes", 1.0), ("q", "i03", "no", 1.0), ("q", "i04", "unknown", None)], "query_id string, item_id string, verdict string, confidence double")
    got = {r.item_id: r.score for r in selection.judged(rows, verdicts).collect()}
    assert got["i01"] == pytest.approx(1.01) and got["i02"] == got["i03"] == 1.0 and got["i04"] == pytest.approx(1 + 0.01 * 0.35 * 0.75)


def test_rerank_needs_every_score(spark):
    rows = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item_id string, rank int")
    scores = lambda *s: spark.createDataFrame([("q", i, x) for i, x in s], "query_id string, item_id string, rerank double")
    got = {r.item_id: r.score for r in selection.reranked(rows, scores(("a", 0.0), ("b", 5.0)), candidates=2).collect()}
    assert got["a"] == pytest.approx(0.7) and got["b"] == pytest.approx(0.65) and got["c"] == pytest.approx(0.649)
    assert {r.score for r in selection.reranked(rows, scores(("a", 0.0)), candidates=2).collect()} == {None}


def test_rerank_takes_an_item_scored_twice_for_unscored(spark):
    rows = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1), ("r", "b", 2)], "query_id string, item_id string, rank int")
    scores = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 1.0), ("r", "a", 0.5), ("r", "b", 0.1), ("r", "b", 0.2)], "query_id string, item_id string, rerank double")
    got = [(r.query_id, r.item_id, r.score) for r in selection.reranked(rows, scores).orderBy("query_id", "item_id").collect()]
    assert got == [("q", "a", pytest.approx(0.7)), ("q", "b", pytest.approx(0.65)), ("r", "a", None), ("r", "b", None)]


@pytest.mark.parametrize("elapsed,mode", [([], "full"), ([39], "lex_only"), ([1] * 7 + [45] * 3, "extract_lite"), ([10, 38, 10, 38], "lex_only"), ([38, 0.5] * 8, None)])
def test_guard(elapsed, mode):
    guard, seen = health.Guard(40.0), []
    for e in elapsed:
        seen.append(guard.observe(e, False))
    assert guard.mode == mode if mode else "full" not in seen


def test_guard_recovers_by_rungs():
    guard = health.Guard(40.0, streak=3)
    modes = [guard.observe(e, False) for e in (39, *[0.5] * 6)]
    assert modes[0] == "lex_only" and modes[1] != "full" and modes[-1] == "full"


def test_guard_modes_by_scope(spark):
    rows = [(s, k, float(e), False) for s in ("a", "b") for k, e in enumerate((39, 0.5, 0.5, 0.5) if s == "a" else (1, 1, 1, 1))]
    got = health.modes(spark.createDataFrame(rows, "scope string, seq long, elapsed double, overran boolean"), 40.0).collect()
    assert {r.mode for r in got if r.scope == "b"} == {"full"} and len(got) == 8 and [r.mode for r in got if r.scope == "a"][0] == "lex_only"


def test_publications_replace_as_a_whole(spark, tmp_path):
    store = tables.Publications(spark, str(tmp_path / "store"))
    with pytest.raises(KeyError):
        store.read("cards")
    store.publish({"cards": spark.range(3), "terms": spark.range(5)})
    snapshot = store.manifest()
    store.publish({"cards": spark.range(7)})
    assert store.read("cards").count() == 7 and store.read("terms").count() == 5 and store.read("cards", snapshot).count() == 3
    (tmp_path / "store" / "manifest.json").write_text(json.dumps({"schema_version": 8, "tables": {}}))
    (tmp_path / "store" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        store.manifest()


def test_vector_lines(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"k": "a", "v": [1.0]}\n\nnot json\n{"k": 3, "v": "x"}\n{"k": "a", "v": [2.0, 3.0]}\n{"k": "b", "v": []}\n')
    assert {r.key: r.vector for r in tables.vector_lines(spark, str(tmp_path)).collect() if r.key in "ab"} == {"a": [2.0, 3.0], "b": []}


def run_stream(query):
    query.processAllAvailable()
    query.stop()


def test_sessions_close_when_another_begins(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("u", "s1", 1), ("u", "s1", 2), ("w", "x", 1), ("u", "s2", 3)], "user_id string, session_id string, seq long").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("user_id string, session_id string, seq long").json(str(source))
    out = sessions.closed_sessions(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    run_stream(out)
    assert [tuple(r) for r in spark.sql("SELECT * FROM closed").collect()] == [("u", "s1", "s2", 2)]


def test_requests_are_taken_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("SELECT 'u' user_id, 'r' request_id, timestamp'2024-01-01 00:00:00' received_at UNION ALL SELECT 'u', 'r', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 'u', 'r2', timestamp'2024-01-01 00:01:00'").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("user_id string, request_id string, received_at timestamp").json(str(source))
    run_stream(sessions.taken_once(stream).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c")).start())
    assert sorted(r.request_id for r in spark.sql("SELECT * FROM taken").collect()) == ["r", "r2"]


def test_files_are_spread_as_by_hand(spark):
    rows = [(q, 100 * q + (7 * r) % 13, r // 2, [f"f{(q * r * 5 + k) % 6}" for k in range(r % 3)] if r % 5 else None) for q in range(4) for r in range(13)]
    got = {(r.query_id, r.item_id): r.position for r in selection.spread_files(spark.createDataFrame(rows, "query_id int, item_id int, rank int, files array<string>")).collect()}
    for q in range(4):
        picked, late, seen = [], [], set()
        for _, item, _, files in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[1])):
            own = set(files or ())
            if len(picked) >= 2 and own & seen:
                late.append(item)
            else:
                picked.append(item)
                seen |= own
        assert [got[q, item] for item in picked + late] == list(range(1, 14))


def test_replacement_leaves_the_index_of_other_cards(spark):
    """Whatever the ids: of users 1 and 2 only the session of user 1 is closed."""
    schema = "user_id long, card_id long, session_id string, extraction_version string, created_at string, problem string, files array<string>, source_ids array<string>"
    cards = spark.createDataFrame([(1, 7, "s", "v4", "a", "one", ["a.py"], []), (1, 1000007, "s", "v4", "a", "two", ["b.py"], []), (1, 1000008, "t", "v4", "a", "three", ["c.py"], []), (2, 1000007, "s", "v4", "a", "four", ["d.py"], [])], schema)
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    vectors = cards.select("user_id", "card_id", F.lit("m").alias("model"))
    sessions = cards.select("user_id", "session_id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("card_count")).distinct()
    new = spark.createDataFrame([(1, 2000007, "s", "v4", "b", "five", ["e.py"], [])], schema)
    done = store.finalised(store.index_rows(cards, chunks) | {"vectors": vectors, "sessions": sessions}, new, spark.createDataFrame([(1, "s")], "user_id long, session_id string"), chunks, "v4")
    keys = lambda n: sorted((r.user_id, r.card_id) for r in done[n].collect())
    assert keys("vectors") == [(1, 1000008), (2, 1000007)] and keys("cards") == keys("anchors") == [(1, 1000008), (1, 2000007), (2, 1000007)]
