import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import chunking, extraction, ingest


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens(spark):
    got = one(spark, X.tokens(F.col("t")), t="parseConfigFile in src/auth/token.py version 1.2.3 测试用例 __init__ HTTPServer")
    assert {"parseconfigfile", "parse", "config", "file", "src/auth/token.py", "token.py", "1.2.3", "测试", "试用", "用例", "init", "http", "server"} <= set(got)
    assert one(spark, X.tokens(F.col("t")), t=None) == []
    assert one(spark, X.cjk_bigrams(F.col("t")), t="单 双字") == ["单", "双字"]
    assert one(spark, X.path_tokens(F.col("t")), t="see ./aa/bb/ and end. of x.toolongext") == ["aa/bb", "bb"]


def test_tokens_of_long_words(spark):
    assert one(spark, X.tokens(F.col("t")), t="a" * 65) == [] and one(spark, X.tokens(F.col("t")), t="a" * 64) == ["a" * 64]


def test_denoise(spark):
    raw = "<!-- template\nnote --># Title\n- [x] done\n## PR Checklist\nSee [docs](http://x.y/z) at https://a.b/c\n\n\n\n<b>bold</b>"
    clean = one(spark, X.denoise(F.col("t")), t=raw)
    assert "template" not in clean and "done" not in clean and "http" not in clean and "Checklist" not in clean and "<b>" not in clean
    assert "Title" in clean and "docs" in clean and "bold" in clean
    assert one(spark, X.denoised_or_raw(F.col("t")), t="<b>short</b>") == "<b>short</b>"


def test_token_estimate_and_ids(spark):
    assert [one(spark, X.token_estimate(F.col("t")), t=t) for t in ("", None, "abc", "a" * 32)] == [0, 0, 1, 11]
    import hashlib

    expected = hashlib.sha256(b"u\x1fr\x1f0\x1f").hexdigest()[:24]
    assert one(spark, X.message_id(F.col("u"), F.col("r"), F.lit(0)), u="u", r="r") == "m:" + expected


def test_junk(spark):
    for value, kind, junk in (("n/a", "path", True), ("example.com", "path", True), ("README.md", "path", True), ("src/a.py", "path", False), ("ab", "symbol", True), ("docs.x.y", "config_key", True)):
        assert one(spark, X.is_junk_entity(F.lit(kind), F.col("v")), v=value) is junk


def test_line_kinds(spark):
    for line, kind in (("- bullet", "diff"), ("# Title", "command"), ("@@ -1 +1 @@", "diff"), ("Traceback (most recent call last):", "stack"), ("3 passed", "test_result"), ("$ ls", "command"), ("2024-01-01 10:00 start", "log"), ("plain words", "prose")):
        assert one(spark, chunking.line_kind(F.col("t")), t=line) == kind


TEXTS = st.lists(st.sampled_from(["```py\n", "~~~\n", "# Head\n", "- x\n", "$ ls\n", "words go here\n", "\n", "x" * 2500, "a b " * 900, "é🚀 ", "\x0b", "User:\n", "1 passed\r\n"]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_chunks_join_to_their_text(text):
    cuts = chunking.cut(text)
    assert "".join(text[a:b] for _, a, b in cuts) == text
    assert all(b > a and b - a <= chunking.MOST + chunking.LEAST + 100 for _, a, b in cuts)
    assert all(x[2] == y[1] for x, y in zip(cuts, cuts[1:]))


def test_chunk_rows(spark):
    content = "intro 🚀\n```python\nx = 1\n```\nTraceback (most recent call last):\n$ pytest\n3 passed\nend"
    m = spark.createDataFrame([("u", "r", 0, content), ("u", "r", 1, None)], "user_id string, request_id string, message_index int, content string")
    rows = chunking.chunks(m).orderBy("ord").collect()
    assert "".join(r.text for r in rows) == content and {"code", "stack", "command", "test_result", "prose"} == {r.kind for r in rows}
    assert all(content[r.char_start : r.char_end] == r.text and re.fullmatch("c:[0-9a-f]{24}", r.chunk_id) for r in rows)


def test_entities(spark):
    text = "In src/app/views.py, test_login fails with KeyError: 'x' and MAX_RETRY_COUNT; see app.settings.debug and parseConfig"
    got = {(e.kind, e.value) for e in one(spark, extraction.entities(F.col("t"), F.lit(True)), t=text)}
    assert {("path", "src/app/views.py"), ("test_name", "test_login"), ("error", "keyerror"), ("config_key", "max_retry_count"), ("config_key", "app.settings.debug"), ("symbol", "parseconfig")} <= got
    many = " ".join(f"test_case_{i:02d}" for i in range(20))
    assert len([e for e in one(spark, extraction.capped(extraction.entities(F.col("t"))), t=many) if e.kind == "test_name"]) == 12


def test_patch_facts(spark):
    patch = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n+def run():\n+class Box:\n+    async def go():\ndiff --git a/test_fix.py b/test_fix.py"
    assert one(spark, extraction.files_of_patch(F.col("t")), t=patch) == ["src/a.py"]
    assert one(spark, extraction.symbols_of_patch(F.col("t")), t=patch) == ["run", "go", "Box"]
    assert one(spark, extraction.is_real_diff(F.col("t")), t=patch) and not one(spark, extraction.is_real_diff(F.col("t")), t="-rw-r--r-- 1 a b\n+x")


def test_verification(spark):
    text = "$ python repro.py\n$ pytest tests/a.py\n1 failed, 2 passed\n$ pytest tests/b.py -q\n3 passed in 1s\n4 errors"
    v = one(spark, extraction.verification(F.col("t")), t=text)
    assert v.cmd == "pytest tests/b.py -q" and v.expect == "3 passed in 1s"
    assert one(spark, extraction.verification(F.col("t")), t="3 passed") is None


def test_hazards_and_grounding(spark):
    h = lambda t: one(spark, extraction.hazards(F.col("t")), t=t)
    assert h("Exiting the context restores the sentinel") == []
    assert h("The fix adds a guard") == ["narration"] and h("Add a guard") == ["imperative"] and "path" in h("see src/a.py") and "line" in h("at line 12") and "command" in h("run pytest")
    assert one(spark, extraction.ungrounded(F.col("v"), F.col("e")), v="KeyError in my_fn of a.b_c, e.g. this", e="saw  keyerror") == ["b_c", "my_fn"]
    assert one(spark, extraction.historical(F.col("t"), F.col("f")), t="edit src/a.py and a.py, test_one", f=["src/a.py"]) == "edit （历史文件） and （历史文件）, （历史测试）"


@pytest.mark.parametrize("messages,reason", [([("user", "x", None)], None), ([], "messages_empty"), ([("system", "x", None)], "role"), ([("user", None, 1)], "content"), ([("user", "x" * 1_000_001, 1)], "content_length")])
def test_validation(spark, messages, reason):
    frame = spark.createDataFrame([("r", "u", "s", messages)], "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,timestamp:bigint>>")
    assert frame.select(ingest.reject_reason(*[F.col(c) for c in frame.columns[:2]], F.col("session_id"), F.col("messages"))).first()[0] == reason
