"""The window of a session that a card is drawn from: its problem, closing summary, changes and acceptance evidence.

chunks: session_id, pos (place in the session), message_id, role, kind, chunk_id, text. A session's size is bounded by the
validation of requests, so what is gathered per session is; sessions spread over tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import extraction, ingest
from engram.operators.chunking import lines
from engram.operators.rendering import strip

# Cues, headings and budgets in characters.
SUMMARY_CUE = r"(?i)\b(summary|root\s+cause|what\s+was\s+done|problem|analysis|testing|the\s+fix|solution)\b"
BOILERPLATE = r"(?i)^(?:perfect!|great!|excellent!|let\s+me|i(?:'ve|\s+have)\s+successfully|all\s+tests?\s+pass(?:ed)?\b|the\s+patch\s+has\s+been\s+saved|the\s+testbed|files?\s+generated|output/|solution_summary|\d+\.\s+\*\*)"
HEADING = r"(?m)^(#{1,6})\s*(.+?)\s*$"
KEEP = r"(?i)^(summary|problem|root\s+cause|analysis|why|cause|issue|expected|bug|background|context)\b"
KEEP_WHOLE = ("the problem", "the bug", "the issue")
DROP = r"(?i)^(the\s+)?(fix|fixes|solution|changes?\s+made|implementation|testing|tests?|verification|validation|output|files?\s+generated|next\s+steps|patch|diff)\b"
TESTING = r"(?i)^(testing|tests?|verification|validation|acceptance|test\s+plan|what\s+was\s+tested)\b"
CAUSE_CUE = r"(?i)\b(because|caused|root\s+cause|due\s+to|happens?\s+when|occurs?\s+when|leads?\s+to|results?\s+in|triggered|so\s+that)\b"
TEST_OUTPUT = r"(?im)^\s*(?:\d+\s+(?:passed|failed|error|errors|skipped)\b|(?:FAILED|PASSED|SUCCESS|OK)\b|Test\s+\d+\b|\S+::\S+\s+(?:PASSED|FAILED))"
TRACEBACK = r"(?im)(?:^Traceback\b|^\s*E\s+\w*(?:Error|Exception)\b)"
TEST_SHAPE = r"(?i)(?:def\s+test_|assert\b|pytest|test_.*\.py|expected\s+outcome|actual\s+outcome|should\s+not|must\s+not)"
ENV_NOISE = r"(?i)(?:site-packages|dist-packages|\banaconda\b|\bminiconda\b|\bvenv\b|\bImportError\b|\bModuleNotFoundError\b|_c_internal_utils|Building wheel|Getting requirements|pip install|exec\(line\))"
EDIT_CALL = r"\[工具调用\]\s*Edit\s+(\{.*\})"
PROBLEM_CHARS, SUMMARY_CHARS, VERIFY_CHARS, DIGEST_CHARS, DIFF_CHARS, TAIL_CHARS, TESTING_CHARS = 4000, 5500, 3500, 1800, 4000, 2500, 1600
LEAST_SCORE, MOST_VERIFY, MOST_PATCH_LINES = 5.0, 4, 60
PIECE = "struct<pos:long,group:long,kind:string,text:string>"


def _blank_lines_once(text: Column) -> Column:
    rows = F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return strip(F.regexp_replace(F.array_join(F.filter(rows, lambda x: ~strip(x).rlike(BOILERPLATE)), "\n"), "\n{2,}", "\n\n"))


def sections(summary: Column) -> Column:
    """Array of (heading, body), bodies cleaned; what comes before the first heading has an empty one."""
    parts = F.filter(F.split(strip(summary), r"(?m)^(?=#{1,6}\s*.)"), lambda p: strip(p) != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\A" + HEADING, 2).alias("heading"), _blank_lines_once(F.regexp_replace(p, r"\A" + HEADING, "")).alias("body")))


def sanitized(summary: Column) -> Column:
    """The parts of a summary that tell of problem and cause; the whole (cleaned) where they are too short to tell much."""
    said = F.filter(sections(summary), lambda s: (s["body"] != "") & ~s["heading"].rlike(DROP) & ((s["heading"] == "") | s["heading"].rlike(KEEP) | F.lower(s["heading"]).isin(*KEEP_WHOLE)))
    text = F.array_join(F.transform(said, lambda s: F.when(s["heading"] == "", s["body"]).otherwise(F.concat(F.lit("### "), s["heading"], F.lit("\n"), s["body"]))), "\n\n")
    return F.substring(F.when(F.length(text) >= 120, text).otherwise(_blank_lines_once(F.coalesce(summary, F.lit("")))), 1, SUMMARY_CHARS)


def _bodies(summary: Column, wanted) -> Column:
    return strip(F.array_join(F.transform(F.filter(sections(summary), lambda s: (s["body"] != "") & wanted(s["heading"])), lambda s: s["body"]), "\n\n"))


def testing_notes(summary: Column) -> Column:
    """What a summary says it was tested against."""
    return F.substring(_bodies(summary, lambda h: h.rlike(TESTING)), 1, TESTING_CHARS)


def root_cause(summary: Column) -> Column:
    """The sections on the cause, else the first two paragraphs that name one; empty below 40 characters."""
    told = _bodies(summary, lambda h: (h != "") & ~h.rlike(DROP) & h.rlike(KEEP))
    paragraphs = F.filter(F.transform(F.split(strip(summary), r"\n\s*\n"), strip), lambda p: p.rlike(CAUSE_CUE))
    text = F.when(F.length(told) >= 80, told).otherwise(F.array_join(F.slice(paragraphs, 1, 2), "\n\n"))
    return F.when(F.length(text) >= 40, F.substring(text, 1, SUMMARY_CHARS)).otherwise(F.lit(""))


def taken(pieces: Column, most: int) -> Column:
    """pieces: array of PIECE in order. The first, and each later one that fits into what is left of `most` characters."""
    size = lambda p: F.length(strip(p["text"])).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{PIECE}>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        fits = (F.size(state["out"]) == 0) | (state["used"] + size(piece) <= most)
        return F.when(fits, F.struct((state["used"] + size(piece)).alias("used"), F.concat(state["out"], F.array(piece)).alias("out"))).otherwise(state)

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def verify_score(text: Column, kind: Column, group: Column) -> Column:
    """How much a chunk tells of acceptance; null where it can't be evidence."""
    text = strip(text)
    output, source, shape = text.rlike(TEST_OUTPUT), text.rlike(extraction.DIGEST_LINE), text.rlike(TEST_SHAPE)
    can = (F.length(text) >= 60) & ~text.rlike(ENV_NOISE) & (~text.rlike(extraction.TOOL_ARTEFACT) | output | shape)
    points = F.when(source, F.when(kind == "diff", 10.0).otherwise(6.0)).otherwise(0.0) + F.when(output, 8.0).when(text.rlike(TRACEBACK), 2.0).otherwise(0.0) + F.when(shape, 3.0).otherwise(0.0)
    points = points + F.when(text.rlike(CAUSE_CUE), 1.0).otherwise(0.0) + F.least(F.lit(4.0), group / 12.0) + F.least(F.lit(2.0), F.length(text) / 1500.0)
    return F.when(can, points)


def _best_of_messages(ranked: Column) -> Column:
    """ranked: array of PIECE, best first. One piece per message and per opening, MOST_VERIFY in all, in order of the session. A piece whose
    opening is taken leaves its message open to the next."""
    keyed = F.transform(ranked, lambda p: F.struct(p.alias("piece"), F.substring(strip(F.regexp_replace(p["text"], r"(?U)\s+", " ")), 1, 120).alias("opening")))

    def step(out: Column, x: Column) -> Column:
        clash = F.exists(out, lambda o: (o["piece"]["group"] == x["piece"]["group"]) | (o["opening"] == x["opening"]))
        return F.when((F.size(out) >= MOST_VERIFY) | clash, out).otherwise(F.concat(out, F.array(x)))

    best = F.aggregate(keyed, F.array().cast(f"array<struct<piece:{PIECE},opening:string>>"), step)
    return F.array_sort(F.transform(best, lambda x: x["piece"]))


def _asserted(pieces: Column) -> Column:
    added = lambda t: F.transform(F.filter(lines(t), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substr(x, F.lit(2)))
    rows = F.flatten(F.transform(pieces, lambda p: F.when((p["kind"] == "diff") | p["text"].contains("diff --git"), added(p["text"])).otherwise(lines(p["text"]))))
    return F.substring(F.array_join(extraction.test_digest(rows), "\n"), 1, DIGEST_CHARS)


def windows(chunks: DataFrame) -> DataFrame:
    """One row per session: problem, summary, root_cause, testing, diff, tail, verify (texts), digest, reconstructed (no closing summary, so
    the final changes and the last analysis stand for it)."""
    rows = ingest.islands(chunks, ["session_id"], ["pos"], "message_id").withColumn("group", F.col("island").cast("long") - 1)
    piece = F.struct(F.col("pos").cast("long").alias("pos"), F.col("group"), F.col("kind"), F.col("text"))
    messages = rows.groupBy("session_id", "group").agg(F.min_by("role", "pos").alias("role"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    said = F.array_join(F.transform(F.filter("pieces", lambda p: strip(p["text"]) != ""), lambda p: p["text"]), "\n")
    messages = messages.withColumn("said", said)
    substantial = (F.col("role") == "assistant") & (F.length("said") >= 200) & ~strip(F.col("said")).rlike(extraction.TOOL_ARTEFACT)
    closing = substantial & (F.length("said") >= 350) & F.col("said").rlike(SUMMARY_CUE)
    last = lambda of: F.max_by(F.struct("group", "pieces"), F.when(of, F.col("group")))
    per = messages.groupBy("session_id").agg(F.max_by("pieces", F.when(F.col("group") == 0, 0)).alias("first"), last(closing).alias("closing"), last(substantial).alias("analysis"))
    own = F.length(strip(F.col("text"))).cast("long")
    diffs = rows.where((F.col("kind") == "diff") & (own >= 40)).select("session_id", piece.alias("piece"), "pos", own.alias("own"))
    later = Window.partitionBy("session_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    diffs = diffs.withColumn("before", F.coalesce(F.sum(F.col("own") + 1).over(later), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("own") <= DIFF_CHARS))
    per = per.join(diffs.groupBy("session_id").agg(F.array_sort(F.collect_list("piece")).alias("diffs")), "session_id", "left")
    rebuilt = F.col("closing").isNull() & F.col("diffs").isNotNull()
    per = per.withColumn("reconstructed", rebuilt).withColumn("summary_of", F.when(~F.col("reconstructed"), F.coalesce("closing", "analysis")))
    found = rows.join(per.select("session_id", F.col("summary_of.group").alias("summary_group")), "session_id").where((F.col("group") != 0) & ~F.col("group").eqNullSafe(F.col("summary_group")))
    found = found.withColumn("score", verify_score(F.col("text"), F.col("kind"), F.col("group"))).where(F.col("score") >= LEAST_SCORE)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("group")).alias("g"), "chunk_id", piece.alias("piece")))), lambda x: x["piece"])
    per = per.join(found.groupBy("session_id").agg(taken(_best_of_messages(ranked), VERIFY_CHARS).alias("proof")), "session_id", "left")
    none = F.array().cast(f"array<{PIECE}>")
    text = lambda pieces: F.array_join(F.transform(F.coalesce(pieces, none), lambda p: p["text"]), "\n")
    summary_pieces = F.coalesce(F.col("summary_of.pieces"), none)
    whole = F.array_join(F.transform(F.filter(summary_pieces, lambda p: strip(p["text"]) != ""), lambda p: p["text"]), "\n")
    per = per.withColumn("whole", whole).withColumn("proof", F.coalesce("proof", none))
    return per.select(
        "session_id", text(taken(F.col("first"), PROBLEM_CHARS)).alias("problem"), sanitized(F.col("whole")).alias("summary"), root_cause(F.col("whole")).alias("root_cause"), testing_notes(F.col("whole")).alias("testing"),
        F.when(F.col("reconstructed"), text(F.col("diffs"))).otherwise("").alias("diff"), F.when(F.col("reconstructed"), text(taken(F.coalesce(F.col("analysis.pieces"), none), TAIL_CHARS))).otherwise("").alias("tail"),
        text(F.col("proof")).alias("verify"), _asserted(F.concat("proof", taken(summary_pieces, SUMMARY_CHARS))).alias("digest"), "reconstructed")


def diff_sections(text: Column) -> Column:
    """The file sections of a text that are real diffs of files worth keeping, each up to the first line that is no part of a hunk."""

    def real(section: Column) -> Column:
        path = extraction.clean_path(F.regexp_extract(section, extraction.DIFF_FILES, 2))
        return (section.startswith("diff --git ") | section.rlike(r"(?m)^--- .+\n\+\+\+ ")) & ((path == "") | ~extraction.is_scratch_path(path))

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?m)^(?=diff --git )"), strip), real)
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?sm)(^@@.*?)\n(?=[^ +\-@\\\n]).*\z", "$1"), r"(?U)\s+$", ""))


def edits(text: Column) -> Column:
    """Edit calls of a text as diff-like blocks; calls that don't parse, scratch files and empty edits go."""
    calls = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EDIT_CALL), F.lit(1)), lambda j: F.from_json(j, "file_path string, path string, old_string string, old_str string, new_string string, new_str string"))
    said = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    plain = F.transform(calls, lambda c: F.struct(extraction.clean_path(said(c["file_path"], c["path"])).alias("path"), said(c["old_string"], c["old_str"]).alias("old"), said(c["new_string"], c["new_str"]).alias("new")))
    good = F.array_distinct(F.filter(plain, lambda e: (e["path"] != "") & ~extraction.is_scratch_path(e["path"]) & (strip(F.concat(e["old"], e["new"])) != "")))
    signed = lambda sign, t: F.transform(F.when(t == "", F.array().cast("array<string>")).otherwise(lines(t)), lambda x: F.concat(F.lit(sign), x))
    return F.transform(good, lambda e: F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), e["path"]), F.concat(F.lit("+++ b/"), e["path"]), F.lit("@@")), signed("-", e["old"]), signed("+", e["new"])), "\n"))


def patches(chunks: DataFrame, most_lines: int = MOST_PATCH_LINES) -> DataFrame:
    """session_id, patch: each session's diffs, put together per message, equal ones once; its edit calls where it has none. Sessions with neither
    don't appear."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda c: F.regexp_replace(c["text"], r"^\n+|\n+$", "")), "\n")
    messages = chunks.groupBy("session_id", "message_id").agg(F.min("pos").alias("pos"), whole.alias("text"))
    has = F.col("text").contains("diff --git ") | F.col("text").rlike("(?m)^@@ ")
    none = F.array().cast("array<string>")
    messages = messages.select("session_id", "pos", F.when(has, diff_sections(F.col("text"))).otherwise(none).alias("diffs"), edits(F.col("text")).alias("edits"))
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda m: m[c]))
    per = messages.groupBy("session_id").agg(joined("diffs").alias("diffs"), joined("edits").alias("edits"))
    keys = F.transform("diffs", lambda s: F.substring(F.regexp_replace(s, r"(?U)\s+", " "), 1, 500))
    per = per.withColumn("keys", keys)
    once = F.filter("diffs", lambda s, i: F.array_position("keys", F.get("keys", i)) == i + 1)  # the first of each key
    rows = F.split(F.array_join(F.when(F.size("diffs") > 0, once).otherwise(F.array_distinct("edits")), "\n"), "\n")
    cut = F.concat(F.slice("rows", 1, most_lines), F.array(F.concat(F.lit("... [diff 截断，共 "), F.size("rows").cast("string"), F.lit(" 行]"))))
    per = per.where((F.size("diffs") > 0) | (F.size("edits") > 0)).select("session_id", rows.alias("rows"))
    return per.select("session_id", F.array_join(F.when(F.size("rows") > most_lines, cut).otherwise(F.col("rows")), "\n").alias("patch"))


def last_diff(chunks: DataFrame) -> DataFrame:
    """chunks: session_id, pos, text. session_id, files: those that the last chunk with a diff header names."""
    last = chunks.where(F.col("text").contains("diff --git a/")).groupBy("session_id").agg(F.max_by("text", "pos").alias("text"))
    return last.select("session_id", extraction.files_of_patch(F.col("text")).alias("files"))
