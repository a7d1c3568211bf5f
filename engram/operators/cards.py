"""From proposed cards to admitted ones: grounding in the cited evidence, admission, facts that rules add.

A proposal is a row; its evidence is the text of the chunks it cites (and, for prose, of its whole session). Sessions are
bounded by the validation of requests, so is the evidence of a card.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import extraction
from engram.operators.chunking import lines
from engram.operators.rendering import card_columns, strip

# What counts as an anchor in prose, words too common to ground a pitfall, closed kinds, sizes.
PROSE_PATH = r"[A-Za-z0-9_./\\~-]+\.(?:" + extraction._EXTENSIONS + r"|gradle|mod|lock)\b"
PROSE_SYMBOL = r"[A-Za-z_][A-Za-z0-9_]{1,}(?:\.[A-Za-z_][A-Za-z0-9_]{1,})+|[A-Z][A-Za-z0-9]*(?:Error|Exception|Warning|Fault)"
PITFALL_TOKEN = r"[A-Za-z_][A-Za-z0-9_.]{3,}"
GENERIC = """error errors test tests failed failing failure assert patch file files function code change changes tried trying instead still with that
    this from when then only also first""".split()
CONDITION_TYPES = "version module symbol error config test_name frame".split()
SETUP = r"""(?i)git clone|git checkout|pip install|npm install|Creating virtualenv|Downloading |Collecting |conda create|cd /testbed && git |remove.*testbed|Cloning into|pytest.*[0-9]\.[0-9]+.*or (?:higher|later)|update pytest|pytest version"""
SALVAGE = r"(?is)implement_{}\s*:\s*(.*?)(?=implement_(?:shape|boundaries|acceptance)\s*:|\z)"
ERROR_NAME = r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning))\b"
TEST_NODE = r"\b((?:[\w./-]+\.py)::[A-Za-z0-9_\[\]-]+)\b"
FAILED_TEST = r"(?m)^\s*FAILED\s+(\S+)"
FRAME = r"""File "([^"\n]+)", line (\d+)"""
VERSION = r"(?i)\b(?:version|v)\s*([0-9]+(?:\.[0-9]+){1,2})\b"
MODULE = r"^([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
KINDS = {"debug": "debug bugfix bug fix defect".split(), "feature": "feature enhancement dev development".split()}
FEATURE_CUES = ("support ", "add ", "implement", "introduce", "extend", "allow ", "new feature", "feature request", "enhancement", "支持", "新增", "实现", "扩展", "增强")
DEBUG_CUES = ("error", "exception", "traceback", "bug", "fix", "broken", "crash", "regression", "fails", "failing", "wrong", "报错", "异常", "修复", "失败")
SPAN = r"(?s).{0,239}?(?:[.!?。！？;；](?=\s|\z)|\n)|.{239}[.!?。！？;；]|.{1,240}\z|.{120,239}(?<=\S)(?=\s)|.{240}"
EVIDENCE_KINDS = "diff command test_result stack log".split()
MOST_CONDITIONS, MOST_PITFALLS, MOST_FILES, MOST_SYMBOLS = 8, 3, 8, 12
NARRATIVE = ("problem", "locate", "implement", "shape", "boundaries", "acceptance", "mechanism")
CONDITIONS = "array<struct<type:string,value:string>>"


def is_setup(text: Column) -> Column:
    """A short text that sets up a session: cloning, installing."""
    return F.substring(text, 1, 600).rlike(SETUP) & (F.length(text) < 2000)


def pitfall_grounded(pitfall: Column, source: Column) -> Column:
    """The evidence (lower case) holds the whole pitfall or one of its telling tokens."""
    whole = strip(F.regexp_replace(F.lower(pitfall), r"(?U)\s+", " "))
    tokens = F.transform(F.regexp_extract_all(F.coalesce(pitfall, F.lit("")), F.lit(PITFALL_TOKEN), F.lit(0)), F.lower)
    return source.contains(whole) | F.exists(F.filter(tokens, lambda t: ~t.isin(GENERIC)), lambda t: source.contains(t))


def _without_foreign(text: Column, pattern: str, source: Column) -> Column:
    """Matches that the evidence doesn't hold go; what lies between matches stays as it is."""
    held = lambda t: source.contains(F.lower(t)) | source.contains(F.replace(F.lower(t), F.lit("\\"), F.lit("/")))
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(held(m), m).otherwise(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern), matches, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def strip_ungrounded(text: Column, source: Column) -> Column:
    """text without paths, qualified names and error names that the evidence (lower case) lacks; null where nothing is left."""
    out = _without_foreign(_without_foreign(F.coalesce(text, F.lit("")), PROSE_PATH, source), PROSE_SYMBOL, source)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r" +([,.;:!?)])", "$1"), r"\( +", "(")
    return F.nullif(strip(out), F.lit(""))


def salvaged(cards: DataFrame) -> DataFrame:
    """cards: implement, shape, boundaries, acceptance. Labels written into implement move to the columns they name, if all three are empty."""
    none = F.coalesce(F.nullif("shape", F.lit("")), F.nullif("boundaries", F.lit("")), F.nullif("acceptance", F.lit(""))).isNull()
    rows = cards.withColumn("_labelled", F.coalesce(none & F.col("implement").rlike(r"(?i)implement_shape\s*:"), F.lit(False)))
    for name in ("shape", "boundaries", "acceptance"):
        rows = rows.withColumn(name, F.when(F.col("_labelled"), F.nullif(strip(F.regexp_extract("implement", SALVAGE.format(name), 1)), F.lit(""))).otherwise(F.col(name)))
    found = F.coalesce("shape", "boundaries", "acceptance").isNotNull()
    return rows.withColumn("implement", F.when(~(F.col("_labelled") & found), F.col("implement"))).drop("_labelled")


def _complete() -> Column:
    return F.col("problem").isNotNull() & F.coalesce("implement", "shape").isNotNull()


def admitted(proposed: DataFrame, chunks: DataFrame) -> DataFrame:
    """proposed: card_id, session_id, the NARRATIVE columns, files, symbols, pitfalls, conditions, source_ids; chunks: chunk_id,
    session_id, text. The cards that have a problem, a change and a source of their own session, before and after prose loses
    what the session doesn't hold; lists keep what the cited chunks hold."""
    rows = salvaged(proposed)
    for name in NARRATIVE:
        rows = rows.withColumn(name, F.nullif(strip(F.col(name)), F.lit("")))
    cites = rows.select("card_id", "session_id", F.explode(F.array_distinct("source_ids")).alias("chunk_id"))
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda c: c["text"]), "\n"))
    cited = cites.join(chunks.select("chunk_id", "session_id", "text"), ["chunk_id", "session_id"]).groupBy("card_id").agg(text.alias("_cited"), F.collect_set("chunk_id").alias("_known"))
    told = chunks.join(rows.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(text.alias("_told"))
    rows = rows.join(cited, "card_id").join(told, "session_id").where(_complete())
    for name in NARRATIVE:
        rows = rows.withColumn(name, strip_ungrounded(F.col(name), F.col("_told")))
    held = lambda v: F.col("_cited").contains(F.lower(v))
    known = F.filter("conditions", lambda c: c["type"].isin(CONDITION_TYPES) & held(c["value"]))
    as_error = F.transform(known, lambda c: F.struct(F.when((c["type"] == "symbol") & c["value"].rlike(r"^[A-Z][A-Za-z0-9]*(?:Error|Exception|Warning|Fault)$"), F.lit("error")).otherwise(c["type"]).alias("type"), c["value"].alias("value")))
    rows = rows.where(_complete()).withColumns({
        "source_ids": F.filter("source_ids", lambda s: F.array_contains("_known", s)),
        "files": F.slice(F.filter("files", lambda p: held(F.replace(strip(p), F.lit("\\"), F.lit("/"))) & (strip(p) != "")), 1, MOST_FILES),
        "symbols": F.slice(F.filter("symbols", held), 1, MOST_SYMBOLS),
        "pitfalls": F.slice(F.filter("pitfalls", lambda p: pitfall_grounded(p, F.col("_cited"))), 1, MOST_PITFALLS),
        "conditions": F.slice(as_error, 1, MOST_CONDITIONS)})
    return rows.drop("_cited", "_told", "_known")


def clamped_files(files: Column, final: Column) -> Column:
    """files that share a base name with the final diff's; all, where none does."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    kept = F.filter(files, lambda p: F.array_contains(F.transform(final, base), base(p)))
    return F.when(F.size(kept) > 0, kept).otherwise(files)


def conditions(declared: Column, files: Column, problem: Column, evidence: Column, most: int = MOST_CONDITIONS) -> Column:
    """Facts that bound where a card applies: those declared, modules of the first files, a version, tests, frames and errors of
    the evidence; each once whatever its case, the first `most`. Errors are those that the problem names, if it names any."""
    every = lambda c, pattern, group: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + pattern), F.lit(group))
    tag = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    given = lambda values: F.filter(values, lambda v: v != "")
    node = lambda v: F.concat(extraction.clean_path(F.regexp_extract(v, "^([^:]*)", 1)), F.when(v.contains("::"), F.concat(F.lit("::"), F.substring_index(v, "::", -1))).otherwise(F.lit("")))
    tests = F.filter(F.transform(F.concat(every(evidence, TEST_NODE, 1), every(evidence, FAILED_TEST, 1)), node), lambda v: ~extraction.is_scratch_path(F.substring_index(v, "::", 1)))
    frames = F.zip_with(F.transform(every(evidence, FRAME, 1), extraction.clean_path), every(evidence, FRAME, 2), lambda p, n: F.struct(p.alias("p"), n.alias("n")))
    frames = F.filter(frames, lambda f: (f["p"] != "") & ~f["p"].startswith("<") & ~extraction.is_scratch_path(f["p"]))
    frames = F.transform(frames, lambda f: F.concat(f["p"], F.lit(":"), f["n"]))
    asked = every(problem, ERROR_NAME, 1)
    errors = F.filter(every(evidence, ERROR_NAME, 1), lambda e: (F.size(asked) == 0) | F.array_contains(asked, e))
    found = F.concat(
        F.coalesce(declared.cast(CONDITIONS), F.array().cast(CONDITIONS)), tag("module", given(F.transform(F.slice(files, 1, 3), lambda f: F.regexp_extract(f, MODULE, 1)))),
        tag("version", F.slice(every(problem, VERSION, 1), 1, 1)), tag("test_name", F.slice(F.array_distinct(tests), 1, 3)), tag("frame", F.slice(F.array_distinct(frames), 1, 2)), tag("error", F.slice(F.array_distinct(errors), 1, 3)))
    same = lambda a, b: (a["type"] == b["type"]) & (F.lower(a["value"]) == F.lower(b["value"]))
    once = F.aggregate(found, F.array().cast(CONDITIONS), lambda kept, c: F.when(F.exists(kept, lambda k: same(k, c)), kept).otherwise(F.concat(kept, F.array(c))))
    return F.slice(once, 1, most)


def quotes_patch(mechanism: Column, patch: Column) -> Column:
    """The mechanism holds an added line of four words or more."""
    added = F.transform(F.filter(F.transform(lines(patch), strip), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: strip(F.regexp_replace(F.lower(F.substr(x, F.lit(2))), r"(?U)\s+", " ")))
    telling = F.filter(F.transform(added, lambda x: F.regexp_replace(x, "^[#*\\- ]+", "")), lambda x: F.size(F.split(x, " ")) >= 4)
    text = strip(F.regexp_replace(F.lower(mechanism), r"(?U)\s+", " "))
    return F.exists(telling, lambda x: text.contains(x))


def shows_patch(query_anchors: Column, files: Column, text: Column, patch: Column) -> Column:
    """Whether a query may see a card's change: it has none, or they share a file's base name, or the card's text holds a snake_case symbol
    of the query; a query without any anchor may. query_anchors: array of (kind, value)."""
    base = lambda p: F.lower(F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1))
    values = lambda kind: F.transform(F.filter(query_anchors, lambda a: a["kind"] == kind), lambda a: a["value"])
    paths = F.transform(F.filter(values("path"), lambda v: strip(v) != ""), base)
    names = F.transform(F.filter(values("symbol"), lambda v: v.contains("_")), F.lower)
    shared = F.arrays_overlap(paths, F.transform(files, base)) | F.exists(names, lambda n: F.lower(text).contains(n))
    unanchored = F.size(query_anchors) == 0
    return F.when(~F.coalesce(F.length(patch) > 0, F.lit(False)), True).when((F.size(paths) == 0) & (F.size(names) == 0), unanchored).otherwise(F.coalesce(shared, F.lit(False)))


def kind_of(said: Column, *texts: Column) -> Column:
    """debug or feature: what a card says of itself (aliases included), where its texts don't tell otherwise; texts with a cue of either
    kind, those of debug first, else debug. debug said of texts that only ask for a feature is a feature."""
    text = F.lower(F.concat_ws(" ", *texts))
    cued = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda cue: text.contains(cue))
    inferred = F.when(~cued(DEBUG_CUES) & cued(FEATURE_CUES), F.lit("feature")).otherwise(F.lit("debug"))
    low = F.lower(strip(said))
    return F.when(low.isin(KINDS["feature"]), F.lit("feature")).otherwise(inferred)


def joined_once(parts: Column) -> Column:
    """Parts with white space collapsed, joined by blanks; a part that the text before it holds, whatever its case, is left out."""
    clean = F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.aggregate(clean, F.lit(""), lambda out, p: F.when(F.lower(out).contains(F.lower(p)), out).when(out == "", p).otherwise(F.concat(out, F.lit(" "), p)))


def faces(cards: DataFrame) -> Column:
    """The text of a card by field, as it is indexed: problem, locate, implement, test. cards: columns as in rendering.CARD; those that a
    table lacks count as absent."""
    c = card_columns(cards)
    one = lambda *names: [F.array(c(n)) for n in names]
    of = lambda *kinds: F.transform(F.filter(c("conditions"), lambda x: x["type"].isin(*kinds)), lambda x: x["value"])
    groups = {
        "problem": [*one("problem"), of("error", "version")], "locate": [*one("locate"), c("files"), c("symbols"), of("module", "symbol", "frame")],
        "implement": [*one("implement", "patch"), c("pitfalls"), *one("shape", "boundaries", "acceptance")], "test": [*one("cmd", "result"), of("test_name")]}
    return F.create_map(*[x for name, parts in groups.items() for x in (F.lit(name), joined_once(F.concat(*parts)))])


def spans(text: Column, prefix: str, most: int) -> Column:
    """Numbered pieces (id, text) of the first `most` characters, each an exact part of the text: up to a sentence's or line's end, else a
    blank beyond half of 240 characters, else 240."""
    pieces = F.filter(F.transform(F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit(SPAN), F.lit(0)), strip), lambda t: t != "")
    return F.transform(pieces, lambda t, i: F.struct(F.concat(F.lit(prefix), F.format_string("%02d", i + 1)).alias("id"), t.alias("text")))


def evidence_chunks(chunks: DataFrame, marks: tuple[str, ...] = ("diff --git", "Traceback", "[工具调用]", "passed")) -> DataFrame:
    """chunks: kind, text. Those of a kind that shows work, or whose text holds a mark."""
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.col("text").contains(mark)
    return chunks.where(F.col("kind").isin(EVIDENCE_KINDS) | marked)


def once_per_session(cards: DataFrame, order: str = "card_id") -> DataFrame:
    """cards: session_id, problem, files. Of cards of a session with the same problem and files the first."""
    key = F.sha2(F.concat_ws("\x1f", F.coalesce("problem", F.lit("")), F.array_join(F.coalesce("files", F.array().cast("array<string>")), "\x1e")).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy("session_id", key).orderBy(order))
    return cards.withColumn("_n", place).where("_n = 1").drop("_n")
