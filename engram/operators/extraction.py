"""Facts that rules take from texts: entities, files, symbols, verification, hazards, grounding."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity patterns by kind, with the group that holds the value.
_EXTENSIONS = "py|pyi|js|jsx|mjs|cjs|ts|tsx|go|rs|java|kt|rb|php|c|h|cc|cpp|hpp|cs|swift|scala|sh|bash|zsh|ps1|sql|json|ya?ml|toml|ini|cfg|conf"
ENTITIES = (
    ("path", r"(?<![\w./\\-])(?:[A-Za-z]:)?(?:\.{0,2}[/\\])?(?:[\w.+-]+[/\\])*[\w.+-]+\.(?:" + _EXTENSIONS + r"|env|md|txt|csv|xml|html|css|scss|vue|svelte|proto|gradle|mod|lock)(?![\w./\\-])", 0),
    ("path", r"(?<![\w./\\-])(?:[\w.+-]+[/\\]){1,}[\w.+-]+(?![\w./\\-])", 0),
    ("test_name", r"""\b(?:expect|describe|it|test|Should|Verify|Assert)\(\s*["']([^"'\n]{1,120})["']""", 1),
    ("test_name", r"\b(?:def\s+)?(test_[A-Za-z0-9_]{2,80})\b", 1),
    ("test_name", r"\b([A-Za-z0-9_]{2,80}_test)\b", 1),
    ("error", r"\b([A-Z][A-Za-z0-9]*(?:Error|Exception|Warning|Fault))\b", 1),
    ("error", r"\b((?:E|W|C|TS|HTTP|errno|ERR_)[A-Z0-9_]{2,20})\b", 1),
    ("error", r"\b([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception):\s*[^\n]{3,160})", 1),
    ("config_key", r"\b([a-z][a-z0-9_]*(?:\.[a-z0-9_]+){1,6})\b", 1),
    ("config_key", r"\b([A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+)\b", 1),
)
SYMBOL = r"\b([A-Za-z_][A-Za-z0-9_]{3,60})\b"
NOISE_SYMBOLS = """true false none null self this return import from class def function const let var public private static async await print printf error
    value string number object array result data test tests should assert expect describe https http localhost the and for with that readme license
    changelog contributing makefile dockerfile pyproject setup""".split()
ISSUE = r"(?<![\w#])#(\d{2,6})\b"
DIFF_FILES = r"(?m)^diff --git a/(\S+) b/(\S+)"
ADDED_DEF = r"(?m)^\+\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"
ADDED_CLASS = r"(?m)^\+\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"
COMMAND_LINE = r"(?m)^\s*(?:\$|>|PS [A-Z]:)\s*(\S.*)$"
TEST_HINT = r"(?i)\b(pytest|py\.test|python\s+-m\s+pytest|python\s+\S*(?:test|repro|check)\S*\.py|npm\s+(?:run\s+)?test|yarn\s+test|go\s+test|cargo\s+test|mvn\s|gradle\s|tox|nox|make\s+test|unittest)\b"
RESULT_LINE = r"(?m)^\s*(?:=+\s*)?(\d+\s+(?:passed|failed|error|errors|skipped)\b[^\n]*)$"
SCRATCH_NAMES = "test_issue.py conftest_issue.py test_comprehensive.py reproduce_issue.py repro.py".split()
SCRATCH_MARKS = "site-packages/ dist-packages/ miniconda anaconda /lib/python /home/ home/ .ds_store manual.yaml".split()
DIGEST_LINE = r"(?i)(?:def\s+test_|assert\b|pytest\.raises|@pytest\.mark)"
HARNESS = ("swebench_9_15/testbed/", "swebench_9_15/", "testbed/")
OBJECT_DUMP = r"(?i)0x[0-9a-f]{6,}|OrderedDict\(\[|<[A-Za-z_][\w.]*(?:\.[A-Za-z_]\w+)* object at|array\(\[[^\]]{20,}"
TOOL_ARTEFACT = r"(?i)^(?:\[tool_result\]|\[tool:|todos?\s+(?:have|has)\s+been|file\s+(?:created|updated|written) successfully|the file .* has been (?:created|updated))"
HAZARDS = (
    ("code", r"(?m)(?:^\s*```|^\s*diff --git\b|^\s*@@)"),
    ("command", r"(?i)(?:^\s*\$\s+\S|\bpytest\b|\bpython(?:3(?:\.\d+)?)?\s+-m\b|\bpip\s+install\b|\bgit\s+(?:checkout|diff|apply|clone|log|show)\b|\bnpm\s+|\bcargo\s+test\b|\bgo\s+test\b)"),
    ("path", r"[A-Za-z0-9_./\\~-]+\.(?:" + _EXTENSIONS + r"|gradle|mod|lock)\b"),
    ("line", r"(?i)\bline\s+\d+\b|\bL\d{1,6}\b|:\d{2,5}\b"),
    ("narration", r"(?i)\b(?:the\s+)?(?:fix|patch|solution|implementation)\b|\bchanges?\s+made\b|\b(?:we|i)\s+(?:added|changed|modified|removed|created|updated|replaced|wrapped|introduced|implemented|fixed|set|moved|renamed|deleted)\b|\bthis\s+(?:fix|patch|change|solution)\b"),
    ("imperative", r"(?i)^\s*(?:add|modify|change|remove|replace|set|use|ensure|wrap|guard|check|call|initialize|initialise|update|fix|implement|introduce|make|apply|insert|delete|move|rename|refactor|run|test)\b"),
)
ANCHORS = (
    HAZARDS[2][1], r"\b[A-Za-z_]\w{1,}(?:\.[A-Za-z_]\w{1,})+\b", r"\b(?=\w*_)\w+\b", r"\b[A-Z][A-Za-z0-9]*(?:Error|Exception|Warning|Fault)\b",
)
MOST_FILES, MOST_SYMBOLS, MOST_PER_KIND, MOST_DIGEST = 8, 12, 12, 12


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + pattern), F.lit(group))


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))


def entities(text: Column, code_like: Column | None = None) -> Column:
    """Distinct (kind, value), values in lower case; symbols only where code_like."""
    found = []
    for kind, pattern, group in ENTITIES:
        values = F.transform(_all(text, pattern, group), lambda v: F.regexp_replace(v, r"""^[\s"'`]+|[\s"'`]+$""", ""))
        if kind == "path":
            values = F.transform(values, lambda v: F.regexp_replace(v, r"[.,;:]+$", ""))
            values = F.filter(values, lambda v: v.rlike(r"[/\\]") | v.rlike(r"\.[A-Za-z]{1,6}$"))
        if kind == "config_key":
            values = F.filter(values, lambda v: ~F.lower(v).isin(NOISE_SYMBOLS))
        values = F.filter(values, lambda v: F.length(v).between(3, 200))
        found.append(_tagged(values, kind))
    if code_like is not None:
        symbol = F.filter(_all(text, SYMBOL, 1), lambda v: ~F.lower(v).isin(NOISE_SYMBOLS) & (v.rlike("^.+[A-Z]") | v.contains("_")))
        found.append(F.when(code_like, _tagged(symbol, "symbol")).otherwise(
            F.array().cast("array<struct<kind:string,value:string>>")))
    return F.array_distinct(F.concat(*found))


def capped(found: Column, most: int = MOST_PER_KIND) -> Column:
    """Of each kind the first `most`."""
    kinds = F.array_distinct(F.transform(found, lambda e: e["kind"]))
    return F.flatten(F.transform(kinds, lambda k: F.slice(F.filter(found, lambda e: e["kind"] == k), 1, most)))


def clean_path(path: Column) -> Column:
    """With forward slashes, relative to the repository: without the sides of a diff and what a harness puts before."""
    path = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(?:\./)+", "")
    path = F.regexp_replace(path, "^[ab]/", "")
    inner = path
    for prefix in reversed(HARNESS):  # the first of the list that occurs counts
        before = rf"(?is)^.*?{prefix}"
        inner = F.when(path.rlike(before), F.regexp_replace(path, before, "")).otherwise(inner)
    path = inner
    return F.regexp_replace(path, "^/+|/+$", "")


def is_scratch_path(path: Column) -> Column:
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    base = F.element_at(F.split(low, "/"), -1)
    out = base.isin(SCRATCH_NAMES) | low.rlike(r"^test_[^/]*\.py$")
    for mark in SCRATCH_MARKS:
        out = out | low.contains(mark)
    return out


def is_real_diff(text: Column) -> Column:
    return text.contains("diff --git ") | (text.rlike(r"(?m)^--- .+\n\+\+\+ .+") & text.rlike("(?m)^@@ "))


def files_of_patch(text: Column, most: int = MOST_FILES) -> Column:
    both = F.flatten(F.transform(F.arrays_zip(_all(text, DIFF_FILES, 1).alias("a"), _all(text, DIFF_FILES, 2).alias("b")), lambda p: F.array(p["a"], p["b"])))
    return F.slice(F.array_distinct(F.filter(F.transform(both, clean_path), lambda p: (p != "") & ~is_scratch_path(p))), 1, most)


def symbols_of_patch(text: Column, most: int = MOST_SYMBOLS) -> Column:
    return F.slice(F.array_distinct(F.concat(_all(text, ADDED_DEF, 1), _all(text, ADDED_CLASS, 1))), 1, most)


def test_commands(text: Column) -> Column:
    """Prompted commands that run tests and aren't scratch scripts."""
    scratch = lambda c: F.lower(c).rlike("|".join(n.replace(".", r"\.") for n in SCRATCH_NAMES)) | (F.lower(c).rlike(r"(?:^|[\s;&|])test_[a-z0-9_]+\.py\b") & ~F.lower(c).contains("tests/"))
    commands = F.transform(_all(text, COMMAND_LINE, 1), lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 300))
    return F.filter(commands, lambda c: c.rlike(TEST_HINT) & ~scratch(c))


def verification(text: Column) -> Column:
    """struct(cmd, expect): the last test command, and the last passed result line, else the last one; null without a command."""
    results = F.transform(_all(text, RESULT_LINE, 1), lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")))
    passed = F.filter(results, lambda r: F.lower(r).contains("passed") & ~F.lower(r).rlike("failed|error"))
    commands = test_commands(text)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.when(F.size(commands) > 0, F.struct(last(commands).alias("cmd"), F.coalesce(last(passed), last(results), F.lit("")).alias("expect")))


def test_digest(lines: Column, most: int = MOST_DIGEST) -> Column:
    """Distinct lines of at most 240 characters that assert something."""
    clean = F.transform(lines, lambda x: F.trim(x))
    good = F.filter(clean, lambda x: (F.length(x) > 0) & (F.length(x) <= 240) & x.rlike(DIGEST_LINE) & ~x.rlike(TOOL_ARTEFACT))
    return F.slice(F.array_distinct(F.transform(good, lambda x: F.regexp_replace(x, r"\s+", " "))), 1, most)


def hazards(value: Column) -> Column:
    """What keeps a text from being a behaviour rather than a recipe."""
    return F.array_compact(F.array(*[F.when(value.rlike("(?U)" + p), F.lit(name)) for name, p in HAZARDS]))


def problem_hazards(value: Column) -> Column:
    """What a problem may not hold: symptoms may name commands and paths, but no pasted blocks, lines, dumps of objects or fixes."""
    patterns = {**dict(HAZARDS), "dump": OBJECT_DUMP}
    return F.array_compact(F.array(*[F.when(value.rlike("(?U)" + patterns[n]), F.lit(n)) for n in ("code", "line", "dump", "narration")]))


def ungrounded(value: Column, evidence: Column) -> Column:
    """Sorted identifiers of value that the evidence (white space collapsed, lower case) doesn't hold."""
    tokens = F.concat(*[_all(value, p, 0) for p in ANCHORS])
    tokens = F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"\\", "/")))
    held = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(evidence, F.lit(""))), r"\\", "/"), r"\s+", " ")
    return F.array_sort(F.filter(tokens, lambda t: ~held.contains(t)))


def historical(text: Column, files: Column, file_mark: str = "（历史文件）", test_mark: str = "（历史测试）") -> Column:
    """Names of files and tests replaced by marks."""
    names = F.filter(F.flatten(F.transform(files, lambda p: F.array(p, F.element_at(F.split(p, "/"), -1)))), lambda p: p != "")
    out = F.aggregate(names, F.coalesce(text, F.lit("")), lambda s, n: F.replace(s, n, F.lit(file_mark)))
    out = F.regexp_replace(out, r"\b[\w./-]+\.py::test_[A-Za-z0-9_\[\]-]+", test_mark)
    return F.regexp_replace(out, r"\btest_[A-Za-z0-9_]{2,80}\b", test_mark)
