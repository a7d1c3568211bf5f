"""Tokens, clean-up and identities of texts as native columns, beside the same as DuckDB SQL (functions sql_*).

Indexing and querying share tokens(): identifiers and dotted numbers with their parts, CJK bigrams, path-like runs with
their base names. Whole corpora go through term_counts(): one Arrow function that finds the words of a text once, takes
apart each different word once in a worker (words repeat), and counts within the row, so that no token is shuffled to be
counted. Every function maps null to an empty array or string.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that define a token, and the lists of words that are none.
WORD = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
PATHISH = r"[A-Za-z0-9_][A-Za-z0-9_./\\-]{2,}[A-Za-z0-9_]"
PATH_MARK = r"[/\\]|\.[A-Za-z]{1,6}$"
CJK = "[一-鿿]+"
LONGEST = 64
CONTENT_WORD = "[a-z0-9_]{3,}"
STOPWORDS = """the a an is are was were be been of to in on at for with by from as that this it its which what when where how why and or not no do does
    did should would could can will code following best most likely task answer option options question memory historical""".split()
HTML_COMMENT = "(?s)<!--.*?-->"
URL = r"(?i)\b(?:https?|ftp)://\S+"
MD_LINK = r"!?\[([^\]]*)\]\([^)]*\)"
CHECKBOX = r"(?m)^\s*[-*]\s*\[[ xX]\]\s*.*$"
BOILERPLATE = r"(?mi)^\s*(?:##\s*(?:PR summary|PR checklist|Checklist|Description)\s*)$"
HTML_TAG = r"</?[A-Za-z][^>\n]{0,80}>"
HEADING_MARK = r"(?m)^\s{0,3}#{1,6}\s+"
OPTION_PREFIX = r"^\s*(?:[A-Za-z]|[0-9]{1,2})\s*[.):、]\s*"
JUNK_VALUES = "n/a na none null http https www".split()
JUNK_DOMAIN = r"(?i)^(?:[\w-]+\.)+(?:com|org|net|io|ai|dev|cn|edu|gov)$"
DOC_EXTENSIONS = "html md rst txt css scss".split()


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def latin_tokens(c: Column) -> Column:
    def of(word: Column) -> Column:
        low = F.lower(word)
        whole = F.when(F.length(word) <= LONGEST, F.array(low)).otherwise(F.array().cast("array<string>"))
        parts = F.transform(F.flatten(F.transform(F.split(word, "_+"), lambda p: _all(p, CAMEL))), F.lower)
        mixed = word.contains("_") | ((F.upper(word) != word) & (low != word) & ~word.rlike("^[A-Z][a-z]*$"))  # a capitalised word is its only part
        return F.concat(whole, F.when(mixed, F.filter(parts, lambda s: F.length(s).between(2, LONGEST) & (s != low))).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(_all(_text(c), WORD), of))


def cjk_bigrams(c: Column) -> Column:
    pairs = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.flatten(F.transform(_all(_text(c), CJK), pairs))


def path_tokens(c: Column) -> Column:
    low = lambda run: F.regexp_replace(F.lower(run), r"^[._\-/\\]+|[._\-/\\]+$", "")
    runs = F.filter(F.transform(F.filter(_all(_text(c), PATHISH), lambda r: r.rlike(PATH_MARK)), low), lambda x: F.length(x) > 0)

    def of(run: Column) -> Column:
        base = F.element_at(F.split(run, r"[/\\]"), -1)
        ok = lambda x: F.length(x).between(2, LONGEST)
        none = F.array().cast("array<string>")
        return F.concat(F.when(ok(run), F.array(run)).otherwise(none), F.when(ok(base) & (base != run), F.array(base)).otherwise(none))

    return F.flatten(F.transform(runs, of))


def tokens(c: Column) -> Column:
    """All tokens, repeats included."""
    return F.concat(latin_tokens(c), cjk_bigrams(c), path_tokens(c))


# The same over whole batches.
_WORD, _CAMEL, _PATHISH, _MARK, _CJK = (re.compile(p) for p in (WORD.replace(r"\p{Nd}", r"\d"), CAMEL, PATHISH, PATH_MARK, CJK))
_EDGES = "._-/\\"
_REMEMBERED = 200_000
_words: dict[str, tuple[str, ...]] = {}
_paths: dict[str, tuple[str, ...]] = {}


def _of_word(word: str) -> tuple[str, ...]:
    """The tokens of an identifier or number: itself, and its parts where it has some."""
    low = word.lower()
    whole = (low,) if len(word) <= LONGEST else ()
    if "_" not in word and (word in (low, word.upper()) or word[1:].islower()):
        return whole
    parts = (p.lower() for run in word.split("_") for p in _CAMEL.findall(run))
    return whole + tuple(p for p in parts if 2 <= len(p) <= LONGEST and p != low)


def _of_path(run: str) -> tuple[str, ...]:
    """The tokens of a run with the marks of a path: itself, and its base name; none of other runs."""
    low = run.lower().strip(_EDGES)
    if not low or not _MARK.search(run):
        return ()
    base = re.split(r"[/\\]", low)[-1]
    return tuple(dict.fromkeys(t for t in (low, base) if 2 <= len(t) <= LONGEST))


def _remembered(known: dict[str, tuple[str, ...]], of: Callable[[str], tuple[str, ...]], run: str) -> tuple[str, ...]:
    got = known.get(run)
    if got is None:
        if len(known) >= _REMEMBERED:
            known.clear()
        got = of(run)
        if len(run) <= LONGEST:
            known[run] = got
    return got


def counted(text: str | None, latin_only: bool = False) -> Counter[str]:
    """How often each token of a text occurs."""
    out: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text or "")).items():
        if len(word) <= LONGEST and word.islower() and "_" not in word:  # most words by far
            out[word] += n
        else:
            for token in _remembered(_words, _of_word, word):
                out[token] += n
    if not latin_only:
        for run in _CJK.findall(text or ""):
            out.update([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])
        for run, n in Counter(r for r in _PATHISH.findall(text or "") if "." in r or "/" in r or "\\" in r).items():
            for token in _remembered(_paths, _of_path, run):
                out[token] += n
    return out


_PAIR = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
_COUNTS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("terms", T.ArrayType(_PAIR))])


def _counts_of(texts: pa.Array, latin_only: bool) -> pa.Array:
    starts, totals, terms, tfs = [0], [], [], []
    for text in texts.to_pylist():
        found = counted(text, latin_only)
        terms.extend(found)
        tfs.extend(found.values())
        totals.append(found.total())
        starts.append(len(terms))
    pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], names=["term", "tf"])
    return pa.StructArray.from_arrays([pa.array(totals, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)], names=["n", "terms"])


@F.arrow_udf(_COUNTS)
def _all_counts(texts: pa.Array) -> pa.Array:
    return _counts_of(texts, False)


@F.arrow_udf(_COUNTS)
def _latin_counts(texts: pa.Array) -> pa.Array:
    return _counts_of(texts, True)


def term_counts(c: Column, latin_only: bool = False) -> Column:
    """struct(n, terms): how many tokens a text has, and its different ones (term, tf), in no given order."""
    # Called nondeterministic so that the optimizer doesn't run it twice (once more to drop rows that an explode finds empty).
    return (_latin_counts if latin_only else _all_counts).asNondeterministic()(c)


def content_tokens(toks: Column) -> Column:
    """Distinct tokens of two characters or more that are no stop words, in order of first occurrence."""
    return F.array_distinct(F.filter(toks, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)))


def content_words(c: Column) -> Column:
    return F.array_distinct(_all(F.lower(_text(c)), CONTENT_WORD))


def denoise(c: Column) -> Column:
    """A query without template noise; the order of the steps matters."""
    for pattern, to in ((HTML_COMMENT, " "), (URL, " "), (MD_LINK, "$1"), (CHECKBOX, ""), (BOILERPLATE, ""), (HTML_TAG, " "), (HEADING_MARK, ""), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(_text(c), r"^\s+|\s+$", "")


def denoised_or_raw(c: Column, least: int = 20) -> Column:
    clean = denoise(c)
    return F.when(F.length(clean) < least, _text(c)).otherwise(clean)


def token_estimate(c: Column) -> Column:
    """Tokens by length: none for the empty text, else length / 3.2 rounded down, plus 1."""
    n = F.length(_text(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(n / F.lit(3.2)) + 1).cast("int")


def strip_option(c: Column) -> Column:
    return F.regexp_replace(_text(c), OPTION_PREFIX, "")


def is_junk_entity(kind: Column, value: Column) -> Column:
    low = F.lower(F.trim(_text(value)))
    extension = F.element_at(F.split(low, r"\."), -1)
    return ((F.length(low) < 3) | low.isin(JUNK_VALUES) | low.contains("://") | low.startswith("www.") | low.rlike(JUNK_DOMAIN)
            | ((kind == "path") & extension.isin(DOC_EXTENSIONS)) | ((kind == "config_key") & (low.startswith("www.") | low.startswith("docs."))))


def digest(*parts: Column) -> Column:
    """sha256 of the parts, each followed by the unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\x1f"))]).cast("binary"), 256)


def message_id(user: Column, request: Column, index: Column) -> Column:
    return F.concat(F.lit("m:"), F.substring(digest(user, request, index), 1, 24))


def chunk_id(user: Column, request: Column, index: Column, order: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("c:"), F.substring(digest(user, request, index, order, start, end), 1, 24))


def card_id(user: Column, session: Column, local: Column) -> Column:
    return F.concat(F.lit("e:"), F.substring(digest(user, session, local), 1, 24))


# The same in DuckDB's SQL, on an expression t. RE2 has no lookahead, so a blank marks where the parts of an identifier split.
def sql_latin(t: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all({t}, '{WORD}'), lambda w: list_concat(
      CASE WHEN length(w) <= {LONGEST} THEN [lower(w)] ELSE [] END,
      CASE WHEN contains(w, '_') OR (upper(w) <> w AND lower(w) <> w) THEN list_filter(list_transform(
        flatten(list_transform(regexp_split_to_array(w, '_+'), lambda p: regexp_extract_all(regexp_replace(p, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))),
        lambda s: lower(s)), lambda s: length(s) BETWEEN 2 AND {LONGEST} AND s <> lower(w)) ELSE [] END)))"""


def sql_paths(t: str) -> str:
    return f"""flatten(list_transform(list_filter(list_transform(list_filter(regexp_extract_all({t}, '{PATHISH}'), lambda r: regexp_matches(r, '{PATH_MARK}')),
      lambda r: trim(lower(r), '._-/\\')), lambda r: length(r) > 0), lambda r: list_concat(
      CASE WHEN length(r) BETWEEN 2 AND {LONGEST} THEN [r] ELSE [] END,
      CASE WHEN length(regexp_extract(r, '[^/\\\\]*$')) BETWEEN 2 AND {LONGEST} AND regexp_extract(r, '[^/\\\\]*$') <> r THEN [regexp_extract(r, '[^/\\\\]*$')] ELSE [] END)))"""


def sql_tokens(t: str) -> str:
    return f"list_concat({sql_latin(t)}, {sql_paths(t)})"
