r"""Secret scans with DataFrame functions only.

Base kinds are patterns, leftmost and non-overlapping per kind. The method adds the kind "entropy": candidate strings of
at least WINDOW characters, over which a window slides; the counts of its characters are carried from step to step (one
comes in, one goes out; packed, COUNT_BITS for each character), and with them the sum of c * log2(c), from which Shannon's
entropy follows. A candidate is reported when some window reaches the bound of its character class (hex; letters with digits;
letters alone, of both cases), unless it is on the allow-list (UUIDs, digits only, one letter case without digits
between, masks, examples by name, paths of letters) or lies inside a base span.

Positions are code points, end exclusive. They come from the lengths of what lies between the matches (split) and of the
matches themselves, so one fold per kind is enough. What a lambda reads more than once is bound to a variable first (let),
as Spark evaluates an expression inside a lambda again for each element; folds gather what they give RUN elements at a
time, so work grows with the length of the text and the number of its matches, not with their product.

Nulls and edges: a null text has no secrets; empty texts likewise; every row is judged alone, so repeated rows and ties
need nothing; very long texts, tokens and lists of matches are worked whole; an empty table gives an empty result; other
columns are ignored or, in redact, kept as they are, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ENTROPY = KINDS.index("entropy")
#: Fixed patterns of the base kinds. The bounds on access (18 characters) and hex (16) sit in the patterns: a greedy run
#: that is too short has no longer part.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Classes of candidates, the first that fits counts: pattern, and bits per character that a window must reach. Random hex
#: has about 3.3, random letters and digits 4.0, random letters of both cases 4.0; prose with digits stays near 3.2.
CLASSES = (
    (r"^(?=[a-fA-F]*[0-9])[0-9a-fA-F]+$", 2.9),
    (r"[0-9]", 3.6),
    (r"^(?=(?:[^A-Z]*[A-Z]){4})(?=(?:[^a-z]*[a-z]){4})", 3.95),
)
ALLOWED = (
    r"^[0-9+/_=-]+$"  # digits only
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # UUID
    r"|^[a-z/_=+-]*[0-9]+$|^[A-Z/_=+-]*[0-9]+$"  # a word of one case and a number
    r"|^[A-Za-z]{0,8}[_=-]?(?:x+|X+|0+)$"  # masks
    r"|(?i:(?:example|placeholder)(?:_?-?key|_?-?token|_?-?secret)?)$"
    r"|^[A-Za-z_-]*/[A-Za-z_/-]*$"  # paths
)
#: Candidates hold characters from "+" (43) to "z" (122); a long has the counts of PER_WORD of them.
FIRST_CODE, LAST_CODE = 43, 122
COUNT_BITS = 5
PER_WORD = 12
WORDS = (LAST_CODE - FIRST_CODE) // PER_WORD + 1
RUN = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a variable that holds value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _gathered(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """A fold over the array items that gathers an array: step gives the next state and an array of what goes out."""

    def one(at: Column, item: Column) -> Column:
        new, out = step(at["state"], item)
        return F.struct(new.alias("state"), F.concat(at["out"], out).alias("out"))

    def run(at: Column, k: Column) -> Column:
        fresh = F.struct(at["state"].alias("state"), F.array().cast(kind).alias("out"))
        part = F.aggregate(F.slice(items, k * RUN + 1, F.lit(RUN)), fresh, one)
        return let(part, lambda done: F.struct(done["state"].alias("state"), F.concat(at["out"], done["out"]).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), (F.size(items) / RUN).cast("int")), start, run, lambda at: at["out"])


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of s (a candidate); 0 if s is shorter. A window has
    less than 2 ** COUNT_BITS characters."""
    #: n * log2(n) of each count that a window can have.
    weigh = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])

    def highest(codes: Column) -> Column:
        def count(words: Column, code: Column) -> Column:
            shift = (code % PER_WORD) * COUNT_BITS
            return F.call_function("shiftright", F.get(words, (code / PER_WORD).cast("int")), shift.cast("int")).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

        def changed(words: Column, code: Column, by: int) -> Column:
            unit = F.call_function("shiftleft", F.lit(by).cast("long"), ((code % PER_WORD) * COUNT_BITS).cast("int"))
            return let(F.struct((code / PER_WORD).cast("int").alias("at"), unit.alias("unit")), lambda x: F.transform(words, lambda w, k: F.when(k == x["at"], w + x["unit"]).otherwise(w)))

        def moved(words: Column, total: Column, code: Column, by: int) -> Column:
            return let(count(words, code), lambda n: F.struct(changed(words, code, by).alias("words"), (total + F.get(weigh, n + by) - F.get(weigh, n)).alias("total")))

        def step(state: Column, at: Column) -> Column:
            kept = F.when(at >= window, moved(state["words"], state["total"], F.get(codes, at - window), -1)).otherwise(F.struct(state["words"].alias("words"), state["total"].alias("total")))
            now = let(kept, lambda x: moved(x["words"], x["total"], F.get(codes, at), 1))
            best = lambda x: F.when(at >= window - 1, F.least(state["least"], x["total"])).otherwise(state["least"])
            return let(now, lambda x: F.struct(x["words"].alias("words"), x["total"].alias("total"), best(x).alias("least")))

        most = window * math.log2(window)
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), WORDS).alias("words"), F.lit(0.0).alias("total"), F.lit(most).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda x: F.lit(math.log2(window)) - x["least"] / window)

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST_CODE)
    return F.when(F.length(s) >= window, let(codes, highest)).otherwise(F.lit(0.0))


def _none() -> Column:
    return F.array().cast(SPAN)


def _matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the matches of pattern whose second group has at least so many characters (0: all). Candidates carry what they match."""

    def placed(pieces: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            begin = at + F.length(F.get(pieces["between"], i))
            end = begin + F.length(F.get(pieces["found"], i))
            value = F.get(pieces["found"], i) if kind == ENTROPY else F.lit(None).cast("string")
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))
            return end, (F.when(F.length(F.get(pieces["value"], i)) >= least, span).otherwise(_none()) if least else span)

        return let(F.sequence(F.lit(0), F.size(pieces["found"]) - 1), lambda indices: _gathered(indices, F.lit(0), step, SPAN))

    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.struct(every(0).alias("found"), F.split(text, pattern, -1).alias("between"), *([every(2).alias("value")] if least else []))
    return F.when(text.rlike(pattern), let(pieces, placed)).otherwise(_none())


def _is_secret(value: Column) -> Column:
    bound = F.coalesce(*[F.when(value.rlike(pattern), F.lit(bits)) for pattern, bits in CLASSES])
    return ~value.rlike(ALLOWED) & F.coalesce(F.when(bound.isNotNull(), window_entropy(value) >= bound), F.lit(False))


def spans(text: Column) -> Column:
    """All spans of a text as structs (start, kind index, end, value), by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    base = F.concat(_matches(t, ASSIGN, 0, ASSIGN_LEAST), _matches(t, ACCESS, 1), _matches(t, HEX, 2))

    def step(reach: Column, span: Column) -> tuple[Column, Column]:
        # In order of start, a candidate lies inside a base span where the furthest end of those before is not before its own.
        own = span["kind"] == ENTROPY
        out = F.when(~own | (span["end"] > reach), F.array(span)).otherwise(_none())
        return F.when(own, reach).otherwise(F.greatest(reach, span["end"])), out

    def with_candidates(sure: Column) -> Column:
        every = F.array_sort(F.concat(sure, _matches(t, CANDIDATE, ENTROPY)))
        open_ = let(every, lambda x: F.when(F.size(x) > F.size(sure), _gathered(x, F.lit(0), step, SPAN)).otherwise(x))
        return F.filter(open_, lambda x: (x["kind"] != ENTROPY) | _is_secret(x["value"]))

    return let(base, with_candidates)


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    rows = docs.select("doc_id", spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < ENTROPY)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_entropy"),
                       F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _redacted(text: Column, found: Column, mark: str) -> Column:
    """The text with a mark in place of each run of overlapping spans. Texts are cut into chunks first, so that a piece costs its
    own length and at most two chunks, not all that lies before it."""

    def of_chunks(chunks: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = (begin / CHUNK).cast("int")
            joined = F.array_join(F.slice(chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(end > begin, F.substring(joined, begin - first * CHUNK + 1, end - begin)).otherwise(F.lit(""))

        def step(at: Column, span: Column) -> tuple[Column, Column]:
            out = F.when(span["start"] >= at, F.array(piece(at, span["start"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
            return F.greatest(at, span["end"]), out

        last = F.aggregate(found, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(_gathered(found, F.lit(0), step, "array<string>"), ""), let(last, lambda x: piece(x, F.length(text))))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), of_chunks)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); n_chars follows where it is a column.
    A null text stays null."""
    clean = let(spans(F.col("text")), lambda found: F.when(F.size(found) > 0, _redacted(F.col("text"), found, mark)).otherwise(F.col("text")))
    columns = [clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
