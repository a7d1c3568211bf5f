"""Quality rules from tokeniser fertility.

Public vocabularies (VOCABULARIES) cut the words of a text: a sentencepiece one with byte fallback, and a byte-level one
for many languages. Of each vocabulary three figures follow: characters per token, the share of tokens that are
bytes of a character and not whole ones, and the Shannon entropy of the token distribution, as a share of its maximum
(the logarithm of the smaller of token count and ENTROPY_CAP). Every text that passes the base rules is held against two
bands per vocabulary, both widened by w = sqrt(1 + SHORT_TOKENS / tokens), which falls to 1 as texts grow:

* a fixed wide band per script (Latin or other), for all three figures;
* a band of characters per token per language and script, measured over all texts that pass the base rules: the median,
  less SPREADS_BELOW or plus SPREADS_ABOVE robust spreads (quartile distance / 1.349). A language's median and spread are
  weighed with those of its script over all languages as if the script gave PRIOR_TEXTS texts, and the script's with the
  PRIOR constants alike, so that a band comes to rest smoothly as texts gather and no number of texts switches it on.
  Medians and quartiles come from counts in cells of 1/CELL of the natural logarithm, so they are exact to a cell, the
  same on every run, and pre-aggregated to a few hundred rows per language.

Base rules: fewer than 10 words, or more than 20 % of words inside 5-word windows that occur twice or more.

Nulls and edges: a null text has no words (base_failed); a null language is a language of its own; rows are judged alone
but for the bands, so repeated rows and ties need nothing; very long texts are worked whole, a text at a time once
PART_CHARS are gathered; an empty table gives an empty result; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import functools
import re
from collections import defaultdict
from itertools import chain, islice
from itertools import count as counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, kept, load_ranks, tokenizer_path, with_computed

#: Name of the figures' columns to public file.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "multi": "byte_bpe_multi_50k.tiktoken"}
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
ENTROPY_CAP = 2048
SYMBOLS = "#*$%&|<>"
#: By script: least and most characters per token, most byte share, least share of the possible entropy.
BANDS = {"latin": (1.2, 10.0, 0.25, 0.30), "other": (0.2, 10.0, 0.97, 0.25)}
SPREADS_BELOW = 4.0
SPREADS_ABOVE = 8.0
#: Median and spread of the logarithm of characters per token that a script starts from.
PRIOR = {"latin": (1.2, 0.2), "other": (0.3, 0.4)}
PRIOR_TEXTS = 20
CELL = 200
#: A text of this many tokens has bands wider by the root of two.
SHORT_TOKENS = 150
#: What a worker remembers of words: so many, of so many bytes in all.
CACHE_WORDS = 300_000
CACHE_BYTES = 16 << 20
#: Characters that are worked at a time.
PART_CHARS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Vocabulary:
    """Token ids of words by one public vocabulary; is_byte tells the tokens that hold a part of a character."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            ranks = load_ranks(path)
            # A word is one pre-token, so merges run over the whole of it; a line's end, which no word holds, parts two words.
            encoding = tiktoken.Encoding("words", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.array([not _whole(t) for t, _ in sorted(ranks.items(), key=lambda x: x[1])])

            def cut(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                ids = np.array(encoding.encode_ordinary((b"\n".join(words) + b"\n").decode("utf-8", "replace")), dtype=np.int32)
                ends = np.flatnonzero(ids == ranks[b"\n"])
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

            self.cut = cut
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])

            def cut(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                found = pieces.encode(words, num_threads=1)
                return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

            self.cut = cut
        self.clear()

    def clear(self) -> None:
        self.tokens, self.starts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def add(self, words: list[bytes]) -> None:
        tokens, lengths = self.cut(words)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.tokens = np.concatenate([self.tokens, tokens])

    def figures(self, words: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its number of tokens, of byte tokens, and its token entropy; owner: the text of each word."""
        lengths = self.starts[words + 1] - self.starts[words]
        of = np.repeat(owner, lengths)
        within = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = self.tokens[np.repeat(self.starts[words], lengths) + within]
        n = np.bincount(of, minlength=texts)
        n_bytes = np.bincount(of[self.is_byte[tokens]], minlength=texts)
        ranked = of * len(self.is_byte) + tokens
        ranked.sort()
        first = np.flatnonzero(np.diff(ranked, prepend=-1))
        counts = np.diff(first, append=len(ranked))
        bits = np.bincount(ranked[first] // len(self.is_byte), weights=counts * np.log2(counts), minlength=texts)
        some = np.maximum(n, 1)
        return n, n_bytes, np.maximum(0.0, np.log2(some) - bits / some)


class Lexicon:
    """Numbers for words, and what the vocabularies make of them. Bounded: between parts it is emptied when full."""

    def __init__(self, paths: tuple[str, ...]):
        self.vocabularies = [Vocabulary(p) for p in paths]
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(counter().__next__)
        self.known = self.bytes = 0
        for v in self.vocabularies:
            v.clear()

    def read(self, lists: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of the lists, one after the other."""
        if len(self.numbers) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.clear()
        out = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=sum(map(len, lists)))
        if new := list(islice(self.numbers, self.known, None)):
            self.bytes += sum(map(len, new))
            self.known += len(new)
            for v in self.vocabularies:
                v.add(new)
        return out


@functools.lru_cache(maxsize=2)
def lexicon(paths: tuple[str, ...]) -> Lexicon:
    return Lexicon(paths)


def repeated_words(words: np.ndarray, owner: np.ndarray, texts: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each text the words inside a window of `window` words that occurs twice or more in it, the first time included.
    words: numbers of the words of all texts, one after the other; owner: the text of each. Windows are told apart by a hash;
    those whose hash occurs again are then compared by their words, so the counts are exact."""
    n = len(words) - window + 1
    if n < 2:
        return np.zeros(texts, dtype=np.int64)
    h = owner[:n].astype(np.uint64)
    for k in range(window):
        h = (h + words[k : k + n].astype(np.uint64) + np.uint64(1)) * MIX
        h ^= h >> np.uint64(32)
    places = np.flatnonzero(owner[:n] == owner[window - 1 :])
    ranked = np.sort(h[places])
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(again):
        return np.zeros(texts, dtype=np.int64)
    at = np.minimum(np.searchsorted(again, h[places]), len(again) - 1)
    places = places[again[at] == h[places]]
    rows = np.stack([owner[places], *(words[places + k] for k in range(window))], axis=1)
    _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    places = places[times[which.reshape(-1)] > 1]
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + window, -1)
    return np.bincount(owner[np.cumsum(inside[:-1]) > 0], minlength=texts)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """"latin" if at least half of the letters are below U+0250, else "other"."""
    try:
        text.encode("latin-1")
        return "latin"
    except UnicodeEncodeError:
        pass
    codes, times = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
    letter = np.fromiter((chr(c).isalpha() for c in codes.tolist()), dtype=bool, count=len(codes))
    return "other" if 2 * times[letter & (codes < 0x250)].sum() < times[letter].sum() else "latin"


BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "script": "string"}
MEASURED = {"tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy": "double"}


def _columns(names: tuple[str, ...]) -> dict[str, str]:
    return BASE | {f"{name}_{figure}": kind for name in names for figure, kind in MEASURED.items()}


def _part(texts: list[str], words: Lexicon) -> list[list]:
    """The columns of some texts."""
    lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at exactly the blanks of the rules
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    owner = np.repeat(np.arange(len(texts)), sizes)
    numbers = words.read(lists)
    chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], dtype=np.int64)
    repeats = repeated_words(numbers, owner, len(texts))
    failed = (sizes < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * sizes)
    out = [sizes, chars, [sum(map(t.count, SYMBOLS)) for t in texts], list(map(duplicate_lines, texts)), repeats, failed, list(map(script_of, texts))]
    for v in words.vocabularies:
        n, n_bytes, entropy = v.figures(numbers, owner, len(texts))
        some = np.maximum(n, 1)
        out += [n, chars / some, n_bytes / some, entropy]
    return [list(c) for c in out]


def figures(docs: DataFrame, paths: dict[str, str] | None = None) -> DataFrame:
    """docs: doc_id, text, lang. The base counts and each vocabulary's figures of every text. paths: file by name."""
    paths = paths or {name: tokenizer_path(file) for name, file in VOCABULARIES.items()}
    columns = _columns(tuple(paths))

    def start():
        words = lexicon(tuple(paths.values()))

        def compute(texts: list[str | None]) -> tuple:
            out: list[list] = [[] for _ in columns]
            part: list[str] = []
            size = 0
            for k, text in enumerate(texts, 1):
                part.append(text or "")
                size += len(part[-1])
                if size >= PART_CHARS or k == len(texts):
                    for whole, new in zip(out, _part(part, words)):
                        whole.extend(new)
                    part, size = [], 0
            return tuple(out)

        return compute

    rows = docs.select("doc_id", "text", F.lower(F.col("lang").cast("string")).alias("lang"))
    return with_computed(rows, ("text",), start, columns, without=("text",))


def _middles(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, n, middle, spread of cells (by, cell, times)."""
    of = Window.partitionBy(*by)
    upto = F.sum("times").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.groupBy(*by, "cell").agg(F.sum("times").alias("times")).withColumn("upto", upto).withColumn("n", F.sum("times").over(of))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, (F.col("cell") + 0.5) / CELL))
    out = cells.groupBy(*by, "n").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
    return out.select(*by, "n", "middle", F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(2.0 / CELL)).alias("spread"))


def measured_bands(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """b_lang, b_script and, by vocabulary, name_middle and name_spread (natural logarithms) for every language and script of rows."""
    per_token = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_chars_per_token").alias("x")) for n in names]))
    good = rows.where(~F.col("base_failed")).select("lang", "script", per_token.alias("f")).where(F.col("f")["x"] > 0)
    cells = kept(good.groupBy("lang", "script", F.col("f")["name"].alias("name"), F.floor(F.ln(F.col("f")["x"]) * CELL).alias("cell")).agg(F.count("*").alias("times")))
    prior = lambda k: F.coalesce(*[F.when(F.col("script") == s, F.lit(v[k])) for s, v in PRIOR.items()])
    weighed = lambda own, n, other: (F.col(own) * F.col(n) + other * PRIOR_TEXTS) / (F.col(n) + PRIOR_TEXTS)
    scripts = _middles(cells, ("script", "name")).select("script", "name", weighed("middle", "n", prior(0)).alias("s_middle"), weighed("spread", "n", prior(1)).alias("s_spread"))
    bands = _middles(cells, ("lang", "script", "name")).join(scripts, ["script", "name"])
    bands = bands.select(F.col("lang").alias("b_lang"), F.col("script").alias("b_script"), "name", weighed("middle", "n", F.col("s_middle")).alias("m"), weighed("spread", "n", F.col("s_spread")).alias("s"))
    return bands.groupBy("b_lang", "b_script").agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{full}") for n in names for c, full in (("m", "middle"), ("s", "spread"))])


def rules(docs: DataFrame, paths: dict[str, str] | None = None, bands: dict = BANDS) -> DataFrame:
    """docs: doc_id, text, lang. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, script, and by vocabulary the figures name_tokens, name_chars_per_token, name_byte_share, name_entropy."""
    names = tuple(paths or VOCABULARIES)
    rows = kept(figures(docs, paths))
    measured = broadcast_if_small(kept(measured_bands(rows, names)))
    joined = rows.join(measured, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("script") == F.col("b_script")), "left")
    verdict = ~F.col("base_failed")
    for name in names:
        n, chars, share, entropy = (F.col(f"{name}_{figure}") for figure in MEASURED)
        wide = F.sqrt(F.lit(1.0) + F.lit(float(SHORT_TOKENS)) / F.greatest(n, F.lit(1)))
        possible = F.log2(F.greatest(F.lit(2), F.least(n, F.lit(ENTROPY_CAP))).cast("double"))
        fixed = F.lit(False)
        for script, (low, high, most_bytes, least_entropy) in bands.items():
            fixed = fixed | ((F.col("script") == script) & (chars * wide >= low) & (chars <= F.lit(high) * wide) & (share <= F.lit(most_bytes) * wide) & (entropy * wide >= possible * least_entropy))
        away = (F.ln(F.greatest(chars, F.lit(1e-9))) - F.col(f"{name}_middle")) / (F.col(f"{name}_spread") * wide)
        verdict = verdict & fixed & F.coalesce((away >= -SPREADS_BELOW) & (away <= SPREADS_ABOVE), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "script", *[c for c in _columns(names) if c not in BASE])
