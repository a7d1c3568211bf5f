"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order ORDER over words (with start padding and an end mark) are trained on a bounded sample of
labelled rows, one on toxic, one on ordinary texts; a word counts once per different text. The highest order keeps counts per class with absolute discounting;
below it both classes back off to one Kneser-Ney model of shared continuation counts, so rare expressions get their
likelihood from what both classes have seen. What differs between the classes is then the log-likelihood ratio of each
character after its context, and a word's ratio is the sum over its characters.

A text gives three length-normalised figures: its mean ratio per word, the highest mean ratio in a window of WINDOW
words, and the highest of a single word. A logistic regression, fitted on labelled rows held out from the counts, turns
them into a score; TAU is where a text is called toxic.

Sample: labelled ids outside the held-out fold (crc32 of the id modulo 3), at most SAMPLE_ROWS per class taken by the
order of a hash of the id, whole texts (one of each id); the models and what reaches the driver are bounded by this. Every
row is scored. Label, language, source and id are no inputs of a score.

Nulls and edges: a null text scores like an empty one; without labelled rows of both classes every score is 0; a null
label is no label; labels repeated for an id count once, toxic if any is; of several texts under a sampled id the least
trains; ties in the sample's order go to the smaller id; very long texts are scored whole, by their worst window too;
repeated rows score alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, fold_column, fold_of, with_computed

ORDER = 6
#: Discount of the class counts (more than 1: a single document is no evidence), and of the shared lower orders.
CLASS_DISCOUNT = 1.5
DISCOUNT = 0.75
SAMPLE_ROWS = 3000
WINDOW = 12
FOLDS = 3
HELD_OUT = 1
TAU = 0.7
CACHE_ENTRIES = 200_000
PAD, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Ratios:
    """Log-likelihood ratios of the two models: by the highest-order n-grams that either class has seen, and by context
    where the character is new to both."""

    def __init__(self, seen: dict[str, float], context: dict[str, float]):
        self.seen, self.context = seen, context
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        known = self.cache.get(word)
        if known is None:
            padded = PAD * (ORDER - 1) + word + END
            known = 0.0
            for i in range(len(word) + 1):
                gram = padded[i : i + ORDER]
                ratio = self.seen.get(gram)
                known += self.context.get(gram[:-1], 0.0) if ratio is None else ratio
            if len(word) <= 40:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[word] = known
        return known

    def figures(self, text: str) -> tuple[float, float, float]:
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0.0
        ratios = np.fromiter(map(self.word, words), dtype=float, count=len(words))
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        w = min(WINDOW, len(words))
        return float(ratios.mean()), float((sums[w:] - sums[:-w]).max() / w), float(ratios.max())


def fit(toxic: Counter, ordinary: Counter, order: int = ORDER, class_discount: float = CLASS_DISCOUNT, discount: float = DISCOUNT) -> Ratios:
    """From word counts by class."""
    classes = []
    for words in (toxic, ordinary):
        grams: Counter = Counter()
        for word, n in words.items():
            padded = PAD * (order - 1) + word + END
            for i in range(len(word) + 1):
                grams[padded[i : i + order]] += n
        classes.append(grams)
    # Shared lower orders: an n-gram counts once for each different character before it.
    pooled = set(classes[0]) | set(classes[1])
    shared: list[dict[str, float]] = []
    level = Counter(g[1:] for g in pooled)
    for _ in range(order - 1):
        shared.append(level)
        level = Counter(g[1:] for g in level)
    shared.reverse()  # shared[n - 1]: continuation counts of n-grams
    totals, kinds = [], []
    for counts in shared:
        total, kind = defaultdict(float), defaultdict(int)
        for g, c in counts.items():
            total[g[:-1]] += c
            kind[g[:-1]] += 1
        totals.append(total)
        kinds.append(kind)
    alphabet = len(shared[0]) + 1
    memo: dict[str, float] = {}

    def lower(gram: str) -> float:
        if not gram:
            return 1.0 / alphabet
        if (p := memo.get(gram)) is None:
            n, h = len(gram) - 1, gram[:-1]
            t = totals[n].get(h, 0)
            back = lower(gram[1:])
            p = (max(shared[n].get(gram, 0) - discount, 0.0) + discount * kinds[n][h] * back) / t if t else back
            if len(gram) < order:
                memo[gram] = p
        return p

    sums, freed = [defaultdict(float), defaultdict(float)], [defaultdict(float), defaultdict(float)]
    for k, grams in enumerate(classes):
        for g, c in grams.items():
            sums[k][g[:-1]] += c
            freed[k][g[:-1]] += min(c, class_discount)

    def log_probability(k: int, gram: str) -> float:
        h = gram[:-1]
        back = lower(gram[1:])
        if not sums[k].get(h):
            return math.log(back)
        return math.log((max(classes[k].get(gram, 0) - class_discount, 0.0) + freed[k][h] * back) / sums[k][h])

    def log_backoff(k: int, h: str) -> float:
        return math.log(freed[k][h] / sums[k][h]) if sums[k].get(h) else 0.0

    seen = {g: log_probability(0, g) - log_probability(1, g) for g in pooled}
    context = {h: log_backoff(0, h) - log_backoff(1, h) for h in {*sums[0], *sums[1]}}
    return Ratios(seen, context)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (bias first) by Newton's method on standardised columns, classes weighed alike."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return np.r_[w[0] - (w[1:] * mean / dev).sum(), w[1:] / dev]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Ratios, np.ndarray] | None:
    """The models and the weights of the regression, from the bounded sample; None without rows of both classes."""
    marked = labels.select(F.col("doc_id").alias("m_id"), F.col("toxic").cast("int").alias("m_toxic")).where("m_toxic IN (0, 1) AND m_id IS NOT NULL")
    marked = marked.where(fold_column(F.col("m_id"), FOLDS) != HELD_OUT).groupBy("m_id").agg(F.max("m_toxic").alias("m_toxic"))
    marked = marked.withColumn("m_order", F.xxhash64("m_id"))
    parts = [marked.where(F.col("m_toxic") == c).orderBy("m_order", "m_id").limit(sample_rows) for c in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample_rows rows of three numbers
    texts = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("m_id"))
    texts = texts.groupBy("doc_id", "m_toxic", "m_order").agg(F.min("text").alias("text"))  # an id's rows may be any number
    texts = texts.orderBy("m_order", "doc_id")
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    fitting: list[tuple[str, int]] = []
    different: set[bytes] = set()
    for row in texts.select("doc_id", "text", "m_toxic").toLocalIterator():
        text = row["text"] or ""
        digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
        if digest in different:
            continue
        different.add(digest)
        if fold_of(row["doc_id"], 10) < 6:
            counts[1 - row["m_toxic"]].update(set(words_of(text)))
        else:
            fitting.append((text, row["m_toxic"]))
    y = np.array([t for _, t in fitting])
    if not counts[0] or not counts[1] or not 0 < y.sum() < len(y):
        return None
    ratios = fit(*counts)
    x = np.array([ratios.figures(t) for t, _ in fitting])
    ratios.cache.clear()
    return ratios, logistic(x, y)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, tau: float = TAU) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Returns doc_id, held_out, score, predicted."""
    rows = with_scores(docs.select("doc_id", "text"), docs, labels, sample_rows)
    held = fold_column(F.col("doc_id"), FOLDS) == HELD_OUT
    return rows.select("doc_id", held.alias("held_out"), F.col("m_score").alias("score"), (F.col("m_score") >= tau).cast("int").alias("predicted"))


def with_scores(rows: DataFrame, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rows (with a column text) with m_score added; the models are trained on docs."""
    trained = train(docs, labels, sample_rows)
    shared = rows.sparkSession.sparkContext.broadcast(trained and (trained[0].seen, trained[0].context, trained[1]))

    def start():
        if shared.value is None:
            return lambda texts: (np.zeros(len(texts)),)
        seen, context, weights = shared.value
        ratios = Ratios(seen, context)

        def compute(texts: list[str | None]) -> tuple:
            x = np.array([ratios.figures(t or "") for t in texts]).reshape(len(texts), 3)
            return (1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))),)

        return compute

    return with_computed(rows, ("text",), start, {"m_score": "double"})


def without_toxic(docs: DataFrame, labels: DataFrame, tau: float = TAU) -> DataFrame:
    """docs without the rows that score tau or more."""
    rows, restored = aside(docs, ("doc_id", "text"))
    return restored(with_scores(rows, rows, labels).where(F.col("m_score") < tau))
