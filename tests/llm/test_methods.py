"""The methods themselves against direct computations, and work that must grow with the text alone."""
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import quality_rules, secret_scan, simhash_dedup, topk_search, toxicity
from engram.llm.common import tokenizer_path

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALNUM = LETTERS + LETTERS.upper() + "0123456789"


# -- quality rules ----------------------------------------------------------------------------------------------------


def band(values, prior):
    """Median and spread of logarithms in cells, weighed with a prior."""
    if not values:
        return prior
    ranked = sorted(math.floor(math.log(v) * quality_rules.CELL) for v in values)
    at = lambda q: (ranked[max(0, math.ceil(len(ranked) * q) - 1)] + 0.5) / quality_rules.CELL
    spread = max((at(0.75) - at(0.25)) / 1.349, 2.0 / quality_rules.CELL)
    k = quality_rules.PRIOR_TEXTS
    return tuple((own * len(values) + p * k) / (len(values) + k) for own, p in zip((at(0.5), spread), prior))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(400)]
    cyrillic = ["".join(rng.choice("абвгдеиклмнопрст") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows = []
    for i in range(160):
        lang = ("en", "de", None, "ru")[i % 4]
        vocabulary = cyrillic if lang == "ru" else words
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 40, 200))))
        if i % 23 == 0:
            text = " ".join("".join(rng.choice("~^\\|<>{}0123") for _ in range(8)) for _ in range(30))
        if i % 31 == 0:
            text = "same five words again here " * 20
        rows.append((i, text, lang))
    return [*rows, (500, None, "en"), (501, "", None), (502, "é" * 40 + " \U0001f680" * 60, "xx"), (0, rows[0][1], "en"), (None, "a b c d e f g h i j k l", "en")]


def test_quality_verdict_by_hand(spark, prose):
    got = quality_rules.rules(spark.createDataFrame(prose, "doc_id long, text string, lang string")).collect()
    vocabularies = {n: quality_rules.Vocabulary(tokenizer_path(f)) for n, f in quality_rules.VOCABULARIES.items()}
    rows = []
    for i, text, lang in prose:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        letters = [c for c in text or "" if c.isalpha()]
        script = "other" if letters and 2 * sum(ord(c) < 0x250 for c in letters) < len(letters) else "latin"
        figures = {}
        for name, v in vocabularies.items():
            ids = np.concatenate([v.cut([w.encode()])[0] for w in words]) if words else np.zeros(0, int)
            n, counts = len(ids), Counter(ids.tolist())
            entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
            figures[name] = (n, sum(map(len, words)) / max(n, 1), float(v.is_byte[ids].mean()) if n else 0.0, entropy)
        rows.append([i, lang and lang.lower(), script, failed, figures])
    expected = Counter()
    for i, lang, script, failed, figures in rows:
        ok = not failed
        for name, (n, chars, share, entropy) in figures.items():
            pool = [f[name][1] for _, _, s, bad, f in rows if s == script and not bad and f[name][1] > 0]
            own = [f[name][1] for _, g, s, bad, f in rows if s == script and g == lang and not bad and f[name][1] > 0]
            if failed:
                break
            middle, spread = band(own, band(pool, quality_rules.PRIOR[script]))
            low, high, most_bytes, least = quality_rules.BANDS[script]
            wide = math.sqrt(1 + quality_rules.SHORT_TOKENS / n)
            away = (math.log(chars) - middle) / (spread * wide)
            possible = math.log2(max(2, min(n, quality_rules.ENTROPY_CAP)))
            ok &= low / wide <= chars <= high * wide and share <= most_bytes * wide and entropy * wide >= least * possible and -quality_rules.SPREADS_BELOW <= away <= quality_rules.SPREADS_ABOVE
        expected[i, failed, ok, script, *(round(x, 9) for f in figures.values() for x in f)] += 1
    names = [f"{v}_{m}" for v in quality_rules.VOCABULARIES for m in quality_rules.MEASURED]
    assert Counter((r.doc_id, r.base_failed, r.kept, r.script, *(round(r[n], 9) for n in names)) for r in got) == expected
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_a_band_does_not_switch_on_with_a_number_of_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(LETTERS) for _ in range(5)) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(100))
    middles = []
    for n in (1, 20, 49, 50, 51, 200):
        docs = spark.createDataFrame([(i, text(), "en") for i in range(n)], "doc_id long, text string, lang string")
        middles.append(quality_rules.measured_bands(quality_rules.figures(docs), tuple(quality_rules.VOCABULARIES)).first().piece_middle)
    steps = np.abs(np.diff(middles))
    assert steps[2] < 0.02 and steps[3] < 0.02 and steps.max() < 0.6


def test_words_are_counted_alike_whatever_the_cache(monkeypatch):
    paths = tuple(tokenizer_path(f) for f in quality_rules.VOCABULARIES.values())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice(LETTERS) for _ in range(4)) for _ in range(50)) for _ in range(12)] + ["x" * 100_000]
    whole = quality_rules._part(texts, quality_rules.Lexicon(paths))
    monkeypatch.setattr(quality_rules, "CACHE_WORDS", 5)
    small = quality_rules.Lexicon(paths)
    parts = [quality_rules._part([t], small) for t in texts]
    assert [[p[c][0] for p in parts] for c in range(len(whole))] == [list(c) for c in whole]


# -- secrets ----------------------------------------------------------------------------------------------------------


def entropy_spans(text, base):
    """Spans of the entropy kind from the docstring: candidates with a class, not allowed, not inside a base span, with a window of high entropy."""
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        s = m[0]
        if any(a <= m.start() and m.end() <= b for a, b in base) or re.search(secret_scan.ALLOWED.replace("(?i:", "(?i:"), s):
            continue
        bound = next((bits for pattern, bits in secret_scan.CLASSES if re.search(pattern, s)), None)
        if bound is None:
            continue
        best = 0.0
        for k in range(len(s) - secret_scan.WINDOW + 1):
            counts = Counter(s[k : k + secret_scan.WINDOW]).values()
            best = max(best, -sum(c / secret_scan.WINDOW * math.log2(c / secret_scan.WINDOW) for c in counts))
        if best >= bound:
            out.append((m.start(), m.end()))
    return out


def test_entropy_spans_by_hand(spark):
    rng = random.Random(7)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    makers = [lambda: some(ALNUM, rng.randint(18, 60)), lambda: some(LETTERS + LETTERS.upper(), rng.randint(18, 50)), lambda: some("0123456789ABCDEF", 40), lambda: some(LETTERS, 30), lambda: some("0123456789", 30),
              lambda: "src/" + some(LETTERS, 12) + "/" + some(LETTERS, 9), lambda: some(LETTERS, 9) + "/" + some(ALNUM, 22), lambda: "xxxxxxxxxxxxxxxxxxxxxxxxxx", lambda: some(ALNUM, 20) + "EXAMPLE", lambda: "ab12" * 8,
              lambda: some("0123456789abcdef", 32), lambda: "token=" + some(ALNUM, 24), lambda: "camelCaseIdentifierOfManyWords", lambda: some("ab1", 40) + some(ALNUM, 20)]
    texts = ["é " * (i % 3) + " ".join(rng.choice(makers)() for _ in range(rng.randint(1, 9))) for i in range(150)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", secret_scan.spans(F.col("text")).alias("s")).collect()
    seen = 0
    for r in got:
        base = [(s.start, s.end) for s in r.s if s.kind < 3]
        mine = [(s.start, s.end) for s in r.s if s.kind == 3]
        assert mine == entropy_spans(texts[r.doc_id], base), texts[r.doc_id]
        seen += len(mine)
    assert seen > 100


def test_planted_secrets_outside_the_base_kinds(spark):
    texts = ["aws " + "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzT9kQm2Lh4" + " x", "key: GhTkLmPqRsVwXyZaBcDfEjNo end", "see docs/of/the/project and placeholder_placeholder_key", "nothing in this plain sentence of words"]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_entropy for i in range(4)] == [1, 1, 0, 0]
    clean = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert clean[0] == "aws [SECRET] x" and clean[3] == texts[3]


def test_secrets_grow_with_the_text_alone(spark):
    rng = random.Random(9)
    texts = ["é " + "".join(rng.choice(ALNUM) for _ in range(100_000)), " ".join(f"{rng.getrandbits(64):016x}" for _ in range(50_000)), "token=aaaaaaaaaaaa " * 20_000, "ab" * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame).collect()}
    assert time.time() - began < 90
    assert got[0].spans == "entropy:2:100002" and got[1].n_hex == 50_000 and got[2].n_assign == 20_000 and got[3].n_hex == 1
    assert clean[1] == " ".join(["[SECRET]"] * 50_000) and clean[2] == "[SECRET] " * 20_000 and clean[0] == "é [SECRET]"


# -- toxicity ---------------------------------------------------------------------------------------------------------


def kneser_ney(toxic, ordinary, order, class_discount, discount):
    """p(k, gram) by the recursive definition, from scratch for each call."""
    classes = []
    for words in (toxic, ordinary):
        grams = Counter()
        for word, n in words.items():
            padded = toxicity.PAD * (order - 1) + word + toxicity.END
            for i in range(len(word) + 1):
                grams[padded[i : i + order]] += n
        classes.append(grams)
    seen = set(classes[0]) | set(classes[1])
    tables = {order: seen}
    for n in range(order - 1, 0, -1):
        tables[n] = {g[1:] for g in tables[n + 1]}
    left = lambda g: sum(1 for x in tables[len(g) + 1] if x[1:] == g)

    def lower(g):
        if not g:
            return 1.0 / (len(tables[1]) + 1)
        of = [x for x in tables[len(g)] if x[:-1] == g[:-1]]
        total = sum(map(left, of))
        if not total:
            return lower(g[1:])
        return (max(left(g) - discount, 0.0) * (g in tables[len(g)]) + discount * len(of) * lower(g[1:])) / total

    def p(k, g):
        of = {x: c for x, c in classes[k].items() if x[:-1] == g[:-1]}
        if not of:
            return lower(g[1:])
        free = sum(min(c, class_discount) for c in of.values())
        return (max(of.get(g, 0) - class_discount, 0.0) + free * lower(g[1:])) / sum(of.values())

    return p


def test_kneser_ney_by_definition():
    toxic, ordinary = Counter({"vilk": 5, "vilks": 2, "grob": 1, "on": 3}), Counter({"on": 9, "over": 4, "grow": 2, "villa": 1})
    order, cd, d = 4, 1.5, 0.75
    ratios, p = toxicity.fit(toxic, ordinary, order, cd, d), kneser_ney(toxic, ordinary, order, cd, d)
    for gram, ratio in ratios.seen.items():
        assert ratio == pytest.approx(math.log(p(0, gram)) - math.log(p(1, gram)), abs=1e-9), gram
    alphabet = sorted({c for w in (*toxic, *ordinary) for c in w} | {toxicity.END})
    for h in ("\x02\x02v", "\x02gr", "zzz", "vil"):  # a distribution over the characters and one unknown
        for k in (0, 1):
            assert sum(p(k, h + c) for c in alphabet) + p(k, h + "?") == pytest.approx(1.0, abs=0.08)
    for h, ratio in ratios.context.items():  # an unseen character: what backing off costs in either class
        assert ratio == pytest.approx(math.log(p(0, h + "\x01")) - math.log(p(1, h + "\x01")), abs=1e-9)


def test_windows_of_figures():
    ratios = toxicity.Ratios({}, {})
    ratios.cache.update({w: v for w, v in zip("abcdefgh", (3.0, -1.0, -1.0, 2.0, 2.5, -1.0, -1.0, -1.0))})
    text = " ".join("bcadebcfgh" * 3)
    words = toxicity.words_of(text)
    values = [ratios.cache[w] for w in words]
    windows = [sum(values[k : k + toxicity.WINDOW]) / toxicity.WINDOW for k in range(len(values) - toxicity.WINDOW + 1)]
    assert ratios.figures(text) == pytest.approx((sum(values) / len(values), max(windows), 3.0))
    assert ratios.figures("") == (0.0, 0.0, 0.0) and ratios.figures("a")[1] == 3.0


def test_one_text_of_a_repeated_id_trains(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = [(i, ("vilk vilks " if i % 2 else "calm day ") + f"w{i}") for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + rows * 3 + [(3, "zz later text")], "doc_id long, text string")
    assert toxicity.train(once, labels)[1] == pytest.approx(toxicity.train(many, labels)[1])


# -- top-k search -----------------------------------------------------------------------------------------------------


def brute(vectors, ids, queries, k=10):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64)
    out = {}
    for q in queries:
        scores = x @ x[ids.index(q)]
        out[q] = [(-s, i) for s, i in sorted((-int(s), i) for s, i in zip(scores, ids) if i != q)[:k]]
    return out


def found(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.score, r.vec_id))
    return {q: [(s, i) for s, i in v] for q, v in out.items()}


@pytest.mark.parametrize("kind", ["clusters", "flat", "ties"])
def test_topk_prunes_and_stays_exact(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    n, dim = 3000, 32
    if kind == "clusters":
        x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dim))
    elif kind == "flat":
        x = rng.normal(size=(n, dim))
    else:
        x = np.round(rng.normal(size=(40, dim)), 1)[rng.integers(0, 40, n)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(topk_search, "SEED_ROWS", 200)
    left = []
    got = found(topk_search.search(frame, F.col("m_id") % 100 == 0, query_block=17, survivors=left).collect())
    assert got == {q: [(s, i) for s, i in v] for q, v in brute(x.tolist(), list(range(n)), range(0, n, 100)).items()}
    assert left == sorted(left, reverse=True) and left[0] >= 30 * n * 0.9
    if kind == "clusters":
        assert left[3] < 0.6 * left[0]


def test_topk_carries_its_threshold_over_batches():
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.normal(size=(4000, 16)))
    asked = topk_search.Asked(np.arange(10) + 10_000, x[:10] + 0.0, np.zeros(0, np.int64), np.zeros((0, 16)), 5)
    best = topk_search.Best(asked, 5)
    left = []
    for p in range(0, 4000, 500):
        before = best.alive.copy()
        best.take(np.arange(p, p + 500), x[p : p + 500])
        left.append((best.alive - before)[-1])
    assert left[0] == 5000 and max(left[1:]) < 4500


def test_topk_beyond_exact_doubles(spark):
    big = [[3.0e6 + i, -2.0e6 * (i % 3), 1.0e6] for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    assert found(topk_search.search(frame, F.col("m_id") % 10 == 0, k=3).collect()) == brute(big, list(range(30)), (0, 10, 20), 3)


# -- near copies ------------------------------------------------------------------------------------------------------


def test_keep_one_never_loses_a_group(spark):
    rng = random.Random(2)
    a, b = (" ".join("".join(rng.choice(LETTERS) for _ in range(5)) for _ in range(80)) for _ in range(2))
    keep = lambda *rows: sorted(map(tuple, simhash_dedup.keep_one(spark.createDataFrame(list(rows), "doc_id long, text string")).collect()))
    assert keep((1, a), (5, a), (5, b)) == [(1, a), (5, b)]
    assert keep((5, a), (5, b)) == sorted([(5, a), (5, b)])
    assert keep((5, a), (5, a)) == [(5, a)]


def test_a_group_of_a_third_of_all_rows(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(LETTERS) for _ in range(5)) for _ in range(30)) for _ in range(60)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[1 + i % 59]) for i in range(3000)]
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in rows}
