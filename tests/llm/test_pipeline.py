"""The stages together, each held against what its operator decides, and each on rows that are odd."""
import collections
import hashlib
import random

import pytest

import corpus_pipeline
from engram.llm import byte_bpe, secret_scan, simhash_dedup, toxicity
from engram.llm.common import table

CLASHING = "m_score m_spans m_base m_candidates m_source m_size m_key p_source m_id m_fp m_own label component_id fp key size score copies c0 x0 m_copy tokens".split()


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "mixing", "byte_bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert name == "byte_bpe" or seen[-1].columns == docs.columns
    _, clean, single, redacted, mixed, tokens = seen
    rejected = {r.doc_id for r in toxicity.score(docs, table(spark, sf, "labels")).collect() if r.predicted}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(clean) == ids(docs) - rejected
    assert ids(single) == {r.component_id for r in simhash_dedup.near_duplicates(clean).collect()}
    assert ids(redacted) == ids(single)
    assert secret_scan.find_secrets(redacted).where("n_assign + n_access + n_hex + n_entropy > 0").count() == 0
    assert ids(mixed) <= ids(redacted) and tokens.count() == mixed.count()
    assert byte_bpe.encode(mixed).select("ids_sha256").distinct().exceptAll(tokens.select("ids_sha256").distinct()).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def pieces(bpe, text):
    """Token ids by merging the pair of least rank until none is left, pre-token by pre-token."""
    out = []
    for pre in bpe.split(text or ""):
        parts = [bytes([b]) for b in pre.encode()]
        while len(parts) > 1:
            ranked = [(bpe.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            least, k = min(ranked)
            if least == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out += [bpe.ranks[p] for p in parts]
    return out


def test_ids_by_merging(spark):
    import public_tokenizers as public

    bpe = byte_bpe.coder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    texts = ["The quick  brown\n\nfox's 1234 jumps—über naïve 日本語 \U0001f680", "", "aaaa bbbb", "x" * 300]
    assert [bpe.encode(t).tolist() for t in texts] == [pieces(bpe, t) for t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids and ties, and columns whose names clash with anything within."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(30) for _ in range(30)] + [None, "", " \n\t", text(40_000), "token=abcdefghijkl1234 " * 50, "b" * 50_000]
    rows = [(i, t, ("en", None)[i % 2], ("s1", "s2", None)[i % 3], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, text(30), "en", "s1", 1), (None, text(30), "en", "s1", 1), (None, None, None, None, None)]
    extra = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(4), extra


@pytest.mark.parametrize("at", range(5))
def test_stage_on_odd_rows(spark, sf, odd, at):
    docs, rows = odd
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, sf)
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and (name == "byte_bpe" or none.columns == docs.columns == out.columns)
    got = [tuple(r) for r in out.collect()]
    own = collections.Counter(map(str, rows))
    key = lambda r: str(r[5:])  # noqa: E731  (the extra columns tell the rows apart)
    before = {key(r): r for r in rows}
    if name == "toxicity":
        assert not collections.Counter(map(str, got)) - own and len(got) > 20
    elif name == "simhash_dedup":
        assert not collections.Counter(map(str, got)) - own
        first = [r for r in rows if r[0] is not None]
        assert {r[0] for r in got if r[0] is not None} == {r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame([r[:2] for r in first], "doc_id long, text string")).collect()}
        assert sum(r[0] is None for r in got) == 2 and sum(r[0] == 3 for r in got) == 2  # both texts of id 3
    elif name == "secret_scan":
        assert len(got) == len(rows)
        for r in got:
            was = before[key(r)]
            assert (r[0], r[2], r[3]) == (was[0], was[2], was[3])
            if was[1] and "token=" in was[1]:
                assert r[1] == "[SECRET] " * 50 and r[4] == len(r[1])
            elif was[1] and set(was[1]) == {"b"}:
                assert r[1] == "[SECRET]"
            else:
                assert r[1] == was[1] and r[4] == (None if r[1] is None else len(r[1]))
    elif name == "mixing":
        assert all(str(r) in own for r in got) and max(collections.Counter(map(key, got)).values()) <= 3 and all((r[1] or "").split() for r in got)
    else:
        assert len(got) == len(rows)
        hashes = collections.Counter((r.doc_id, r.decoded_sha256) for r in out.collect())
        assert hashes == collections.Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
