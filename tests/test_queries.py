"""Every query of the library runs, and gives what its SQL gives in DuckDB."""
import os

import duckdb
import numpy as np
import pytest

from engram.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or value != value if isinstance(value, float) else value is None:
        return None
    if isinstance(value, (float, np.floating)):
        return f"{value:.9g}"
    if isinstance(value, (list, np.ndarray)):
        return str(list(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = [frame.columns.index(n) for n in names]
    mine = sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)
    theirs = sorted([tuple(plain(v) for v in r) for r in found.fetchall()], key=str)
    assert mine == theirs


def test_entry_without_the_corpus_operators(spark, sf):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_rerank_takes_every_line(spark, sf):
    assert QUERIES["rerank_fuse"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["finalised_cards", "finalised_sessions", "purge_counts"])
def test_store_of_more_than_a_million_parts(spark, sf, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 999900 AS p_partkey) FROM '{sf}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    frame = QUERIES[name](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(map('"{}"'.format, frame.columns))} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(found)
    if name == "finalised_cards":
        assert {(r[2] >= 1000000, r[4]) for r in found if r[2] < 1100000} == {(False, 1), (True, 0)} and any(r[2] >= 1999900 for r in found)
