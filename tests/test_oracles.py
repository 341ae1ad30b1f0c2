"""Every registered query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from recollect.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return str(pd.Timestamp(v))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert ours == theirs


def test_order_of_rows_does_not_matter(spark, sf_dir):
    from recollect.operators import units
    from recollect.plans import adapters

    m = adapters.clean_conversations(spark, sf_dir)
    shuffled = m.repartition(7, "seq")
    a = sorted(map(str, units.memory_units(m).collect()))
    assert a == sorted(map(str, units.memory_units(shuffled).collect()))


def test_kmeans_and_hashing(spark, sf_dir):
    from recollect.operators import embed

    labels = catalog.QUERIES["q_kmeans_labels"](spark, sf_dir).collect()
    assert len({r["style_cluster"] for r in labels}) <= embed.cluster_count(len(labels))
    vectors = catalog.QUERIES["q_embed_hashing"](spark, sf_dir).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-4 for r in vectors if any(r["embedding"]))
    assert [embed.cluster_count(n) for n in (29, 30, 100_000)] == [1, 6, 23]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
