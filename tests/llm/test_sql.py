"""Corpus queries against their SQL."""

import duckdb
import numpy as np
import pytest

from fieldloom.llm import embedding_dedup, oracles, queries

SF = "/root/testdata/sf0.001"


def _same(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    got, want = (f[names].sort_values(names, ignore_index=True) for f in (got, want))
    for c in names:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), rtol=0, atol=2e-9, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    _same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df())


def test_embedding_classes_match_sql(spark, tmp_path):
    """Clusters, chains, copies, odd vectors and lengths, two labels."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 16))
    x = [c + r.normal(size=16) * s for c in centres for s in (0.05, 0.1, 0.2, 0.25) for _ in range(12)]
    turn = [[np.cos(a), np.sin(a)] for a in np.arange(0, 2, 0.3)]
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)] + [(1000 + k, [float(c) for c in v], 1) for k, v in enumerate(turn)]
    rows += [(2000, x[0].tolist(), 0), (2001, x[0].tolist(), 0), (2002, [0.0] * 16, 0), (2003, None, 0), (2004, [float("nan")] * 16, 0), (2005, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).toPandas()
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    _same(got, con.execute(oracles.EMBEDDINGS).df())
    assert got.n_links.max() > 5 and (got.component_id != got.vec_id).sum() > 50
