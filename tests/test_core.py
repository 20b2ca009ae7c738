import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fieldloom.functions.variogram import Structure, Variogram
from fieldloom.operators import kriging
from fieldloom.plans import core, further, general

SF = "/root/testdata/sf0.001"


QUERIES, ORACLE_SQL = core.QUERIES | general.QUERIES | further.QUERIES, core.ORACLE_SQL | general.ORACLE_SQL | further.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("supplier", "nation", "part", "events", "customer", "orders", "lineitem", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    keys = list(got.columns)
    got, want = (f.sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) > 0
    for c in keys:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=1e-8)
        else:
            assert (got[c] == want[c]).all()


def line(spark, xs, zs):
    return spark.createDataFrame([(k, float(x), float(z)) for k, (x, z) in enumerate(zip(xs, zs))], "obs_id long, x double, value double")


def test_pure_nugget_is_the_mean(spark):
    target = spark.createDataFrame([(0, 10.0)], "block_id long, x double")
    r = kriging.ordinary_kriging(line(spark, [0, 1, 2], [1, 3, 5]), target, Variogram((Structure("nug", 2.0, 1.0),)), 8, ["x"]).first()
    assert r.estimate == pytest.approx(3.0) and r.variance == pytest.approx(8 / 3)


def test_spherical_midpoint(spark):
    target = spark.createDataFrame([(0, 1.0)], "block_id long, x double")
    r = kriging.ordinary_kriging(line(spark, [0, 2], [1, 3]), target, Variogram((Structure("sph", 4.0, 2.0),)), 8, ["x"]).first()
    assert r.estimate == pytest.approx(2.0) and r.variance == pytest.approx(3.5)


def test_exact_at_observations(spark):
    obs = line(spark, [0, 1, 4], [2, 7, 1])
    target = obs.selectExpr("obs_id as block_id", "x")
    rows = kriging.ordinary_kriging(obs, target, Variogram((Structure("sph", 4.0, 5.0),)), 8, ["x"]).orderBy("block_id").collect()
    assert [r.estimate for r in rows] == pytest.approx([2, 7, 1]) and all(abs(r.variance) < 1e-9 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
