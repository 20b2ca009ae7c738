import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import cli
from fieldloom.functions.variogram import Structure, Variogram
from fieldloom.operators import kriging
from fieldloom.operators.kriging import Kriging
from fieldloom.operators.neighbours import Search
from fieldloom.sources import tables
from fieldloom.streaming.refresh import latest, refresh

TEXT = "# a comment\n! another\n\n id, x, y, value\n1 0.0 0.0 1.0\n2, 10.0, 0.0, 2.0\n# between\n3\t0.0 10.0 3.d0\n4 10.0 10.0\n"


def test_points_by_place(spark, tmp_path):
    (tmp_path / "obs.txt").write_text(TEXT)
    got = tables.read_points(spark, str(tmp_path / "obs.txt"), ["x", "y", "value"]).orderBy("obs_id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, 1.0), (2, 10.0, 0.0, 2.0), (3, 0.0, 10.0, 3.0), (4, 10.0, 10.0, None)]


def test_raster(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 10\ncellsize 2\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    got = [tuple(r) for r in tables.read_raster(spark, str(tmp_path / "g.asc")).orderBy("block_id").collect()]
    assert got[0] == (1, 0, 0, 1.0, 13.0, 1.0) and got[4] == (5, 1, 1, 3.0, 11.0, None) and len(got) == 6


def test_weights_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 2.0)], "obs_id long, x double, y double, value double")
    t = spark.createDataFrame([(1, 0.3, 0.0)], "block_id long, x double, y double")
    k = Kriging(Variogram((Structure("exp", 1.0, 5.0),)), search=Search(2))
    table = kriging.solve(obs, t, k)
    tables.write_weights(table, str(tmp_path / "w"), k)
    again = tables.read_weights(spark, str(tmp_path / "w"), k)
    assert kriging.apply(again, obs, k).collect() == kriging.apply(table, obs, k).collect()
    with pytest.raises(ValueError):
        tables.read_weights(spark, str(tmp_path / "w"), Kriging(k.vgm, ("x",)))
    assert "exp" in k.describe()


def test_command_line(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("id,x,y,value\n" + "".join(f"{k},{k % 4},{k // 4},{k * 1.5}\n" for k in range(16)))
    (tmp_path / "grid.csv").write_text("id,x,y\n1,0.5,0.5\n2,2.5,1.5\n")
    base = ["--obs", str(tmp_path / "obs.csv"), "--grid", str(tmp_path / "grid.csv"), "--vgm", "sph,0.1,1,5;*gau,0,1,9,9,9,0,0,0", "--nmax", "6"]
    cli.run(spark, cli.options([*base, "--output", str(tmp_path / "out"), "--weights-out", str(tmp_path / "w")]))
    rows = [r for f in glob.glob(str(tmp_path / "out" / "*.csv")) for r in csv.DictReader(open(f))]
    assert {r["block_id"] for r in rows} == {"1", "2"} and set(rows[0]) == {"block_id", "x", "y", "estimate", "variance"}
    again = cli.run(spark, cli.options([*base, "--output", str(tmp_path / "out2"), "--weights-in", str(tmp_path / "w")])).collect()
    assert np.allclose(sorted(r.estimate for r in again), sorted(float(r["estimate"]) for r in rows))
    sims = cli.run(spark, cli.options([*base, "--output", str(tmp_path / "out3"), "--nsim", "2", "--nscore"]))
    assert sims.columns == ["block_id", "x", "y", "sim_1", "sim_2"]
    (tmp_path / "run.nml").write_text(f"! comment\n&data\n obs = '{tmp_path}/obs.csv'\n vgm = 'sph,0.1,1,5' nmax = 5\n/\n&out\n output = '{tmp_path}/out4' cross_validation = .true.\n/\n")
    assert cli.run(spark, cli.options(["--config", str(tmp_path / "run.nml")])).count() == 16
    with pytest.raises(SystemExit):
        cli.options(["--obs", "x"])
    with pytest.raises(ValueError):
        cli.structures("sph,1")


def test_weight_store_is_bound_to_its_inputs(spark, tmp_path):
    obs = spark.createDataFrame([(i, float(i % 7), float(i // 7), i * 1.5) for i in range(40)], "obs_id long, x double, y double, value double")
    t = spark.createDataFrame([(i, i * 0.3, i * 0.2) for i in range(20)], "block_id long, x double, y double")
    k = Kriging(Variogram((Structure("exp", 1.0, 5.0),)), search=Search(4))
    table = kriging.solve(obs, t, k)
    tables.write_weights(table, str(tmp_path / "w"), k, obs)
    tables.write_weights(table, str(tmp_path / "w"), k, obs)  # the newest manifest counts
    store = tables.weight_store(spark, str(tmp_path / "w"), k)
    assert (store.manifest.blocks, store.manifest.weights) == (20, 80) and "nmax=4" in store.manifest.search
    other = obs.withColumn("value", F.col("value") * 2 + 1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = store.replay(other, k)
        plan = again._jdf.queryExecution().executedPlan().toString()
        by_source = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "src_id" in line]
        assert "Bucketed: true" in plan and len(by_source) == 1, plan  # the values; the stored weights stay where they are
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {r.block_id: r.estimate for r in kriging.apply(table, other, k).collect()}
    assert all(abs(r.estimate - want[r.block_id]) < 1e-9 for r in again.collect()) and len(want) == 20
    moved = obs.withColumn("x", F.col("x") + 1)
    for wrong in (lambda: store.replay(moved, k), lambda: tables.read_weights(spark, str(tmp_path / "w"), k, moved), lambda: tables.weight_store(spark, str(tmp_path / "w"), Kriging(k.vgm, search=Search(5)))):
        with pytest.raises(ValueError):
            wrong()


def test_command_line_of_two_variables_and_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    obs = put("o1.csv", "id,x,y,v,e\n" + "".join(f"{k},{k % 4},{k // 4},{k * 1.5},0.1\n" for k in range(16)))
    second = put("o2.csv", "id,x,y,v\n" + "".join(f"{k},{k % 4 + 0.5},{k // 4},{k * 0.5}\n" for k in range(16)))
    grid, values = put("g.csv", "id,x,y\n1,0.5,0.5\n2,2.5,1.5\n3,1.1,2.2\n"), put("rs.txt", "scale\n1 2\n1.5\n")
    text = f"&input_output\n obsfile1 = '{obs}' obsfile2 = '{second}' blockfile = '{grid}' rsfile = '{values}' lnfile = '' outfile = '{tmp_path}/out'\n/\n&dims\n ndim = 2 nobs1 = 16\n/\n&krige_opt\n nmax1 = 5 nmax2 = 3 unbias = 1 vmax = 3.4028235E+38\n/\n&variograms\n vgm_spec1 = 'sph 5 1 0.1', 'exp 9 0.5 0' vgm_spec2 = 'sph 5 1 0.1' vgm_specc = 'sph 5 0.3 0'\n/\n&flags\n writexy = .true. obserror = .true.\n/\n"
    a = cli.options(["--config", put("run.nml", text)])
    assert (a.nmax, a.nmax2, a.high, a.vgm, a.simple) == (5, 3, None, "sph,0.1,1,5;exp,0,0.5,9", False)
    out = cli.run(spark, a).orderBy("block_id").collect()
    assert len(out) == 3 and {"est_v1", "est_v2", "var_v1", "var_v2"} <= set(out[0].asDict())
    k = cli.configuration(a)
    both = cli._observations(spark, a, k, [])
    t = tables.read_points(spark, grid, ["x", "y"], "block_id").join(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.5)], "block_id long, rangescale double"), "block_id")
    want = {(r.block_id, r.var_id): r.estimate for r in kriging.estimate(both, t, k).collect()}
    assert all(abs(r.est_v1 - want[r.block_id, 1]) < 1e-9 and abs(r.est_v2 - want[r.block_id, 2]) < 1e-9 for r in out)
    base = ["--obs", obs, "--obserror", "--vgm", "sph,0.1,1,5", "--nmax", "16"]
    blocks, nodes = put("b.csv", "id,x,y,n\n1,0.5,0.5,2\n2,2.5,1.5,1\n"), put("n.csv", "id,x,y,w\n1,0.4,0.5,0.25\n2,0.6,0.5,0.75\n3,2.5,1.5,1\n")
    means = cli.run(spark, cli.options([*base, "--grid", blocks, "--nodes", nodes, "--node-weights", "--output", str(tmp_path / "m")])).orderBy("block_id").collect()
    point = {r.block_id: r.estimate for r in cli.run(spark, cli.options([*base, "--grid", put("p.csv", "id,x,y\n1,0.4,0.5\n2,0.6,0.5\n3,2.5,1.5\n"), "--output", str(tmp_path / "p")])).collect()}
    assert abs(means[1].estimate - point[3]) < 1e-9 and abs(means[0].estimate - (0.25 * point[1] + 0.75 * point[2])) < 1e-9
    sims = [*base, "--grid", grid, "--simple", "--nsim", "2", "--path", put("path.txt", "p\n3\n1\n2\n"), "--samples", put("s.txt", "e\n0 0\n0 0\n0 0\n"), "--output", str(tmp_path / "s")]
    drawn = cli.run(spark, cli.options(sims)).collect()
    assert len(drawn) == 3 and all(r.sim_1 == r.sim_2 for r in drawn)


def test_stream_refreshes_touched_blocks(spark, tmp_path):
    obs = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 50.0, 0.0, 2.0)], "obs_id long, x double, y double, value double")
    t = spark.createDataFrame([(1, 0.3, 0.0), (2, 49.0, 0.0)], "block_id long, x double, y double")
    k = Kriging(Variogram((Structure("exp", 1.0, 5.0),)), search=Search(1))
    table = kriging.solve(obs, t, k)
    fresh = spark.createDataFrame([(1, 7.0, 1), (1, 9.0, 2)], "obs_id long, value double, at long")
    fresh.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(fresh.schema).parquet(str(tmp_path / "in"))
    refresh(stream, table, obs, k, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [(r.block_id, round(r.estimate, 9)) for r in got] == [(1, 9.0)]


def test_stream_keeps_the_newest_values(spark, tmp_path):
    """Two batches and a restart give what one batch of all values gives; late older values change nothing."""
    obs = spark.createDataFrame([(i, float(i), 0.0, float(i)) for i in range(10)], "obs_id long, x double, y double, value double")
    t = spark.createDataFrame([(i, i + 0.3, 0.0) for i in range(9)], "block_id long, x double, y double")
    k = Kriging(Variogram((Structure("exp", 1.0, 5.0),)), search=Search(3))
    table = kriging.solve(obs, t, k)
    batches = [[(1, 7.0, 5), (8, 3.0, 5)], [(1, -50.0, 1), (2, 9.0, 6)], [(8, 4.0, 9)]]
    got = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "obs_id long, value double, at long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("obs_id long, value double, at long").parquet(str(tmp_path / "in"))
        refresh(stream, table, obs, k, lambda df, _: got.update({r.block_id: r.estimate for r in df.collect()}), str(tmp_path / "cp")).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], "obs_id long, value double, at long")
    want = {r.block_id: r.estimate for r in kriging.apply(table, latest(every, obs), k).collect()}
    assert got.keys() <= want.keys() and len(got) >= 6 and all(abs(got[b] - want[b]) < 1e-9 for b in got)
