"""Estimators against dense linear algebra written out by hand, and defined results of edge cases."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import normal
from fieldloom.functions.normal import Tails, cdf, inverse, score_table, scores
from fieldloom.functions.rotation import rotation, transform
from fieldloom.functions.spacetime import SpaceTimeVariogram, TimeTransform
from fieldloom.functions.variogram import Structure, Variogram
from fieldloom.operators import brackets, indicator, kriging, levels, neighbours, ranges, simulation, systems, targets
from fieldloom.operators.kriging import Kriging
from fieldloom.operators.neighbours import Search
from fieldloom.operators.spacetime import spacetime, spacetime_kriging

V = Variogram((Structure("sph", 3.0, 40.0, 0.2),))
TAILS = Tails(0.0, 20.0, "power", "hyperbolic", 2.0, 1.5)


def frame(spark, rows, names):
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


def scattered(spark, n=25, seed=1, dims=("x", "y")):
    r = np.random.default_rng(seed)
    x = r.uniform(0, 100, (n, len(dims)))
    z = np.sin(x[:, 0] / 20) * 5 + r.normal(0, 0.3, n)
    return x, z, frame(spark, np.column_stack([np.arange(1, n + 1), x, z]), ["obs_id", *dims, "value"]).withColumn("obs_id", F.col("obs_id").cast("long"))


def points(spark, x, dims=("x", "y")):
    return frame(spark, np.column_stack([np.arange(1, len(x) + 1), x]), ["block_id", *dims]).withColumn("block_id", F.col("block_id").cast("long"))


def by_block(df, column="estimate"):
    return np.array([r[column] for r in df.orderBy("block_id").collect()], float)


def test_rotation_turns_the_major_axis():
    assert np.allclose(rotation(90.0) @ [1, 0, 0], [0, 1, 0])  # at 90 degrees the major axis is +X
    assert np.allclose(rotation(30, 20, 10) @ rotation(30, 20, 10).T, np.eye(3))
    s = Structure("sph", 1.0, 100.0, minor1=50.0, azimuth=90.0)
    assert np.allclose(s.relative(np.array([[50.0, 0.0], [0.0, 50.0]])), [0.5, 1.0])
    assert Structure("exp", 1.0, 10.0, minor1=5.0).relative(np.array([[5.0]]))[0] == 1.0  # one dimension: the first minor range
    assert np.allclose(transform(2, 0.5), [[2, 0], [0, 1]])


def test_product_groups_and_checks():
    v = Variogram(()).add("sph", 2.0, 10.0, 0.5).add("exp", 3.0, 20.0).times("gau", 0.5, 30.0)
    assert v.at_zero() == 2.5 + 1.5
    h = 4.0
    want = 2 * (1 - 0.6 + 0.5 * 0.064) + 3 * math.exp(-0.6) * 0.5 * math.exp(-3.0625 * (4 / 30) ** 2)
    assert np.allclose(v.covariance(np.array([[h, 0.0]])), want)
    with pytest.raises(ValueError):
        Variogram((Structure("hol", 1.0, 1.0),)).check(3)
    with pytest.raises(ValueError):
        Structure("unknown", 1.0, 1.0)


def _dense(x, z, x0, v, drift=None, d0=None, err=None):
    n = len(x)
    k = v.covariance(x[:, None] - x[None]) + (np.diag(err) if err is not None else 0)
    f = np.ones((n, 1)) if drift is None else np.column_stack([drift, np.ones(n)])
    out = []
    for i, p in enumerate(x0):
        a = np.block([[k, f], [f.T, np.zeros((f.shape[1],) * 2)]])
        b = np.append(v.covariance(x - p), np.append(d0[i], 1.0) if drift is not None else 1.0)
        s = np.linalg.solve(a, b)
        out.append((s[:n] @ z, v.at_zero() - s @ b))
    return np.array(out).T


def test_ordinary_and_universal_against_dense(spark):
    x, z, obs = scattered(spark)
    x0 = np.random.default_rng(2).uniform(0, 100, (7, 2))
    got = kriging.ordinary_kriging(obs, points(spark, x0), V, 25)
    est, var = _dense(x, z, x0, V)
    assert np.allclose(by_block(got), est) and np.allclose(by_block(got, "variance"), var)
    turned = Variogram((Structure("exp", 3.0, 60.0, 0.1, 20.0, azimuth=35.0),))
    d = F.array(F.col("x") / 100, F.col("y") / 100)
    got = kriging.universal_kriging(obs.withColumn("drift", d), points(spark, x0).withColumn("drift", d), turned, 2, 25)
    est, var = _dense(x, z, x0, turned, x / 100, x0 / 100)
    assert np.allclose(by_block(got), est) and np.allclose(by_block(got, "variance"), var)


def test_exact_at_data_and_defined_nulls(spark):
    x, z, obs = scattered(spark)
    assert np.allclose(by_block(kriging.ordinary_kriging(obs, points(spark, x), V, 8)), z)
    few = obs.withColumn("value", F.when(F.col("obs_id") > 2, F.col("value")))  # two rows without a value
    est, _ = _dense(x[2:], z[2:], x[:3] + 1, V)
    assert np.allclose(by_block(kriging.ordinary_kriging(few, points(spark, x[:3] + 1), V, 25)), est)
    far = kriging.ordinary_kriging(obs, points(spark, np.array([[1e6, 1e6], [50.0, 50.0]])), V, 8, maxdist=200.0).orderBy("block_id").collect()
    assert far[0].estimate is None and far[0].variance is None and far[1].estimate is not None
    assert kriging.ordinary_kriging(obs.limit(0), points(spark, x[:2]), V).where("estimate is null").count() == 2
    assert kriging.ordinary_kriging(obs, points(spark, x[:2]).limit(0), V).count() == 0


def test_duplicates_and_failures(spark):
    _, _, obs = scattered(spark, 6)
    twice = obs.unionByName(obs.withColumn("obs_id", F.col("obs_id") + 100))
    assert targets.duplicate_places(twice, ["x", "y"]).count() == 6
    with pytest.raises(ValueError):
        kriging.solve(twice, points(spark, np.ones((1, 2))), Kriging(V, check_places=True))
    smooth = Variogram((Structure("gau", 1.0, 1e6),))
    table = kriging.solve(twice, points(spark, np.ones((2, 2))), Kriging(smooth, search=Search(12)))
    assert {r.status for r in table.select("status").collect()} <= {"jitter", "fail"}
    assert systems.counters(table).agg(F.sum("n")).first()[0] == 2
    assert kriging.apply(table, twice, Kriging(smooth)).count() == 2


def test_shared_factors(spark):
    _, _, obs = scattered(spark, 6)
    table = kriging.solve(obs, points(spark, np.random.default_rng(3).uniform(0, 100, (20, 2))).coalesce(1), Kriging(V, search=Search(10)))
    assert table.where("reused").count() > 0
    lin = systems.linear_systems(kriging.assembled(kriging.points_of(obs, Kriging(V)), points(spark, np.ones((1, 2))), Kriging(V)), Kriging(V).model())
    assert lin.where("part = 'a'").count() == 49 and lin.where("part = 'b'").count() == 7


def test_gradients_against_dense(spark):
    x, z, obs = scattered(spark, 10)
    g = np.array([[10.0, 10.0, 20.0, 10.0], [70.0, 60.0, 70.0, 80.0]])
    grads = frame(spark, [(1, k + 1, *row, 1.5, 0.1) for k, row in enumerate(g.tolist())], ["var_id", "grad_id", "x1", "y1", "x2", "y2", "value", "variance"])
    x0 = np.array([[30.0, 40.0]])
    n, c = 10, V.covariance
    pairs = lambda a, b: c(a[:, None] - b[None])
    p, s = g[:, :2], g[:, 2:]
    a = np.zeros((13, 13))
    a[:n, :n] = pairs(x, x)
    a[:n, n:12] = pairs(x, p) - pairs(x, s)
    a[n:12, :n] = a[:n, n:12].T
    a[n:12, n:12] = pairs(p, p) - pairs(p, s) - pairs(s, p) + pairs(s, s) + 0.1 * np.eye(2)
    a[:n, 12] = a[12, :n] = 1
    b = np.concatenate([c(x - x0), c(p - x0) - c(s - x0), [1]])
    w = np.linalg.solve(a, b)
    k = Kriging(V, search=Search(10), gradients=grads)
    got = kriging.estimate(obs, points(spark, x0), k).first()
    assert np.allclose([got.estimate, got.variance], [w[:12] @ np.append(z, [1.5, 1.5]), V.at_zero() - w @ b])


def test_cokriging_against_dense(spark):
    x, z, obs = scattered(spark, 8)
    y, u, second = scattered(spark, 12, 5)
    vgm = {(1, 1): V, (2, 2): Variogram((Structure("sph", 2.0, 40.0, 0.1),)), (1, 2): Variogram((Structure("sph", 1.2, 40.0),))}
    both = obs.withColumn("var_id", F.lit(1)).unionByName(second.withColumn("var_id", F.lit(2)))
    x0, n = np.array([[50.0, 20.0]]), 20
    place, var = np.vstack([x, y]), np.repeat([1, 2], [8, 12])
    k = np.zeros((n, n))
    for i in (1, 2):
        for j in (1, 2):
            at = np.ix_(var == i, var == j)
            k[at] = vgm[min(i, j), max(i, j)].covariance(place[var == i][:, None] - place[var == j][None])
    for standard in (True, False):
        f = np.stack([var == 1, var == 2], 1).astype(float) if standard else np.ones((n, 1))
        a = np.block([[k, f], [f.T, np.zeros((f.shape[1],) * 2)]])
        c0 = np.where(var == 1, vgm[1, 1].covariance(place - x0), vgm[1, 2].covariance(place - x0))
        b = np.append(c0, [1.0, 0.0] if standard else [1.0])
        w = np.linalg.solve(a, b)
        want = w[:n] @ np.append(z, u) + (0 if standard else (z.mean() - u.mean()) * w[8:20].sum())
        got = kriging.cokriging(both, points(spark, x0), vgm, 2, 20, standard=standard).where("var_id = 1").first()
        assert np.allclose([got.estimate, got.variance], [want, V.at_zero() - w @ b])
        wide = kriging.wide(kriging.cokriging(both, points(spark, x0), vgm, 2, 20), points(spark, x0), Kriging(vgm, nvar=2))
        assert wide.columns == ["block_id", "x", "y", "est_v1", "est_v2", "var_v1", "var_v2"]


def test_varying_models_and_positive_weights(spark):
    x, z, obs = scattered(spark)
    x0 = np.array([[20.0, 30.0], [60.0, 70.0]])
    rows = [(b, 1, 1, 1, "sph", 0.2, 3.0, 40.0 * b, 40.0 * b, 40.0 * b, False) for b in (1, 2)]
    vary = frame(spark, rows, ["block_id", "ivar", "jvar", "struct_idx", "vtype", "nugget", "sill", "a_major", "a_minor1", "a_minor2", "is_product"]).withColumn("azimuth", F.lit(0.0)).withColumn("dip", F.lit(0.0)).withColumn("plunge", F.lit(0.0))
    got = by_block(kriging.estimate(obs, points(spark, x0), Kriging({}, search=Search(25), varying=vary)))
    want = [_dense(x, z, x0[b : b + 1], Variogram((Structure("sph", 3.0, 40.0 * (b + 1), 0.2),)))[0][0] for b in (0, 1)]
    assert np.allclose(got, want)
    table = kriging.solve(obs, points(spark, x0), Kriging(V, search=Search(25), positive_weights=True))
    w = kriging.weight_rows(table).groupBy("block_id").agg(F.min("w").alias("lo"), F.sum("w").alias("s")).collect()
    assert all(r.lo >= 0 and abs(r.s - 1) < 1e-12 for r in w)


def test_spacetime_against_dense(spark):
    x, z, obs = scattered(spark, 20, 4, ("x", "y", "t"))
    st = SpaceTimeVariogram(V, Variogram((Structure("exp", 1.0, 30.0, 0.1),)), "sum_metric", (0.5,), TimeTransform(at=50.0))
    x0 = np.array([[30.0, 40.0, 50.0], [70.0, 10.0, 5.0]])
    got = spacetime_kriging(obs, points(spark, x0, ("x", "y", "t")), st, nmax=20, time_at=2.0)
    est, var = _dense(x, z, x0, st)
    assert np.allclose(by_block(got), est) and np.allclose(by_block(got, "variance"), var)
    assert st.at_zero() == 3.2 + 1.1 + 0.5
    assert spacetime(st, nmax=4, sectors=True).search_of(1).sectors


@pytest.mark.parametrize("dims", [("x",), ("x", "y"), ("x", "y", "z"), ("x", "y", "z", "t")])
def test_neighbours_of_many_sources(spark, dims):
    r = np.random.default_rng(len(dims))
    x = np.vstack([r.normal(0, 1, (900, len(dims))), r.uniform(-100, 100, (300, len(dims)))])
    t = np.vstack([r.uniform(-120, 120, (20, len(dims))), [[900.0] * len(dims)]])
    obs = frame(spark, np.column_stack([np.arange(len(x)), x]), ["obs_id", *dims]).withColumn("obs_id", F.col("obs_id").cast("long"))
    got = {}
    for row in neighbours.knn(points(spark, t, dims), obs, 5, list(dims)).collect():
        got.setdefault(row.block_id, []).append((row["rank"], row.obs_id))
    for i, p in enumerate(t):
        want = np.lexsort((np.arange(len(x)), ((x - p) ** 2).sum(1)))[:5]
        assert [o for _, o in sorted(got[i + 1])] == want.tolist()


def test_sectors_keep_each_quadrant(spark):
    places = [(1, 1.0, 0.5), (2, 2.0, 0.6), (3, -1.0, 0.5), (4, -1.0, -0.5), (5, 1.0, -0.5)]
    obs = frame(spark, places, ["obs_id", "x", "y"])
    t = points(spark, np.zeros((1, 2)))
    assert sorted(r.obs_id for r in neighbours.sector_knn(t, obs, 1, ["x", "y"]).collect()) == [1, 3, 4, 5]
    near = neighbours.neighbours(t, obs, ["x", "y"], Search(1, 1.0, sectors=True))
    assert near.count() == 0


def test_normal_scores_round_trip(spark):
    assert np.allclose(cdf(inverse(np.array([0.01, 0.5, 0.99]))), [0.01, 0.5, 0.99])
    values = frame(spark, [(float(v),) for v in (5, 1, 3, 3, 9, 2)], ["value"])
    table = score_table(values)
    assert np.allclose([r.p for r in table.orderBy("z").collect()], [1 / 12, 3 / 12, 6 / 12, 9 / 12, 11 / 12])
    got = scores(values, table)
    again = normal.back(got.withColumnRenamed("value", "was"), table, TAILS).collect()
    assert len(again) == 6 and np.allclose([r.value for r in again], [r.was for r in again])
    q = np.array([1 / 24, 0.95])
    asked = frame(spark, [(float(v),) for v in inverse(q)], ["score"]).unionByName(spark.createDataFrame([(None,)], "score double"))
    beyond = sorted(r.value for r in normal.back(asked, table, TAILS).where("value is not null").collect())
    assert np.allclose(beyond, [0.25, min(20.0, ((1 / 12) * 9**1.5 / 0.05) ** (1 / 1.5))])
    assert normal.back(asked, table, TAILS).where("value is null").count() == 1 and normal.back(asked, table.limit(0)).where("value is not null").count() == 0
    between = normal.forward(frame(spark, [(4.0,), (0.0,), (99.0,)], ["value"]), table).orderBy("value").collect()
    assert np.allclose([r.score for r in between], inverse(np.array([1 / 12, 0.625, 11 / 12])))


def test_normal_columns_equal_the_library(spark):
    y = np.linspace(-9, 9, 400)
    rows = frame(spark, [(float(v), 0.5 * math.erfc(-v / math.sqrt(2))) for v in y], ["y", "p"])
    got = rows.select("y", "p", normal.normal_cdf("y").alias("cdf"), normal.normal_inverse("p").alias("inv")).collect()
    assert np.allclose([r.cdf for r in got], [r.p for r in got], rtol=1e-7, atol=1e-16)
    exact = NormalDist()
    assert np.allclose([r.inv for r in got], [exact.inv_cdf(min(max(r.p, normal.EDGE), 1 - normal.EDGE)) for r in got], rtol=1e-13)


def test_brackets_are_found_over_all_ranges(spark):
    """Knots and queries in many ranges, one value asked for by a third of the rows, nulls and values beyond the ends."""
    r = np.random.default_rng(8)
    knots = np.unique(np.round(r.normal(0, 10, 3_000), 2))
    asked = np.concatenate([r.normal(0, 12, 4_000), np.full(2_000, 1.25), knots[:50], [-99.0, 99.0]])
    k = spark.createDataFrame(pd.DataFrame({"z": knots, "p": np.arange(len(knots)) / len(knots)}))
    q = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(asked)), "v": asked})).unionByName(spark.createDataFrame([(-1, None)], "i long, v double"))
    got = {x.i: x for x in brackets.bracketed(q, k, "v", "z", ["p"]).collect()}
    assert len(got) == len(asked) + 1 and got[-1].low is None and got[-1].high is None
    at = np.searchsorted(knots, asked, "right")
    for i, a in enumerate(at.tolist()):
        low, high = got[i].low, got[i].high
        assert (low.key if low else None) == (knots[a - 1] if a else None) and (high.key if high else None) == (knots[a] if a < len(knots) else None)


def test_simulation_repeats_and_replays(spark):
    x, z, obs = scattered(spark, 12)
    t = targets.regular_grid(spark, [5.0, 5.0], [10.0, 10.0], [8, 8])
    k = Kriging(V, search=Search(8), unbiased=False, means=(float(z.mean()),))
    one = simulation.simulate(obs, t, k, 20, 7).toPandas().sort_values(["sim_id", "block_id"])
    two = simulation.simulate(obs, t.repartition(5), k, 20, 7).toPandas().sort_values(["sim_id", "block_id"])
    assert np.allclose(one.value, two.value) and len(one) == 64 * 20
    path = simulation.random_path(t, 7)
    again = simulation.simulate(obs, t, k, 20, 7, path=path, weights=simulation.simulation_weights(obs, t, k, path)).toPandas().sort_values(["sim_id", "block_id"])
    assert np.allclose(one.value, again.value)
    kriged = kriging.estimate(obs, t, k).toPandas().set_index("block_id").estimate
    mean = one.groupby("block_id").value.mean()
    assert np.corrcoef(mean, kriged[mean.index])[0, 1] > 0.8
    on_data = frame(spark, np.column_stack([np.arange(1, 4), x[:3]]), ["block_id", "x", "y"]).withColumn("block_id", F.col("block_id").cast("long"))
    assert np.allclose(simulation.simulate(obs, on_data, k, 1, 3).orderBy("block_id").toPandas().value, z[:3])
    with pytest.raises(ValueError):
        simulation.simulate(obs, t, k, 1, path=t.select("block_id", F.lit(1).alias("pos")))


def test_joint_simulation_has_the_model_covariance(spark):
    vgm = {(1, 1): Variogram((Structure("nug", 0.0, 1.0, 4.0),)), (2, 2): Variogram((Structure("nug", 0.0, 1.0, 1.0),)), (1, 2): Variogram((Structure("nug", 0.0, 1.0, 1.6),))}
    obs = frame(spark, [(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0)], ["obs_id", "var_id", "x", "y", "value"])
    k = Kriging(vgm, nvar=2, unbiased=False, search=Search(4), means=(0.0, 0.0))
    t = targets.regular_grid(spark, [1.0, 1.0], [1.0, 1.0], [20, 20])
    out = simulation.simulate(obs, t, k, 4, 3).toPandas().pivot(index=["block_id", "sim_id"], columns="var_id", values="value")
    assert np.allclose(np.cov(out.to_numpy().T), [[4, 1.6], [1.6, 1]], atol=0.5)


def test_indicators(spark):
    r = np.random.default_rng(5)
    rows = [(k, *r.uniform(0, 100, 2).tolist(), "ab"[k % 2] if k else None) for k in range(30)]
    obs = frame(spark, rows, ["obs_id", "x", "y", "category"])
    assert indicator.labels_of(obs) == ["a", "b"]
    models = indicator.indicator_models(Structure("sph", 0.25, 30.0), 2, "proportional", [0.5, 0.5])
    assert models[1, 2].at_zero() == 0.25
    k = Kriging({**models, (1, 2): Variogram((Structure("sph", 0.0, 30.0),))}, nvar=2, search=Search(8), standard=True)
    t = targets.regular_grid(spark, [5.0, 5.0], [20.0, 20.0], [4, 4])
    p = indicator.indicator_kriging(obs, t, k).groupBy("block_id").agg(F.sum("estimate").alias("s"), F.min("estimate").alias("lo")).collect()
    assert len(p) == 16 and all(abs(q.s - 1) < 1e-12 and q.lo >= 0 for q in p)
    assert indicator.most_likely(indicator.indicator_kriging(obs, t, k), 2).count() == 16
    drawn = simulation.indicator_simulation(obs, t, k, ["a", "b"], 3, 9)
    assert drawn.count() == 48 and {r.category for r in drawn.select("category").distinct().collect()} == {"a", "b"}
    assert simulation.one_hot(np.array([[0.2, 0.8], [-1.0, 0.0]]), np.array([0.2, 0.9])).tolist() == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        indicator.indicator_models(Structure("sph", 1.0), 2, "proportional")


def test_score_simulation_stays_in_range(spark):
    _, z, obs = scattered(spark, 30)
    t = targets.regular_grid(spark, [5.0, 5.0], [25.0, 25.0], [4, 4])
    got = simulation.score_simulation(obs, t, Kriging(V, search=Search(6)), Tails(z.min() - 1, z.max() + 1), 3, 2).toPandas().value
    assert len(got) == 48 and got.min() >= z.min() - 1 and got.max() <= z.max() + 1


def test_simulation_in_time_and_by_sectors(spark):
    _, z, obs = scattered(spark, 15, 4, ("x", "y", "t"))
    st = SpaceTimeVariogram(V, Variogram((Structure("exp", 1.0, 30.0, 0.1),)), "product_sum", k=0.2)
    t = targets.regular_grid(spark, [5.0, 5.0, 5.0], [30.0, 30.0, 40.0], [3, 3, 2], ["x", "y", "t"])
    k = spacetime(st, nmax=6, time_at=1.0, unbiased=False, means=(float(z.mean()),))
    got = simulation.simulate(obs, t, k, 2, 5).toPandas()
    assert len(got) == 36 and np.isfinite(got.value).all()
    by_sector = Kriging(V, ("x", "y"), Search(2, sectors=True), unbiased=False, means=(0.0,))
    flat = targets.regular_grid(spark, [5.0, 5.0], [30.0, 30.0], [3, 3])
    assert np.isfinite(simulation.simulate(obs.drop("t"), flat, by_sector, 1, 5).toPandas().value).all()


def test_block_means_and_time_nodes(spark):
    x, z, obs = scattered(spark, 12)
    centre = points(spark, np.array([[50.0, 50.0]]))
    nodes = targets.quadrature_nodes(centre, [10.0, 10.0], ["x", "y"])
    got = kriging.block_kriging(obs, nodes, V, 12).first()
    each = kriging.ordinary_kriging(obs, nodes.select(F.col("node_id").cast("long").alias("block_id"), "x", "y"), V, 12).join(nodes.select(F.col("node_id").alias("block_id"), "weight"), "block_id")
    assert np.isclose(got.estimate, each.agg(F.sum(F.col("estimate") * F.col("weight")) / F.sum("weight")).first()[0], atol=1e-6)
    alike = targets.weighted_nodes(nodes.drop("weight")).agg(F.sum("weight"), F.min("weight")).first()
    assert np.allclose(list(alike), [1.0, 1 / 16])


def _as_in_path(x, z, x0, v, mean, eps, k):
    """Simple kriging along the rows of x0, one after another, from data and earlier rows."""
    out = []
    for i, p in enumerate(x0):
        places = np.vstack([x, x0[:i]])
        values = np.append(z, out)
        d2 = ((places - p) ** 2).sum(1)
        near = np.lexsort((np.arange(len(d2)), d2))[:k]
        c = v.covariance(places[near][:, None] - places[near][None])
        b = v.covariance(places[near] - p)
        w = np.linalg.solve(c, b)
        out.append(mean + w @ (values[near] - mean) + math.sqrt(max(v.at_zero() - w @ b, 0)) * eps[i])
    return np.array(out)


@pytest.mark.parametrize("stretch", [1, 7, 2048])
def test_simulation_by_levels_equals_the_path(spark, stretch):
    """Steps that are levels, stretches, or one stretch give what a pass along the path gives."""
    x, z, obs = scattered(spark, 10)
    r = np.random.default_rng(3)
    x0, eps = r.uniform(0, 100, (40, 2)), r.normal(size=40)
    t = points(spark, x0)
    draws = spark.createDataFrame([(i + 1, [float(e), float(-e)]) for i, e in enumerate(eps)], "block_id long, eps array<double>")
    k = Kriging(V, search=Search(5), unbiased=False, means=(1.5,))
    got = simulation.simulate(obs, t, k, 2, path=t.select("block_id", F.col("block_id").alias("pos")), samples=draws, stretch=stretch).toPandas()
    for s, e in ((1, eps), (2, -eps)):
        mine = got[got.sim_id == s].sort_values("block_id").value.to_numpy()
        assert np.allclose(mine, _as_in_path(x, z, x0, V, 1.5, e, 5))


def test_steps_are_levels_or_stretches(spark):
    blocks = spark.createDataFrame([(i, i) for i in range(1, 13)], "block_id long, pos long")
    chain = spark.createDataFrame([(i, i - 1) for i in range(2, 13)], "block_id long, src_id long")
    got, narrow = levels.steps(blocks, chain, 5)
    assert narrow == [True] * 3 and sorted((r.step, r.block_id) for r in got.collect()) == [((i - 1) // 5, i) for i in range(1, 13)]
    star = spark.createDataFrame([(i, 1 + i % 3) for i in range(4, 13)], "block_id long, src_id long")
    got, narrow = levels.steps(blocks, star, 3)
    assert narrow == [False, False] and {r.block_id: r.step for r in got.collect()} == {i: int(i > 3) for i in range(1, 13)}
    assert levels.steps(blocks.limit(0), star)[1] == []


def test_draws_can_be_made_again(spark):
    t = targets.regular_grid(spark, [5.0, 5.0], [500.0, 500.0], [5, 4])
    obs = frame(spark, [(1, -1e6, 0.0, 0.0)], ["obs_id", "x", "y", "value"])
    far = Kriging(Variogram((Structure("nug", 0.0, 1.0, 1.0),)), search=Search(2), unbiased=False, means=(0.0,))
    got = simulation.simulate(obs, t, far, 20, 11).toPandas().sort_values(["block_id", "sim_id"])
    want = simulation.draws(t, 20, 1, 11).toPandas().sort_values(["block_id", "sim_id"])
    assert np.allclose(got.value, want.eps) and abs(want.eps.mean()) < 0.2 and abs(want.eps.std() - 1) < 0.15
    u = simulation.draws(t, 20, 3, 11, categories=True)
    assert u.count() == 400 and u.where("eps <= 0 or eps >= 1").isEmpty()


@pytest.mark.parametrize("small", [0, 2048])
def test_neighbours_of_clusters_and_far_targets(spark, monkeypatch, small):
    """Half of the sources at one spot and in one cell, targets far outside, few sources before a target in the path."""
    monkeypatch.setattr(neighbours, "SMALL", small)
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "STRETCH", 100)
    r = np.random.default_rng(5)
    x = np.vstack([np.full((300, 2), 3.0), r.normal(0, 1e-3, (300, 2)), r.uniform(-100, 100, (500, 2))])
    t = np.vstack([r.normal(0, 1e-3, (40, 2)), r.uniform(-100, 100, (40, 2)), [[1e6, 1e6], [-1e5, 0.0], [3.0, 3.0]]])
    obs = frame(spark, np.column_stack([np.arange(len(x)), x, r.permutation(len(x))]), ["obs_id", "x", "y", "pos"]).withColumn("obs_id", F.col("obs_id").cast("long"))
    at = r.integers(0, len(x), len(t))
    want_pos = obs.toPandas().pos.to_numpy()
    asked = points(spark, t).join(spark.createDataFrame([(i + 1, int(p)) for i, p in enumerate(at)], "block_id long, pos long"), "block_id")
    for order in (None, "pos"):
        got = {}
        for row in neighbours.neighbours(asked, obs, ["x", "y"], Search(6), order=order, carry=("x",)).collect():
            got.setdefault(row.block_id, []).append((row["rank"], row.obs_id, row.x))
        for i, p in enumerate(t):
            d2 = (p[0] - x[:, 0]) ** 2 + (p[1] - x[:, 1]) ** 2
            able = np.flatnonzero(want_pos < at[i]) if order else np.arange(len(x))
            want = able[np.lexsort((able, d2[able]))[:6]]
            assert [o for _, o, _ in sorted(got.get(i + 1, []))] == want.tolist()
            assert all(c == x[o, 0] for _, o, c in got.get(i + 1, []))


def test_ranges_against_loops(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 50)
    r = np.random.default_rng(6)
    x = np.round(np.vstack([r.normal(0, 2, (600, 2)), r.uniform(-50, 50, (600, 2))]), 1)
    t = np.round(r.uniform(-60, 60, (30, 2)), 1)
    obs = frame(spark, np.column_stack([np.arange(len(x)), x]), ["obs_id", "x", "y"]).withColumn("obs_id", F.col("obs_id").cast("long"))
    asked = points(spark, t).withColumn("r", F.when(F.col("block_id") == 3, F.lit(None)).otherwise((F.col("block_id") % 7) * 10.0))
    found = {}
    for row in ranges.within(asked, obs, ["x", "y"], "r").collect():
        found.setdefault(row.block_id, set()).add(row.obs_id)
    counted = {row.block_id: row.n for row in ranges.count_within(asked, obs, ["x", "y"], "r").collect()}
    for i, p in enumerate(t):
        want = set(np.flatnonzero((p[0] - x[:, 0]) ** 2 + (p[1] - x[:, 1]) ** 2 <= ((i + 1) % 7 * 10.0) ** 2).tolist()) if i != 2 else set()
        assert found.get(i + 1, set()) == want and counted.get(i + 1) == (len(want) if i != 2 else None)
    assert ranges.within(asked, obs.limit(0), ["x", "y"], 5.0).count() == 0 and ranges.count_within(asked, obs.limit(0), ["x", "y"], 5.0).agg(F.max("n")).first()[0] == 0


def test_factors_multiply_back(spark):
    x, z, obs = scattered(spark, 12)
    k = Kriging(V, search=Search(5), ndrift=1)
    obs, t = obs.withColumn("drift", F.array("x")), points(spark, np.vstack([x[:4] + 0.5, x[:4] + 0.5])).withColumn("drift", F.array("x"))
    rows = kriging.assembled(kriging.points_of(obs, k), t, k)
    got = systems.factors(rows, k.model()).collect()
    assert len(got) == 4
    for f in got:
        lower = np.array(f.lower).reshape(5, 5)
        at = x[np.array(f.data) - 1]
        c, drift = V.covariance(at[:, None] - at[None]), np.column_stack([at[:, 0], np.ones(5)])
        assert np.allclose(lower @ lower.T, c) and np.allclose(np.array(f.solved_constraints).reshape(5, 2), np.linalg.solve(c, drift))
        assert np.allclose(np.array(f.schur).reshape(2, 2), drift.T @ np.linalg.solve(c, drift))
    table = kriging.solve(obs, t, k)
    assert [(r.n, r.factors) for r in systems.counters(table).collect()] == [(8, 4)]


def test_one_bad_system_is_solved_alone():
    good, bad = np.eye(3) * 2, np.ones((3, 3))
    a = np.stack([good, good, bad, good * 3])
    x, status = systems.solve_stack(a, np.array([0, 1, 2, 3, 3]), np.ones((5, 3, 1)), 3)
    assert status.tolist()[:2] == ["ok", "ok"] and status[2] != "fail" and np.allclose(x[3], 1 / 6) and np.allclose(x[0], 0.5)


def test_spacetime_columns_equal_arrays(spark):
    r = np.random.default_rng(2)
    lags = np.vstack([r.uniform(-40, 40, (50, 3)), np.zeros((1, 3)), [[0.0, 0.0, 3.0]], [[5.0, 0.0, 0.0]]])
    space = Variogram((Structure("sph", 2.0, 40.0, 0.5, 20.0, azimuth=30.0), Structure("exp", 1.0, 60.0)))
    for st in (SpaceTimeVariogram(space, Variogram((Structure("exp", 1.0, 10.0, 0.25),)), "sum_metric", (0.75, 0.5), TimeTransform("sph", 0.1, 2.0, 40.0)), SpaceTimeVariogram(space, V, "product_sum", k=0.5)):
        got = frame(spark, lags, ["a", "b", "t"]).select(st.covariance_column([F.col("a"), F.col("b"), F.col("t")]).alias("c")).collect()
        assert np.allclose([x.c for x in got], st.covariance(lags))


def test_gradients_in_time_against_dense(spark):
    """Pairs in place and time, with the shared block factored once, against the whole system."""
    x, z, obs = scattered(spark, 9, 6, ("x", "y", "t"))
    st = SpaceTimeVariogram(V, Variogram((Structure("exp", 1.0, 30.0, 0.1),)), "product_sum", k=0.2)
    ends = np.array([[10.0, 10.0, 5.0, 20.0, 10.0, 15.0], [50.0, 40.0, 0.0, 50.0, 40.0, 30.0]])
    pairs = frame(spark, [(1, i, *e, 0.5 - i, 0.2) for i, e in enumerate(ends.tolist())], ["var_id", "grad_id", "x1", "y1", "t1", "x2", "y2", "t2", "value", "variance"])
    x0 = np.array([[30.0, 30.0, 10.0], [60.0, 20.0, 40.0]])
    k = spacetime(st, nmax=9, time_at=1.0, gradients=pairs)
    got = kriging.estimate(obs, points(spark, x0, ("x", "y", "t")), k).orderBy("block_id").collect()
    p, q = ends[:, :3], ends[:, 3:]
    c = lambda a, b: st.covariance(a[:, None] - b[None])
    kk = c(x, x)
    cross = c(x, p) - c(x, q)
    own = c(p, p) - c(p, q) - c(q, p) + c(q, q) + np.diag([0.2, 0.2])
    f = np.append(np.ones(9), np.zeros(2))[:, None]
    a = np.block([[np.block([[kk, cross], [cross.T, own]]), f], [f.T, np.zeros((1, 1))]])
    for r, at in zip(got, x0):
        b = np.concatenate([st.covariance(x - at), st.covariance(p - at) - st.covariance(q - at), [1.0]])
        s = np.linalg.solve(a, b)
        assert np.isclose(r.estimate, s[:11] @ np.append(z, [0.5, -0.5])) and np.isclose(r.variance, st.at_zero() - s @ b)


def test_replayed_joint_simulation_and_wide_form(spark):
    vgm = {(1, 1): V, (2, 2): V, (1, 2): Variogram((Structure("sph", 1.5, 40.0, 0.1),))}
    x, z, obs = scattered(spark, 10)
    both = obs.withColumn("var_id", F.lit(1)).unionByName(obs.where("obs_id % 2 = 0").withColumn("var_id", F.lit(2)))
    t = targets.regular_grid(spark, [5.0, 5.0], [25.0, 25.0], [4, 4])
    k = Kriging(vgm, nvar=2, unbiased=False, search=Search(4), means=(0.0, 0.0))
    path = simulation.random_path(t, 4)
    one = simulation.simulate(both, t, k, 18, 4, path=path).toPandas().sort_values(["block_id", "var_id", "sim_id"])
    again = simulation.simulate(both, t, k, 18, 4, path=path, weights=simulation.simulation_weights(both, t, k, path), stretch=3)
    two = again.toPandas().sort_values(["block_id", "var_id", "sim_id"])
    assert len(one) == 16 * 2 * 18 and np.allclose(one.value, two.value)
    flat = simulation.wide(again, t, k, 18)
    assert flat.count() == 16 and flat.columns[3:5] == ["v1_s1", "v1_s2"] and flat.columns[-1] == "v2_s18"
