"""Queries of the engine's own operators over the given tables, and their SQL.

Places come from keys, so that the same observations can be written in SQL. Estimates are compared where kriging has a closed
form: one or two neighbours, a pure nugget, an exact drift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.spacetime import SpaceTimeVariogram, TimeTransform
from ..functions.variogram import MODELS, Structure, Variogram, rho
from ..operators import indicator, kriging, neighbours, simulation, spacetime, targets
from ..operators.kriging import Kriging
from ..operators.neighbours import Search

FIELD = Variogram((Structure("sph", 4.0, 30.0, 0.5),))
PURE = Variogram((Structure("nug", 0.0, 1.0, 2.0),))
NESTED = Variogram((Structure("sph", 2.0, 40.0, 0.25, 20.0, azimuth=30.0),)).add("exp", 1.5, 60.0).times("gau", 0.5, 80.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: Column, a: int, b: int, shift: float = 0.0) -> Column:
    return (F.pmod(key * a, F.lit(b)) + F.lit(shift)).cast("double")


def supplier_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as observations: a place from the key, the balance as value."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("obs_id"), _place(k, 37, 1009).alias("x"), _place(k, 61, 997).alias("y"), _place(k, 13, 53).alias("t"), F.col("s_acctbal").cast("double").alias("value"))


def nation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("block_id"), _place(k, 17, 101, 0.25).alias("x"), _place(k, 29, 97, 0.5).alias("y"), _place(k, 7, 53, 0.125).alias("t"))


def part_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.cast("long").alias("obs_id"), _place(k, 4099, 10007).alias("x"), _place(k, 6151, 9973).alias("y"), F.col("p_retailprice").cast("double").alias("value"), (F.col("p_size") % 3 + 1).cast("int").alias("category"))


def customer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("block_id"), _place(k, 3571, 10007, 0.3).alias("x"), _place(k, 7919, 9973, 0.7).alias("y"))


def line_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(k.cast("long").alias("obs_id"), _place(k, 37, 100003).alias("x"), _place(k, 61, 99991).alias("y"))


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("block_id"), _place(k, 4099, 100003, 0.25).alias("x"), _place(k, 8209, 99991, 0.5).alias("y"))


def _rounded(out: DataFrame, digits: int = 6) -> DataFrame:
    return out.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def _single(out: DataFrame) -> DataFrame:
    return _rounded(out.select("block_id", "estimate", "variance"))


# ---- functions


def variogram_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("p_size") / 20.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.round(rho(m, h), 9).alias(m) for m in MODELS))


def nested_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turned spherical structure, plus an exponential one times a Gaussian one."""
    lag = [(F.col("p_size") - 25).cast("double"), (F.pmod(F.col("p_partkey"), F.lit(41)) - 20).cast("double")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(NESTED.covariance_column(lag), 9).alias("c"))


def spacetime_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-metric and product-sum covariances of space-time lags, as columns."""
    cs, ct = Variogram((Structure("sph", 2.0, 30.0, 0.5),)), Variogram((Structure("exp", 1.0, 10.0, 0.25),))
    metric = SpaceTimeVariogram(cs, ct, "sum_metric", (0.75,), TimeTransform("lin", 0.0, 1.0, 40.0))
    product = SpaceTimeVariogram(cs, ct, "product_sum", k=0.5)
    lag = [(F.col("p_size") - 1).cast("double"), F.lit(0.0), F.pmod(F.col("p_partkey"), F.lit(23)).cast("double")]
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), metric.covariance_column(lag).alias("metric"), product.covariance_column(lag).alias("product"))
    return _rounded(part, 9)


def score_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoint cumulative probability of each distinct part size."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("value"))
    return normal.score_table(sizes).select(F.col("z").cast("long").alias("z"), F.round("p", 12).alias("p"))


def weighted_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with declustering weights, over all order lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("value"), F.col("l_linenumber").cast("double").alias("w"))
    return normal.score_table(lines, "value", "w").select("z", F.round("p", 12).alias("p"))


# ---- neighbours


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn(nation_targets(spark, sf_dir), supplier_obs(spark, sf_dir), 8, ["x", "y"], 400.0)


def knn_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all order lines, without a radius."""
    return neighbours.knn(order_targets(spark, sf_dir), line_obs(spark, sf_dir), 8, ["x", "y"])


def knn_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest in a space turned by 90 degrees, where the second axis is three times as long."""
    found = neighbours.neighbours(customer_targets(spark, sf_dir), part_obs(spark, sf_dir), ["x", "y"], Search(4, ratio1=0.5, azimuth=90.0))
    return found.select("block_id", "obs_id", F.round("d2", 3).alias("d2"), "rank")


def sector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.sector_knn(nation_targets(spark, sf_dir), supplier_obs(spark, sf_dir), 1, ["x", "y"])


def sector_maxdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each quadrant within a radius, among more observations than one broadcast holds."""
    return neighbours.sector_knn(customer_targets(spark, sf_dir), part_obs(spark, sf_dir), 2, ["x", "y"], Search(2, 1500.0, sectors=True))


def knn_spacetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest in place and time, a unit of time as far as four of space."""
    return neighbours.neighbours(nation_targets(spark, sf_dir), supplier_obs(spark, sf_dir), ["x", "y", "t"], Search(6, time_at=4.0))


def knn_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest parts among those with a lower key: neighbours of a simulation along the path of keys."""
    p = part_obs(spark, sf_dir)
    placed = p.select(F.col("obs_id").alias("block_id"), "x", "y", F.col("obs_id").alias("pos"))
    return neighbours.neighbours(placed, p.withColumn("pos", F.col("obs_id")), ["x", "y"], Search(3), order="pos")


# ---- estimation


def ordinary_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbours, for which the weights have a closed form."""
    return _single(kriging.ordinary_kriging(supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), Variogram((Structure("exp", 4.0, 900.0, 0.5),)), 2))


def ordinary_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(kriging.ordinary_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), Variogram((Structure("exp", 4.0, 900.0, 0.5),)), 1))


def simple_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single(kriging.simple_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), Variogram((Structure("exp", 4.0, 900.0, 0.5),)), 1000.0, 1))


def pure_nugget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the eight nearest."""
    return _single(kriging.ordinary_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), PURE, 8))


def measurement_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = part_obs(spark, sf_dir).withColumn("err_var", (F.col("obs_id") % 5 * 0.37).cast("double"))
    return _rounded(kriging.ordinary_kriging(obs, customer_targets(spark, sf_dir), PURE, 8))


def local_nugget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = customer_targets(spark, sf_dir).withColumn("localnugget", (F.col("block_id") % 4).cast("double"))
    return _single(kriging.ordinary_kriging(part_obs(spark, sf_dir), t, PURE, 8))


def range_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neighbour, with lags divided by a scale of the target's own."""
    t = customer_targets(spark, sf_dir).withColumn("rangescale", (F.col("block_id") % 3 + 1).cast("double"))
    return _single(kriging.ordinary_kriging(part_obs(spark, sf_dir), t, Variogram((Structure("exp", 4.0, 900.0, 0.5),)), 1))


def bounded_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = Kriging(PURE, search=Search(8), bounds=(1200.0, 1400.0))
    obs, t = part_obs(spark, sf_dir), customer_targets(spark, sf_dir)
    return _single(kriging.estimate(obs, t, k))


def grid_kriging(spark: SparkSession, sf_dir: str, side: int = 40, nmax: int = 16, vgm: Variogram = PURE) -> DataFrame:
    """A grid of ``side`` squared blocks from all order lines, a place each: estimate and variance, summed up."""
    obs = line_obs(spark, sf_dir).distinct().withColumn("value", F.pmod("obs_id", F.lit(1000)).cast("double"))
    blocks = targets.regular_grid(spark, [0.5, 0.5], [100000.0 / side] * 2, [side, side])
    out = kriging.ordinary_kriging(obs, blocks, vgm, nmax)
    return _rounded(out.agg(F.count("estimate").alias("n"), F.sum("estimate").alias("total"), F.avg("variance").alias("variance")), 4)


def leave_one_out_nugget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pure nugget: the mean of the five nearest others."""
    return _single(kriging.leave_one_out(part_obs(spark, sf_dir), PURE, 5))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of that leave-one-out."""
    obs = part_obs(spark, sf_dir)
    return _rounded(kriging.diagnostics(kriging.leave_one_out(obs, PURE, 5), obs))


def weight_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights solved once and applied to other values of the same observations."""
    obs, t, k = part_obs(spark, sf_dir), customer_targets(spark, sf_dir), Kriging(PURE, search=Search(8))
    return _single(kriging.apply(kriging.solve(obs, t, k), obs.withColumn("value", F.col("value") * 2 + 1), k, t))


def universal_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on a plane, with the coordinates as drift: the plane itself."""
    plane = 3 + F.col("x") * 0.01 - F.col("y") * 0.02
    drift = F.array(F.col("x") / 10007, F.col("y") / 9973)
    obs = part_obs(spark, sf_dir).withColumn("value", plane).withColumn("drift", drift)
    out = kriging.universal_kriging(obs, customer_targets(spark, sf_dir).withColumn("drift", drift), Variogram((Structure("sph", 4.0, 3000.0),)), 2, 12)
    return out.select("block_id", F.round("estimate", 4).alias("estimate"))


def block_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen nodes of a block around each target."""
    return _rounded(targets.quadrature_nodes(nation_targets(spark, sf_dir), [10.0, 20.0], ["x", "y"]), 6)


def block_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted centres of the orders of each customer, as user nodes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("block_id"), F.col("o_orderkey").alias("node_id"), _place(F.col("o_orderkey"), 37, 1009).alias("x"), _place(F.col("o_orderkey"), 61, 997).alias("y"))
    return _rounded(targets.centroids(o, ["x", "y"]))


def block_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of blocks of two nodes, from one neighbour."""
    t = customer_targets(spark, sf_dir)
    nodes = t.select("block_id", F.explode(F.array(F.lit(-6.0), F.lit(6.0))).alias("o"), "x", "y").select("block_id", (F.col("x") + F.col("o")).alias("x"), "y", F.lit(0.5).alias("weight"))
    return _single(kriging.block_kriging(part_obs(spark, sf_dir), nodes, Variogram((Structure("exp", 4.0, 900.0),)), 1))


def _two_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_obs(spark, sf_dir)
    second = p.where("obs_id % 3 = 0").select(F.col("obs_id"), "x", "y", (F.col("category") * 10.0).alias("value"), F.lit(2).alias("var_id"))
    return p.select("obs_id", "x", "y", "value", F.lit(1).alias("var_id")).unionByName(second)


APART = {(1, 1): PURE, (2, 2): Variogram((Structure("nug", 0.0, 1.0, 1.0),)), (1, 2): Variogram((Structure("nug", 0.0, 1.0, 0.0),))}


def cokriging_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables without a cross covariance: each is estimated from its own four nearest."""
    return _rounded(kriging.cokriging(_two_variables(spark, sf_dir), customer_targets(spark, sf_dir), APART, 2, 4, standard=True))


def cokriging_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one sum of weights for both, and shifts by the difference of local means."""
    return _rounded(kriging.cokriging(_two_variables(spark, sf_dir), customer_targets(spark, sf_dir), APART, 2, 4))


def indicator_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each category among the eight nearest."""
    models = indicator.indicator_models(Structure("nug", 0.0, 1.0, 1.0), 3, "independent")
    models = {p: (v if p[0] == p[1] else Variogram((Structure("nug", 0.0, 1.0, 0.0),))) for p, v in models.items()}
    k = Kriging({**models, **{(i, i): Variogram((Structure("nug", 0.0, 1.0, 1.0),)) for i in (1, 2, 3)}}, search=Search(8), nvar=3, standard=True)
    out = indicator.indicator_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), k, [1, 2, 3])
    return _rounded(out.select("block_id", "var_id", "estimate"))


def spacetime_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neighbour in place and time, product-sum covariance."""
    cs, ct = Variogram((Structure("exp", 2.0, 300.0, 0.5),)), Variogram((Structure("exp", 1.0, 20.0, 0.25),))
    out = spacetime.spacetime_kriging(supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), SpaceTimeVariogram(cs, ct, "product_sum", k=0.5), nmax=1, time_at=4.0)
    return _single(out)


# ---- simulation


def simulation_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple kriging of a pure nugget: the mean and each draw times the standard deviation, along a given path."""
    t = customer_targets(spark, sf_dir)
    k = Kriging(PURE, search=Search(4), unbiased=False, means=(10.0,))
    eps = t.select("block_id", F.array(*((F.pmod(F.col("block_id") * m, F.lit(11)) - 5).cast("double") for m in (1, 3))).alias("eps"))
    path = t.select("block_id", (F.col("block_id") + 1).alias("pos"))
    return _rounded(simulation.simulate(part_obs(spark, sf_dir).withColumn("value", F.lit(10.0)), t, k, 2, path=path, samples=eps))


def simulation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neighbour and draws of 0: each block takes the value of the nearest datum or earlier block."""
    t = nation_targets(spark, sf_dir)
    obs = supplier_obs(spark, sf_dir)
    path = t.select("block_id", (F.col("block_id") + 1).alias("pos"))
    eps = t.select("block_id", F.array(F.lit(0.0)).alias("eps"))
    out = simulation.simulate(obs, t, Kriging(Variogram((Structure("exp", 4.0, 900.0),)), search=Search(1)), 1, path=path, samples=eps)
    return _rounded(out)


def path_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random path is a permutation: its positions, counted."""
    t = customer_targets(spark, sf_dir)
    return simulation.random_path(t, 7).groupBy("pos").agg(F.count("*").alias("n"))


def realisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and percentiles over five values of each customer."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("long").alias("block_id"), F.lit(1).alias("var_id"), F.explode(F.array(*((F.col("c_acctbal").cast("double") * m) for m in (1, 2, 3, 5, 8)))).alias("value"))
    return _rounded(simulation.summaries(rows))


# ---- tables


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = indicator.proportions(table(spark, sf_dir, "events"), "event_type")
    return shares.select(F.col("label").alias("event_type"), "proportion")


def duplicate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y"))
    return targets.duplicate_places(p, ["x", "y"])


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.regular_grid(spark, [0.5, 10.0], [2.0, 2.5], [40, 30])


OBS = "select s_suppkey::bigint obs_id, ((s_suppkey * 37) % 1009)::double x, ((s_suppkey * 61) % 997)::double y, ((s_suppkey * 13) % 53)::double t, s_acctbal::double v from supplier"
TARGETS = "select n_nationkey::bigint block_id, ((n_nationkey * 17) % 101 + 0.25)::double tx, ((n_nationkey * 29) % 97 + 0.5)::double ty, ((n_nationkey * 7) % 53 + 0.125)::double tt from nation"
PARTS = "select p_partkey::bigint obs_id, ((p_partkey * 4099) % 10007)::double x, ((p_partkey * 6151) % 9973)::double y, p_retailprice::double v, (p_size % 3 + 1)::int cat from part"
CUSTOMERS = "select c_custkey::bigint block_id, ((c_custkey * 3571) % 10007 + 0.3)::double tx, ((c_custkey * 7919) % 9973 + 0.7)::double ty from customer"
LINES = "select (l_orderkey * 8 + l_linenumber)::bigint obs_id, (((l_orderkey * 8 + l_linenumber) * 37) % 100003)::double x, (((l_orderkey * 8 + l_linenumber) * 61) % 99991)::double y from lineitem"
FAR = "select s_suppkey::bigint block_id, ((s_suppkey * 4099) % 100003 + 0.25)::double tx, ((s_suppkey * 8209) % 99991 + 0.5)::double ty from supplier"


def _ranked(t: str, o: str, d2: str = "(tx - x) * (tx - x) + (ty - y) * (ty - y)", where: str = "true") -> str:
    return f"select *, row_number() over (partition by block_id order by d2, obs_id)::int r from (select *, {d2} d2 from ({t}) cross join ({o}) where {where})"


def _sectors(t: str, o: str, k: int, limit: float) -> str:
    cand = f"select *, (case when x < tx then 1 else 0 end + case when y < ty then 2 else 0 end)::int sector from ({_ranked(t, o)}) where r <= {16 * k} and d2 <= {limit}"
    return f"select block_id, obs_id, d2, sector, rank from (select block_id, obs_id, d2, sector, row_number() over (partition by block_id, sector order by d2, obs_id)::int rank from ({cand})) where rank <= {k}"


NEAR8 = f"select * from ({_ranked(CUSTOMERS, PARTS)}) where r <= 8"
EXP = "(4 * exp(-3 * {h} / 900))"


def _model_sql() -> str:
    near = lambda c: f"case when h < 1 then {c} else 0 end"
    forms = {
        "nug": "case when h > 0 then 0 else 1 end", "sph": near("1 - 1.5 * h + 0.5 * h * h * h"), "exp": "exp(-3 * h)", "gau": "exp(-3.0625 * h * h)", "hol": "cos(pi() * h)",
        "pow": near("1 - pow(h, 1.5)"), "bsq": near("(1 - h * h) * (1 - h * h)"), "cir": near("1 - (2 * h * sqrt(1 - h * h) + 2 * asin(h)) / pi()"), "lin": near("1 - h"),
        "cyc": "exp(-2 * sin(pi() * h) * sin(pi() * h))", "dco": "exp(-3 * h) * cos(pi() * h)",
    }
    return f"select id, {', '.join(f'round(({f})::double, 9) as {n}' for n, f in forms.items())} from (select p_partkey id, p_size / 20.0::double h from part)"


def _nested_sql() -> str:
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    first = f"sqrt((({c!r} * a - {s!r} * b) / 20) * (({c!r} * a - {s!r} * b) / 20) + (({s!r} * a + {c!r} * b) / 40) * (({s!r} * a + {c!r} * b) / 40))"
    lag = "select p_partkey id, (p_size - 25)::double a, (p_partkey % 41 - 20)::double b from part"
    h = f"select *, {first} h1, sqrt(a * a + b * b) d from ({lag})"
    return f"select id, round(case when a = 0 and b = 0 then 2.25 + 1.5 * 0.5 else (case when h1 < 1 then 2 * (1 - 1.5 * h1 + 0.5 * h1 * h1 * h1) else 0 end) + 1.5 * exp(-3 * d / 60) * 0.5 * exp(-3.0625 * (d / 80) * (d / 80)) end, 9) c from ({h})"


def _exp1(form: str, extra: str = "") -> str:
    """One neighbour: ``form`` over c0 and c, the covariance with it."""
    return f"select block_id, {form} from (select *, 4.5 c0, {EXP.format(h='sqrt(d2)')} c{extra} from ({_ranked(CUSTOMERS, PARTS)}) where r = 1)"


TWO = f"select block_id, max(case when r = 1 then v end) v1, max(case when r = 2 then v end) v2, max(case when r = 1 then {EXP.format(h='sqrt(d2)')} end) k1, max(case when r = 2 then {EXP.format(h='sqrt(d2)')} end) k2, {EXP.format(h='sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2))')} c12 from ({_ranked(TARGETS, OBS)}) where r <= 2 group by block_id"
SECOND = "select p_partkey::bigint obs_id, ((p_partkey * 4099) % 10007)::double x, ((p_partkey * 6151) % 9973)::double y, (p_size % 3 + 1) * 10.0::double v from part where p_partkey % 3 = 0"
M1 = f"select block_id, avg(v) m1 from ({_ranked(CUSTOMERS, PARTS)}) where r <= 4 group by 1"
M2 = f"select block_id, avg(v) m2 from ({_ranked(CUSTOMERS, SECOND)}) where r <= 4 group by 1"
NODE = "unnest([{'i': 1, 'o': -0.4305681558, 'w': 0.1739274226}, {'i': 2, 'o': -0.1699905218, 'w': 0.3260725774}, {'i': 3, 'o': 0.1699905218, 'w': 0.3260725774}, {'i': 4, 'o': 0.4305681558, 'w': 0.1739274226}])"
LOO5 = f"select block_id, avg(v) e from ({_ranked(PARTS.replace('obs_id', 'block_id').replace(' x,', ' tx,').replace(' y,', ' ty,').replace(' v,', ' tv,').replace(' cat', ' tcat'), PARTS, where='obs_id <> block_id')}) where r <= 5 group by block_id"

QUERIES = {f.__name__: f for f in (
    ordinary_two, leave_one_out_nugget, knn_join, sector_join, score_cdf, proportions, variogram_models, nested_covariance, spacetime_covariance, weighted_cdf, knn_large, knn_turned, sector_maxdist, knn_spacetime, knn_before,
    ordinary_one, simple_one, pure_nugget, measurement_error, local_nugget, range_scale, bounded_estimate, validation, weight_replay, universal_plane, block_nodes, block_centroids, block_kriging, cokriging_standard, cokriging_sum,
    indicator_kriging, spacetime_kriging, simulation_draws, simulation_chain, path_positions, realisation_summary, duplicate_places, grid, grid_kriging,
)}

ORACLE_SQL = {
    "ordinary_two": f"select block_id, round(w * v1 + (1 - w) * v2, 6) estimate, round(greatest(4.5 - w * k1 - (1 - w) * k2 - (k1 - 4.5 * w - c12 * (1 - w)), 0), 6) variance from (select *, 0.5 + (k1 - k2) / (2 * (4.5 - c12)) w from ({TWO}))",
    "ordinary_one": _exp1("round(v, 6) estimate, round(2 * (c0 - c), 6) variance"),
    "simple_one": _exp1("round(1000 + c / c0 * (v - 1000), 6) estimate, round(c0 - c * c / c0, 6) variance"),
    "pure_nugget": f"select block_id, round(avg(v), 6) estimate, round((2 + 2 / 8.0)::double, 6) variance from ({NEAR8}) group by 1",
    "measurement_error": f"select block_id, round(sum(v / (2 + obs_id % 5 * 0.37::double)) / sum(1 / (2.0::double + obs_id % 5 * 0.37::double)), 6) estimate, round(2 + 1 / sum(1 / (2.0::double + obs_id % 5 * 0.37::double)), 6) variance from ({NEAR8}) group by 1",
    "local_nugget": f"select block_id, round(avg(v), 6) estimate, round((2 + (2 + block_id % 4) / 8.0)::double, 6) variance from ({NEAR8}) group by 1",
    "range_scale": f"select block_id, round(v, 6) estimate, round(2 * (4.5 - 4 * exp(-3 * sqrt(d2) / (block_id % 3 + 1) / 900)), 6) variance from ({_ranked(CUSTOMERS, PARTS)}) where r = 1",
    "bounded_estimate": f"select block_id, round(greatest(1200, least(1400, avg(v))), 6) estimate, 2.25::double variance from ({NEAR8}) group by 1",
    "leave_one_out_nugget": f"select block_id, round(e, 6) estimate, 2.4::double variance from ({LOO5})",
    "validation": f"select count(*) n, round(sqrt(avg((e - v) * (e - v))), 6) rmse, round(corr(e, v), 6) r, round(avg((e - v) * (e - v) / 2.4), 6) mssr from ({LOO5}) join ({PARTS}) on block_id = obs_id",
    "weight_replay": f"select block_id, round(avg(v * 2 + 1), 6) estimate, 2.25::double variance from ({NEAR8}) group by 1",
    "universal_plane": f"select block_id, round(3 + tx * 0.01 - ty * 0.02, 4) estimate from ({CUSTOMERS})",
    "block_nodes": f"select block_id, ((a.i - 1) * 4 + b.i)::int node_id, round(tx + a.o * 10, 6) x, round(ty + b.o * 20, 6) y, round(a.w::double * b.w::double, 6) weight from ({TARGETS}), (select {NODE} a), (select {NODE} b)",
    "block_centroids": "select o_custkey::bigint block_id, round(avg((o_orderkey * 37) % 1009), 6) x, round(avg((o_orderkey * 61) % 997), 6) y from orders group by 1",
    "block_kriging": f"select block_id, round(v, 6) estimate, round(greatest(2 + 2 * exp(-3 * 12 / 900.0) - 2 * k + 4, 0), 6) variance from (select *, 2 * exp(-3 * sqrt(pow(tx - 6 - x, 2) + pow(ty - y, 2)) / 900) + 2 * exp(-3 * sqrt(pow(tx + 6 - x, 2) + pow(ty - y, 2)) / 900) k from ({_ranked(CUSTOMERS, PARTS)}) where r = 1)",
    "cokriging_standard": f"select block_id, 1::int var_id, round(m1, 6) estimate, 2.5::double variance from ({M1}) union all select block_id, 2::int, round(m2, 6), 1.25::double from ({M2})",
    # weights are as 1 / 2 to 1 / 1, four each: 1 / 12 and 1 / 6, multiplier -1 / 6
    "cokriging_sum": f"select block_id, var_id::int var_id, round(case when var_id = 1 then m1 / 3 + m2 * 2 / 3 + (m1 - m2) * 2 / 3 else m1 / 3 + m2 * 2 / 3 + (m2 - m1) / 3 end, 6) estimate, round(case when var_id = 1 then 2 + 1 / 6.0 else 1 + 1 / 6.0 end::double, 6) variance from ({M1}) join ({M2}) using (block_id), (select unnest([1, 2]) var_id)",
    "indicator_kriging": f"select block_id, c::int var_id, round(avg(case when cat = c then 1.0 else 0.0 end), 6) estimate from ({NEAR8}), (select unnest([1, 2, 3]) c) group by 1, 2",
    "spacetime_kriging": f"select block_id, round(v, 6) estimate, round(2 * (4.6875 - (0.5 * cs * ct + cs + ct)), 6) variance from (select *, case when ds = 0 then 2.5 else 2 * exp(-3 * ds / 300) end cs, case when dt = 0 then 1.25 else exp(-3 * dt / 20) end ct from (select *, sqrt(pow(tx - x, 2) + pow(ty - y, 2)) ds, abs(tt - t) dt from ({_ranked(TARGETS, OBS, '(tx - x) * (tx - x) + (ty - y) * (ty - y) + (tt * 4 - t * 4) * (tt * 4 - t * 4)')}) where r = 1))".replace("4.6875", "(0.5 * 2.5 * 1.25 + 2.5 + 1.25)"),
    "simulation_draws": "select c_custkey::bigint block_id, 1::int var_id, s::int sim_id, round(10 + sqrt(2) * ((c_custkey * case when s = 1 then 1 else 3 end) % 11 - 5), 6) as value from customer, (select unnest([1, 2]) s)",
    "simulation_chain": f"with recursive o as ({OBS}), t as ({TARGETS}), near as (select block_id, kind, src from (select *, row_number() over (partition by block_id order by d2, kind, src) r from (select t.block_id, 0 kind, o.obs_id src, (tx - x) * (tx - x) + (ty - y) * (ty - y) d2 from t, o union all select t.block_id, 1, p.block_id, (t.tx - p.tx) * (t.tx - p.tx) + (t.ty - p.ty) * (t.ty - p.ty) from t, t p where p.block_id < t.block_id)) where r = 1), chain as (select block_id, kind, src from near union all select c.block_id, n.kind, n.src from chain c join near n on c.kind = 1 and c.src = n.block_id) select block_id, 1::int var_id, 1::int sim_id, round(v, 6) as value from chain join o on kind = 0 and src = obs_id",
    "path_positions": "select row_number() over (order by c_custkey) pos, 1::bigint n from customer",
    "realisation_summary": "select c_custkey::bigint block_id, 1::int var_id, round(avg(v), 6) mean, round(stddev(v), 6) sd, round(quantile_cont(v, 0.1), 6) p10, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.9), 6) p90 from (select c_custkey, unnest([c_acctbal::double, c_acctbal::double * 2, c_acctbal::double * 3, c_acctbal::double * 5, c_acctbal::double * 8]) v from customer) group by 1",
    "knn_join": f"select block_id, obs_id, d2, r as rank from ({_ranked(TARGETS, OBS)}) where r <= 8 and d2 <= 160000",
    "knn_large": f"select block_id, obs_id, d2, r as rank from ({_ranked(FAR, LINES)}) where r <= 8",
    "knn_turned": f"select block_id, obs_id, round(d2, 3) d2, r as rank from ({_ranked(CUSTOMERS, PARTS, '(tx - x) * (tx - x) + 4 * (ty - y) * (ty - y)')}) where r <= 4",
    "sector_join": _sectors(TARGETS, OBS, 1, 1e18),
    "sector_maxdist": _sectors(CUSTOMERS, PARTS, 2, 1500.0**2),
    "knn_spacetime": f"select block_id, obs_id, d2, r as rank from ({_ranked(TARGETS, OBS, '(tx - x) * (tx - x) + (ty - y) * (ty - y) + (tt * 4 - t * 4) * (tt * 4 - t * 4)')}) where r <= 6",
    "knn_before": f"select block_id, obs_id, d2, r as rank from ({_ranked(PARTS.replace('obs_id', 'block_id').replace(' x,', ' tx,').replace(' y,', ' ty,').replace(' v,', ' tv,').replace(' cat', ' tcat'), PARTS, where='obs_id < block_id')}) where r <= 3",
    "score_cdf": "select z, round((sum(n) over (order by z) - n / 2.0) / sum(n) over (), 12) as p from (select p_size::bigint z, count(*) n from part group by 1)",
    "weighted_cdf": "select z, round((sum(n) over (order by z) - n / 2.0) / sum(n) over (), 12) as p from (select l_quantity::double z, sum(l_linenumber)::double n from lineitem group by 1)",
    "proportions": "select event_type, count(*) / sum(count(*)) over () as proportion from events group by 1",
    "variogram_models": _model_sql(),
    "nested_covariance": _nested_sql(),
    "spacetime_covariance": "select id, round(cs + ct + 0.75 * case when hj < 1 then 1 - 1.5 * hj + 0.5 * hj * hj * hj else 0 end, 9) metric, round(0.5 * cs * ct + cs + ct, 9) product from (select *, case when h = 0 then 2.5 when h < 30 then 2 * (1 - 1.5 * (h / 30) + 0.5 * pow(h / 30, 3)) else 0 end cs, case when dt = 0 then 1.25 else exp(-3 * dt / 10) end ct, sqrt(pow(h / 30, 2) + pow(dt / 40, 2)) hj from (select p_partkey::bigint id, (p_size - 1)::double h, (p_partkey % 23)::double dt from part))",
    "grid_kriging": f"select count(e) n, round(sum(e), 4) total, 2.125::double variance from (select block_id, avg(obs_id % 1000) e from ({_ranked('select i + 1 block_id, 0.5 + (i % 40) * 2500.0 tx, 0.5 + (i // 40) * 2500.0 ty from range(1600) t(i)', LINES.replace('select', 'select distinct'))}) where r <= 16 group by 1)",
    "duplicate_places": "select p_size::double x, (p_partkey % 7)::double y, count(*) n from part group by 1, 2 having count(*) > 1",
    "grid": "select i + 1 block_id, 0.5 + (i % 40) * 2.0 x, 10.0 + (i // 40) * 2.5 y from range(1200) t(i)",
}
