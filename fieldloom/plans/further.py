"""Queries of space-time co-kriging, pairs in time, sectors along a path, own centres and drifts, corrected weights, simulations whose
draws pass from block to block, replays of stored weights, and a stream; with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spacetime import SpaceTimeVariogram
from ..functions.variogram import Structure, Variogram
from ..operators import indicator, kriging, neighbours, simulation, spacetime, systems
from ..operators.kriging import Kriging
from ..operators.neighbours import Search
from ..operators.staging import Shelf, shared_dir
from ..sources.tables import weight_store, write_weights
from ..streaming.refresh import refresh
from . import algebra
from .algebra import distance, explained, side_by_side, weighted
from .core import CUSTOMERS, OBS, PARTS, SECOND, TARGETS, _place, _ranked, _rounded, _two_variables, customer_targets, nation_targets, part_obs, supplier_obs, table
from .general import AGAIN, CROSS, EXP, SPACE, TIME, _clipped_sql, _estimates, _exp, _kriged, _path, _sph, _system

PRODUCT = SpaceTimeVariogram(SPACE, TIME, "product_sum", k=0.5)


def _product(space: float, nugget: float, time: float, time_nugget: float) -> SpaceTimeVariogram:
    return SpaceTimeVariogram(Variogram((Structure("exp", space, 300.0, nugget),)), Variogram((Structure("exp", time, 20.0, time_nugget),)), "product_sum", k=0.5)


#: Sills and nuggets, in space and in time, of two variables and between them.
JOINT = {(1, 1): (2.0, 0.5, 1.0, 0.25), (2, 2): (1.0, 0.25, 0.5, 0.1), (1, 2): (0.8, 0.1, 0.4, 0.05)}
TURNED = Variogram((Structure("exp", 2.0, 40.0, 0.25, 20.0, 10.0, azimuth=30.0, dip=20.0, plunge=15.0),))
#: Little nugget and a long range: some weights are negative.
SMOOTH = Variogram((Structure("sph", 1.0, 3000.0, 0.02),))


# ---- space and time


def spacetime_cokriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables in place and time with a cross covariance, two neighbours of each."""
    s = supplier_obs(spark, sf_dir)
    second = s.where("obs_id % 2 = 0").withColumn("value", (F.col("obs_id") % 7 * 10).cast("double"))
    obs = s.withColumn("var_id", F.lit(1)).unionByName(second.withColumn("var_id", F.lit(2)))
    vgm = {pair: _product(*sills) for pair, sills in JOINT.items()}
    return _estimates(spacetime.spacetime_cokriging(obs, nation_targets(spark, sf_dir), vgm, 2, nmax=2, time_at=4.0, standard=True))


def spacetime_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours and five pairs of places and moments with a known difference."""
    k = F.col("r_regionkey")
    ends = {"x1": k * 150 + 50, "y1": k * 120 + 70, "t1": k * 9 + 2, "x2": k * 150 + 80, "y2": k * 120 + 70, "t2": k * 9 + 7}
    pairs = table(spark, sf_dir, "region").select(F.lit(1).alias("var_id"), k.cast("long").alias("grad_id"), *(c.cast("double").alias(n) for n, c in ends.items()), (k * 10 - 20.0).alias("value"), F.lit(0.1).alias("variance"))
    return _estimates(spacetime.spacetime_kriging(supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), PRODUCT, nmax=3, time_at=4.0, gradients=pairs))


def spacetime_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each quadrant in place, nearest in place and time."""
    return neighbours.neighbours(nation_targets(spark, sf_dir), supplier_obs(spark, sf_dir), ["x", "y", "t"], Search(2, sectors=True, time_at=4.0))


def sectors_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of each quadrant among parts with a lower key."""
    p = part_obs(spark, sf_dir).withColumn("pos", F.col("obs_id"))
    return neighbours.neighbours(p.withColumnRenamed("obs_id", "block_id"), p, ["x", "y"], Search(1, sectors=True), order="pos")


def covariance_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranges, turned by azimuth, dip and plunge."""
    lag = [(F.col("p_size") - 25).cast("double"), (F.pmod(F.col("p_partkey"), F.lit(41)) - 20).cast("double"), (F.pmod(F.col("p_partkey"), F.lit(17)) - 8).cast("double")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(TURNED.covariance_column(lag), 9).alias("c"))


# ---- estimation


def block_own_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are sought by a given place, with two nodes of unequal weight beside it."""
    t = customer_targets(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")) for a, w in ((3.0, 0.25), (9.0, 0.75)))))
    nodes = t.select("block_id", each.alias("o"), "x", "y").select("block_id", (F.col("x") + F.col("o.a")).alias("x"), "y", F.col("o.w").alias("weight"))
    k = Kriging(Variogram((Structure("exp", 4.0, 900.0),)), search=Search(4))
    return _estimates(kriging.estimate(part_obs(spark, sf_dir), t, k, nodes).drop("var_id"))


def drift_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables with a cross covariance, whose common drift is one coordinate for the first and the other for the second."""
    x, y = F.col("x") / 10007, F.col("y") / 9973
    obs = _two_variables(spark, sf_dir).withColumn("drift", F.when(F.col("var_id") == 1, F.array(x)).otherwise(F.array(y)))
    t = customer_targets(spark, sf_dir).withColumn("drift", F.array(F.array(x), F.array(y)))
    return _estimates(kriging.estimate(obs, t, Kriging(CROSS, search=Search(3), nvar=2, standard=True, ndrift=1)))


def positive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neighbours whose negative weights become zero, the rest summing to one."""
    k = Kriging(SMOOTH, search=Search(8), positive_weights=True)
    return _estimates(kriging.estimate(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), k).drop("var_id"))


def likely_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the greatest probability."""
    none = Variogram((Structure("nug", 0.0, 1.0, 0.0),))
    k = Kriging({(i, j): SMOOTH if i == j else none for i in (1, 2, 3) for j in range(i, 4)}, search=Search(8), nvar=3, standard=True)
    return indicator.most_likely(indicator.indicator_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), k, [1, 2, 3]), 3)


def system_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the system of each nation's two nearest suppliers."""
    k = Kriging(EXP, search=Search(2))
    rows = kriging.assembled(kriging.points_of(supplier_obs(spark, sf_dir), k), nation_targets(spark, sf_dir), k)
    return _rounded(systems.linear_systems(rows, k.model()), 8)


def stored_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights written with a manifest, read again by another configuration of equal content, and applied to other values."""
    obs, t, k = part_obs(spark, sf_dir), customer_targets(spark, sf_dir), Kriging(EXP, search=Search(4))
    path = f"{shared_dir(spark)}/weights/{uuid.uuid4().hex}"
    write_weights(kriging.solve(obs, t, k), path, k, obs)
    again = Kriging(EXP, search=Search(4))
    return _estimates(weight_store(spark, path, again).replay(obs.withColumn("value", F.col("value") * 2 + 1), again, t).drop("var_id"))


def stream_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of new values of the suppliers, in four batches or more: the last estimates of all blocks that they touch."""
    obs, t, k = supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), Kriging(EXP, search=Search(4))
    begin = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events, files = table(spark, sf_dir, "events").select("event_id", "user_id", "value"), spark.sparkContext.defaultParallelism
    events.repartitionByRange(files, "event_id").write.parquet(f"{begin}/events")
    new = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(f"{begin}/events").where("value is not null and user_id is not null")
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers"))
    new = new.crossJoin(F.broadcast(suppliers)).select((F.pmod("user_id", "suppliers") + 1).cast("long").alias("obs_id"), F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("at"))
    made = Shelf(spark, "stream", "block_id long, var_id int, estimate double, variance double, batch long", ["batch"])
    refresh(new, kriging.solve(obs, t, k), obs, k, lambda rows, batch: made.add(rows.withColumn("batch", F.lit(batch).cast("long"))), begin).awaitTermination()
    last = made.table().groupBy("block_id").agg(F.max_by(F.struct("estimate", "variance"), "batch").alias("e"))
    return _estimates(last.select("block_id", "e.*"))


# ---- simulation


def _in_time(t: DataFrame) -> DataFrame:
    return t.withColumn("t", _place(F.col("block_id"), 7, 53, 0.125))


def _normal_draws(t: DataFrame, *factors: int) -> DataFrame:
    """One realisation; several factors make several variables."""
    each = [((F.pmod(F.col("block_id") * m, F.lit(11)) - 5) / 5.0).cast("double") for m in factors]
    return t.select("block_id", (F.array(F.array(*each)) if len(each) > 1 else F.array(*each)).alias("eps"))


def simulation_spacetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neighbour in place and time: the value of the nearest supplier or earlier customer, and a draw by the distance to it."""
    t = _in_time(customer_targets(spark, sf_dir))
    k = spacetime.spacetime(PRODUCT, nmax=1, time_at=4.0)
    return _rounded(simulation.simulate(supplier_obs(spark, sf_dir), t, k, 1, path=_path(t), samples=_normal_draws(t, 3)), 5)


def simulation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables, each from its nearest datum or earlier node, by weights made once and values changed since."""
    none = Variogram((Structure("nug", 0.0, 1.0, 0.0),))
    k = Kriging({(1, 1): EXP, (2, 2): CROSS[2, 2], (1, 2): none}, search=Search(1), nvar=2, standard=True)
    obs, t = _two_variables(spark, sf_dir), customer_targets(spark, sf_dir)
    path = _path(t)
    weights = simulation.simulation_weights(obs, t, k, path)
    return _rounded(simulation.simulate(obs.withColumn("value", F.col("value") * 2 + 1), t, k, 1, path=path, samples=_normal_draws(t, 3, 7), weights=weights), 5)


def simulation_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks on the places of parts, two at each: what their systems hold, without earlier blocks that lie on a datum they hold."""
    p = part_obs(spark, sf_dir)
    t = p.select(F.explode(F.array(F.col("obs_id") * 2, F.col("obs_id") * 2 + 1)).alias("block_id"), "x", "y")
    k = Kriging(EXP, search=Search(2))
    path = _path(t)
    rows = kriging.weight_rows(simulation.simulation_weights(p, t, k, path)).where("w is not null")
    return rows.groupBy("block_id").agg(F.count_if(F.col("kind") == 0).alias("data"), F.count_if(F.col("kind") == 1).alias("nodes"))


def simulation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two realisations of two variables of a pure nugget, a column each."""
    k = Kriging({p: Variogram((Structure("nug", 0.0, 1.0, s),)) for p, s in {(1, 1): 4.0, (2, 2): 1.0, (1, 2): 1.6}.items()}, search=Search(4), nvar=2, unbiased=False, means=(10.0, 3.0))
    t = customer_targets(spark, sf_dir)
    obs = _two_variables(spark, sf_dir).withColumn("value", F.when(F.col("var_id") == 1, 10.0).otherwise(3.0))
    one = lambda m: ((F.pmod(F.col("block_id") * m, F.lit(11)) - 5) / 5.0).cast("double")
    eps = t.select("block_id", F.array(F.array(one(1), one(3)), F.array(one(7), one(9))).alias("eps"))
    return _rounded(simulation.wide(simulation.simulate(obs, t, k, 2, path=_path(t), samples=eps), t, k, 2))


# ---- SQL

IN_TIME = "(tx - x) * (tx - x) + (ty - y) * (ty - y) + (tt * 4 - t * 4) * (tt * 4 - t * 4)"


def _product_sql(h: str, dt: str, sills: tuple = JOINT[1, 1]) -> str:
    s, n, u, m = sills
    cs, ct = f"(case when {h} = 0 then {s + n} else {s} * exp(-3 * {h} / 300.0) end)", f"(case when {dt} = 0 then {u + m} else {u} * exp(-3 * {dt} / 20.0) end)"
    return f"(0.5 * {cs} * {ct} + {cs} + {ct})"


def _of(sills: dict, i: int, j: int):
    return sills[min(i, j), max(i, j)]


def _joint_sql(rows: str, var: list[int], cov, rules: list, prior) -> str:
    """Both variables from the data of both. ``cov``: of two data, or of a datum and a target (None, its variable); ``rules`` likewise."""
    n = len(var)
    m = n + len(rules)
    a = [["0"] * m for _ in range(m)]
    for i in range(n):
        for j in range(i, n):
            a[i][j] = prior(var[i]) if i == j else cov(i, j, var[j])
        for q, f in enumerate(rules):
            a[i][n + q] = f(i, var[i])
    parts = []
    for target in (1, 2):
        b = [cov(i, None, target) for i in range(n)] + [f(None, target) for f in rules]
        sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(n))])
        parts.append(f"select block_id, {target}::int var_id, round({weighted(n)}, 3) estimate, round({prior(target)} - ({explained(m)}), 4) variance from ({sql})")
    return " union all ".join(parts)


def _one_each(n: int) -> list:
    """Weights of the target's variable sum to one, those of the other to none."""
    return [lambda i, v, q=q: str(int(v == q)) for q in (1, 2)]


def _spacetime_cokriging_sql() -> str:
    second = f"select obs_id, x, y, t, (obs_id % 7 * 10)::double v from ({OBS}) where obs_id % 2 = 0"
    near = " union all ".join(f"select block_id, r + {2 * k} r, x, y, t, v, tx, ty, tt from ({_ranked(TARGETS, o, IN_TIME)}) where r <= 2" for k, o in enumerate((OBS, second)))
    rows, var = side_by_side(near, 4, ["x", "y", "t", "v"], ["tx", "ty", "tt"]), [1, 1, 2, 2]
    cov = lambda i, j, v: _product_sql(distance(i, j), f"abs(t{i} - {'tt' if j is None else f't{j}'})", _of(JOINT, var[i], v))
    return _joint_sql(rows, var, cov, _one_each(2), lambda v: _product_sql("0", "0", JOINT[v, v]))


def _drift_by_variable_sql() -> str:
    near = " union all ".join(f"select block_id, r + {3 * k} r, x, y, v, tx, ty from ({_ranked(CUSTOMERS, o)}) where r <= 3" for k, o in enumerate((PARTS, SECOND)))
    rows, var = side_by_side(near, 6, ["x", "y", "v"], ["tx", "ty"]), [1, 1, 1, 2, 2, 2]
    sills = {(1, 1): (4.0, 4.5), (2, 2): (2.0, 2.25), (1, 2): (1.5, 1.6)}
    place = lambda i, v: ("tx / 10007" if i is None else f"x{i} / 10007") if v == 1 else ("ty / 9973" if i is None else f"y{i} / 9973")
    return _joint_sql(rows, var, lambda i, j, v: _exp(distance(i, j), *_of(sills, var[i], v)), [place, *_one_each(2)], lambda v: str(sills[v, v][1]))


def _spacetime_gradients_sql() -> str:
    rows = side_by_side(_ranked(TARGETS, OBS, IN_TIME), 3, ["x", "y", "t", "v"], ["tx", "ty", "tt"])
    pairs = [((k * 150 + 50, k * 120 + 70, k * 9 + 2), (k * 150 + 80, k * 120 + 70, k * 9 + 7)) for k in range(5)]
    c = lambda p, q: _product_sql(f"sqrt(pow({p[0]} - {q[0]}, 2) + pow({p[1]} - {q[1]}, 2))", f"abs({p[2]} - {q[2]})")
    data = [(f"x{i}", f"y{i}", f"t{i}") for i in range(3)]
    target = ("tx", "ty", "tt")
    a = [["0"] * 9 for _ in range(9)]
    for i in range(3):
        for j in range(i, 3):
            a[i][j] = c(data[i], data[j])
        for g, (p, q) in enumerate(pairs):
            a[i][3 + g] = f"{c(data[i], p)} - {c(data[i], q)}"
        a[i][8] = "1"
    for g, (p, q) in enumerate(pairs):
        for h in range(g, 5):
            u, w = pairs[h]
            a[3 + g][3 + h] = f"{c(p, u)} - {c(p, w)} - {c(q, u)} + {c(q, w)} + {0.1 if g == h else 0}"
    b = [c(d, target) for d in data] + [f"{c(target, p)} - {c(target, q)}" for p, q in pairs] + ["1"]
    sql = algebra.solved(rows, a, b, ["block_id", "v0", "v1", "v2"])
    value = f"{weighted(3)} + " + " + ".join(f"s{3 + g} * {g * 10 - 20}" for g in range(5))
    return f"select block_id, round({value}, 3) estimate, round({_product_sql('0', '0')} - ({explained(9)}), 4) variance from ({sql})"


def _quadrants(t: str, o: str, d2: str, k: int, where: str = "true") -> str:
    """The k nearest of each quadrant among the 16 k nearest of all."""
    some = f"select *, (case when x < tx then 1 else 0 end + case when y < ty then 2 else 0 end)::int sector from ({_ranked(t, o, d2, where)}) where r <= {16 * k}"
    return f"select block_id, obs_id, d2, sector, rank from (select *, row_number() over (partition by block_id, sector order by d2, obs_id)::int rank from ({some})) where rank <= {k}"


def _turned_sql() -> str:
    cos, sin = (lambda d: repr(math.cos(math.radians(d)))), (lambda d: repr(math.sin(math.radians(d))))
    lag = "select p_partkey id, (p_size - 25)::double a, (p_partkey % 41 - 20)::double b, (p_partkey % 17 - 8)::double c from part"
    first = f"select id, {cos(30)} * a - {sin(30)} * b a, {sin(30)} * a + {cos(30)} * b b, c from ({lag})"
    second = f"select id, a, {cos(20)} * b + {sin(20)} * c b, {cos(20)} * c - {sin(20)} * b c from ({first})"
    third = f"select id, {cos(15)} * a + {sin(15)} * c a, b, {cos(15)} * c - {sin(15)} * a c from ({second})"
    return f"select id, round(case when a = 0 and b = 0 and c = 0 then 2.25 else 2 * exp(-3 * sqrt(pow(a / 20, 2) + pow(b / 40, 2) + pow(c / 10, 2))) end, 9) c from ({third})"


def _positive_sql() -> str:
    rows = side_by_side(_ranked(CUSTOMERS, PARTS), 8, ["x", "y", "v"], ["tx", "ty"])
    a, b = _system(8, lambda h: _sph(h, 1.0), 1.02)
    sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(8))])
    total = " + ".join(f"greatest(s{i}, 0)" for i in range(8))
    over = lambda c: " + ".join(f"greatest(s{i}, 0) * {c}{i}" for i in range(8))
    return f"select block_id, round(({over('v')}) / ({total}), 3) estimate, round(greatest(1.02 - ({over('k')}) / ({total}) - s8, 0), 4) variance from ({sql})"


def _entries_sql() -> str:
    """Data by their number, and not by distance."""
    two = f"select block_id, min(obs_id) a, max(obs_id) b, arg_min(sqrt(d2), obs_id) h0, arg_max(sqrt(d2), obs_id) h1, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) h from ({_ranked(TARGETS, OBS)}) where r <= 2 group by 1"
    c, k0, k1 = _exp("h", 4.0, 4.5), _exp("h0", 4.0, 4.5), _exp("h1", 4.0, 4.5)
    left = [["4.5", c, "1"], [c, "4.5", "1"], ["1", "1", "0"]]
    cells = [("a", i, j, left[i][j]) for i in range(3) for j in range(3)] + [("b", i, 0, v) for i, v in enumerate((k0, k1, "1"))]
    return " union all ".join(f"select block_id, '{p}' part, {i}::int as row, {j}::int col, round(({v})::double, 8) as value from ({two})" for p, i, j, v in cells)


def _passed_on(t: str, o: str, d2: str, spread: str, factor: int, change: str = "v") -> str:
    """Values along the nearest earlier ones: that of the datum or block, and the draw times ``spread``."""
    of = "block_id, tx, ty" + (", tt" if "tt" in d2 else "")
    back = f"select block_id obs_id, tx x, ty y{', tt t' if 'tt' in d2 else ''} from ({t})"
    near = f"select block_id, 0 kind, obs_id src, x, y{', t' if 'tt' in d2 else ''}, {of.replace('block_id, ', '')}, {d2} d2 from ({t}), ({o}) union all select block_id, 1, obs_id, x, y{', t' if 'tt' in d2 else ''}, {of.replace('block_id, ', '')}, {d2} from ({t}), ({back}) where obs_id < block_id"
    best = f"select * from ({near}) qualify row_number() over (partition by block_id order by d2, kind, src) = 1"
    steps = f"select block_id, kind, src, {spread} * ((block_id * {factor}) % 11 - 5) / 5.0::double e from ({best})"
    return f"with recursive near as materialized ({steps}), chain as (select block_id, {change} + e v from near join ({o}) on kind = 0 and src = obs_id union all select n.block_id, c.v + n.e from chain c join near n on n.kind = 1 and n.src = c.block_id) select block_id, v from chain"


MOVING = CUSTOMERS.replace(" from customer", ", ((c_custkey * 7) % 53 + 0.125)::double tt from customer")
APART = "sqrt(pow(tx - x, 2) + pow(ty - y, 2))"
FLAT = "(tx - x) * (tx - x) + (ty - y) * (ty - y)"


def _replay_sql() -> str:
    """The square root of twice the prior less the covariance with the one neighbour."""
    parts = []
    for v, (o, sill, zero, m) in enumerate(((PARTS, 4.0, 4.5, 3), (SECOND, 2.0, 2.25, 7)), 1):
        chain = _passed_on(CUSTOMERS, o, FLAT, f"sqrt(2 * ({zero} - {_exp(APART, sill)}))", m, "v * 2 + 1")
        parts.append(f"select block_id, {v}::int var_id, 1::int sim_id, round(v, 5) as value from ({chain})")
    return " union all ".join(parts)


NEWEST = "select (((user_id % n) + n) % n + 1)::bigint id, arg_max(value, event_id) nv from events, (select count(*) n from supplier) where value is not null and user_id is not null group by 1"


def _stream_sql() -> str:
    fresh = f"select o.obs_id, x, y, t, coalesce(nv, v) v, case when nv is null then 0 else 1 end changed from ({OBS}) o left join ({NEWEST}) on id = obs_id"
    touched = f"select block_id from ({_ranked(TARGETS, fresh)}) where r <= 4 group by 1 having max(changed) = 1"
    return f"select * from ({_kriged(TARGETS, fresh, 4, lambda h: _exp(h, 4.0), 4.5)}) where block_id in ({touched})"


def _own_centre_cov(i: int) -> str:
    return " + ".join(f"{w} * {_exp(f'sqrt(pow(x{i} - tx - {a}, 2) + pow(y{i} - ty, 2))', 4.0)}" for a, w in ((3, 0.25), (9, 0.75)))


def _colocated_sql() -> str:
    places = f"select obs_id * 2 + i block_id, x tx, y ty from ({PARTS}), (select unnest([0, 1]) i)"
    every = f"select block_id, tx, ty, 0 kind, obs_id src, x, y, {FLAT} d2 from ({places}), ({PARTS}) union all select a.block_id, a.tx, a.ty, 1, b.block_id, b.tx, b.ty, pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) from ({places}) a, ({places}) b where b.block_id < a.block_id"
    two = f"select * from ({every}) qualify row_number() over (partition by block_id order by d2, kind, src) <= 2"
    left = f"with two as materialized ({two}) select * from two s where kind = 0 or not exists (select 1 from two o where o.kind = 0 and o.block_id = s.block_id and o.x = s.x and o.y = s.y)"
    return f"select block_id::bigint block_id, count(*) filter (where kind = 0) as data, count(*) filter (where kind = 1) as nodes from ({left}) group by 1"


QUERIES = {f.__name__: f for f in (spacetime_cokriging, spacetime_gradients, spacetime_sectors, sectors_before, covariance_turned, block_own_centre, drift_by_variable, positive_weights, likely_category, system_entries, stored_weights, stream_estimates, simulation_spacetime, simulation_replay, simulation_colocated, simulation_columns)}

ORACLE_SQL = {
    "spacetime_cokriging": _spacetime_cokriging_sql(),
    "spacetime_gradients": _spacetime_gradients_sql(),
    "spacetime_sectors": _quadrants(TARGETS, OBS, IN_TIME, 2),
    "sectors_before": _quadrants(AGAIN, PARTS, FLAT, 1, "obs_id < block_id"),
    "covariance_turned": _turned_sql(),
    "block_own_centre": _kriged(CUSTOMERS, PARTS, 4, lambda h: _exp(h, 4.0), 4.0, prior=f"(4 * 0.625 + 0.375 * {_exp('6', 4.0)})", right=_own_centre_cov),
    "drift_by_variable": _drift_by_variable_sql(),
    "positive_weights": _positive_sql(),
    "likely_category": f"select block_id, arg_max(var_id, (estimate, -var_id)) var_id from ({_clipped_sql()}) group by 1",
    "system_entries": _entries_sql(),
    "stored_weights": _kriged(CUSTOMERS, PARTS, 4, lambda h: _exp(h, 4.0), 4.5, value=" + ".join(f"s{i} * (v{i} * 2 + 1)" for i in range(4))),
    "stream_estimates": _stream_sql(),
    "simulation_spacetime": f"select block_id, 1::int var_id, 1::int sim_id, round(v, 5) as value from ({_passed_on(MOVING, OBS, IN_TIME, 'sqrt(2 * (' + _product_sql('0', '0') + ' - ' + _product_sql(APART, 'abs(tt - t)') + '))', 3)})",
    "simulation_replay": _replay_sql(),
    "simulation_colocated": _colocated_sql(),
    "simulation_columns": f"select block_id, tx x, ty y, round(10 + 2 * a, 6) v1_s1, round(10 + 2 * c, 6) v1_s2, round(3 + 0.8 * a + 0.6 * b, 6) v2_s1, round(3 + 0.8 * c + 0.6 * d, 6) v2_s2 from (select *, {', '.join(f'(block_id * {m} % 11 - 5) / 5.0::double {n}' for m, n in ((1, 'a'), (3, 'b'), (7, 'c'), (9, 'd')))} from ({CUSTOMERS}))",
}
