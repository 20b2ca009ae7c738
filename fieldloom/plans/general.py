"""Queries of estimators in their general case: several neighbours under models with a range, cross covariances, drift, blocks,
and simulations with draws. Their SQL eliminates each block's system, written out by ``algebra``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.spacetime import SpaceTimeVariogram
from ..functions.variogram import Structure, Variogram
from ..operators import indicator, kriging, ranges, simulation, spacetime, systems
from ..operators.kriging import Kriging
from ..operators.neighbours import Search
from . import algebra
from .algebra import distance, explained, side_by_side, weighted
from .core import CUSTOMERS, FAR, LINES, OBS, PARTS, SECOND, TARGETS, _ranked, _rounded, _two_variables, customer_targets, line_obs, nation_targets, order_targets, part_obs, supplier_obs, table

EXP = Variogram((Structure("exp", 4.0, 900.0, 0.5),))
SPH = Variogram((Structure("sph", 4.0, 3000.0, 0.5),))
#: Two variables with a cross covariance.
CROSS = {(1, 1): EXP, (2, 2): Variogram((Structure("exp", 2.0, 900.0, 0.25),)), (1, 2): Variogram((Structure("exp", 1.5, 900.0, 0.1),))}


def _estimates(out: DataFrame) -> DataFrame:
    keep = [c for c in ("block_id", "var_id") if c in out.columns]
    return out.select(*keep, F.round("estimate", 3).alias("estimate"), F.round("variance", 4).alias("variance"))


def ordinary_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neighbours under an exponential model."""
    return _estimates(kriging.ordinary_kriging(supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), EXP, 8))


def ordinary_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(kriging.ordinary_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), SPH, 8))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part from its eight nearest others under a spherical model."""
    return _estimates(kriging.leave_one_out(part_obs(spark, sf_dir), SPH, 8))


def simple_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(kriging.simple_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), EXP, 1000.0, 6))


def universal_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coordinates as drift, ten neighbours, with the variance."""
    drift = F.array(F.col("x") / 10007, F.col("y") / 9973)
    obs, t = (d.withColumn("drift", drift) for d in (part_obs(spark, sf_dir), customer_targets(spark, sf_dir)))
    return _estimates(kriging.universal_kriging(obs, t, SPH, 2, 10))


def cokriging_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables with a cross covariance, three neighbours of each."""
    return _estimates(kriging.cokriging(_two_variables(spark, sf_dir), customer_targets(spark, sf_dir), CROSS, 2, 3, standard=True))


def universal_cokriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a drift."""
    drift = F.array(F.col("x") / 10007)
    obs, t = (d.withColumn("drift", drift) for d in (_two_variables(spark, sf_dir), customer_targets(spark, sf_dir)))
    return _estimates(kriging.estimate(obs, t, Kriging(CROSS, search=Search(3), nvar=2, standard=True, ndrift=1)))


def block_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of blocks of four nodes, from four neighbours."""
    t = customer_targets(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-6.0, 6.0) for b in (-6.0, 6.0))))
    nodes = t.select("block_id", each.alias("o"), "x", "y").select("block_id", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), F.lit(0.25).alias("weight"))
    return _estimates(kriging.block_kriging(part_obs(spark, sf_dir), nodes, Variogram((Structure("exp", 4.0, 900.0),)), 4))


def indicator_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities from weights of which some are negative: clipped, and divided by their sum."""
    one, none = Variogram((Structure("sph", 1.0, 3000.0, 0.02),)), Variogram((Structure("nug", 0.0, 1.0, 0.0),))
    k = Kriging({(i, j): one if i == j else none for i in (1, 2, 3) for j in range(i, 4)}, search=Search(8), nvar=3, standard=True)
    out = indicator.indicator_kriging(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), k, [1, 2, 3])
    return out.select("block_id", "var_id", F.round("estimate", 5).alias("estimate"))


def indicator_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories and a covariate that is correlated with the first, two neighbours of each variable."""
    own, other = Variogram((Structure("exp", 0.25, 900.0, 0.05),)), Variogram((Structure("exp", 1.0, 900.0, 0.2),))
    cross, none = Variogram((Structure("exp", 0.2, 900.0, 0.0),)), Variogram((Structure("nug", 0.0, 1.0, 0.0),))
    k = Kriging({(1, 1): own, (2, 2): own, (3, 3): other, (1, 2): none, (1, 3): cross, (2, 3): none}, search=Search(2), nvar=3, standard=True)
    obs = part_obs(spark, sf_dir).withColumn("category", F.col("category") % 2)
    extra = part_obs(spark, sf_dir).where("obs_id % 2 = 0").select("obs_id", "x", "y", (F.col("value") / 1000).alias("value"), F.lit(3).alias("var_id"))
    out = indicator.indicator_kriging(obs.drop("value"), customer_targets(spark, sf_dir), k, [0, 1], covariates=extra)
    return out.select("block_id", "var_id", F.round("estimate", 5).alias("estimate"))


SPACE, TIME = Variogram((Structure("exp", 2.0, 300.0, 0.5),)), Variogram((Structure("exp", 1.0, 20.0, 0.25),))


def spacetime_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbours in place and time, product-sum covariance."""
    return _estimates(spacetime.spacetime_kriging(supplier_obs(spark, sf_dir), nation_targets(spark, sf_dir), SpaceTimeVariogram(SPACE, TIME, "product_sum", k=0.5), nmax=4, time_at=4.0))


def spacetime_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over two moments, from two neighbours."""
    t = nation_targets(spark, sf_dir)
    nodes = t.withColumn("o", F.explode(F.array(F.lit(-1.0), F.lit(1.0)))).select("block_id", "x", "y", (F.col("t") + F.col("o")).alias("t"), F.lit(0.5).alias("weight"))
    return _estimates(spacetime.spacetime_kriging(supplier_obs(spark, sf_dir), t, SpaceTimeVariogram(SPACE, TIME, "product_sum", k=0.5), nmax=2, time_at=4.0, nodes=nodes))


def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known difference of prices between two places for each region."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(F.lit(1).alias("var_id"), k.cast("long").alias("grad_id"), (k * 1500 + 500.0).alias("x1"), (k * 1200 + 700.0).alias("y1"), (k * 1500 + 800.0).alias("x2"), (k * 1200 + 700.0).alias("y2"), (k * 10 - 20.0).alias("value"), F.lit(0.1).alias("variance"))


def gradient_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours and five pairs of places with a known difference."""
    k = Kriging(EXP, search=Search(3), gradients=_slopes(spark, sf_dir))
    return _estimates(kriging.estimate(part_obs(spark, sf_dir), customer_targets(spark, sf_dir), k).drop("var_id"))


def varying_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbours under a model of each target's own range and sill."""
    t = customer_targets(spark, sf_dir)
    zero = F.lit(0.0)
    own = t.select("block_id", F.lit(1).alias("ivar"), F.lit(1).alias("jvar"), F.lit(1).alias("struct_idx"), F.lit("exp").alias("vtype"), F.lit(0.5).alias("nugget"), (F.pmod("block_id", F.lit(3)) + 2.0).alias("sill"), (F.pmod("block_id", F.lit(7)) * 100 + 600.0).alias("a_major"))
    own = own.withColumn("a_minor1", F.col("a_major")).withColumn("a_minor2", F.col("a_major")).withColumns({a: zero for a in ("azimuth", "dip", "plunge")}).withColumn("is_product", F.lit(False))
    return _estimates(kriging.estimate(part_obs(spark, sf_dir), t, Kriging({}, search=Search(4), varying=own)).drop("var_id"))


def factor_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, and the distinct neighbourhoods that their systems were factored for."""
    return systems.counters(kriging.solve(supplier_obs(spark, sf_dir), customer_targets(spark, sf_dir), Kriging(EXP, search=Search(3))))


def factor_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cholesky factors and Schur complements of pairs of neighbours."""
    k = Kriging(EXP, search=Search(2))
    f = systems.factors(kriging.assembled(kriging.points_of(supplier_obs(spark, sf_dir), k), nation_targets(spark, sf_dir), k), k.model())
    entries = {"l11": F.col("lower")[0], "l21": F.col("lower")[2], "l22": F.col("lower")[3], "f1": F.col("solved_constraints")[0], "schur": F.col("schur")[0]}
    return f.select(F.col("data")[0].alias("a"), F.col("data")[1].alias("b"), *(F.round(c, 8).alias(n) for n, c in entries.items()))


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts within a distance of each customer."""
    return ranges.within(customer_targets(spark, sf_dir), part_obs(spark, sf_dir), ["x", "y"], 300.0)


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many order lines lie within a distance of each supplier's place, which grows with its number."""
    t = order_targets(spark, sf_dir).withColumn("r", F.pmod("block_id", F.lit(5)) * 4000.0)
    return ranges.count_within(t, line_obs(spark, sf_dir), ["x", "y"], "r")


# ---- normal scores


def _order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_totalprice").cast("double") / 100).alias("value"), ((F.pmod(F.col("o_orderkey") * 37, F.lit(601)) - 300) / 100.0).alias("score"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal.score_table(part_obs(spark, sf_dir))


def scores_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all orders' prices in the distribution of the parts' prices, between its values and beyond them."""
    out = normal.forward(_order_prices(spark, sf_dir).drop("score"), _prices(spark, sf_dir))
    return out.select("id", F.round("score", 7).alias("score"))


def scores_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of scores, with a power and a hyperbolic tail."""
    tails = normal.Tails(500.0, 4000.0, "power", "hyperbolic", 2.0, 3.0)
    out = normal.back(_order_prices(spark, sf_dir).drop("value"), _prices(spark, sf_dir), tails)
    return out.select("id", F.round("value", 5).alias("value"))


# ---- simulation


def _draws(t: DataFrame, *factors: int) -> DataFrame:
    """Draws from the blocks' numbers, one realisation; several factors make several variables."""
    each = [((F.pmod(F.col("block_id") * m, F.lit(11)) - 5) / 5.0).cast("double") for m in factors]
    return t.select("block_id", (F.array(F.array(*each)) if len(each) > 1 else F.array(*each)).alias("eps"))


def simulation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neighbour and draws of 0: each customer takes the value of the nearest supplier or earlier customer, in many steps."""
    t = customer_targets(spark, sf_dir)
    eps = t.select("block_id", F.array(F.lit(0.0)).alias("eps"))
    return _rounded(simulation.simulate(supplier_obs(spark, sf_dir), t, Kriging(EXP, search=Search(1)), 1, path=_path(t), samples=eps, stretch=256))


def simulation_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables of a correlated pure nugget: each draw turned by the root of their covariance."""
    nugget = {(1, 1): 4.0, (2, 2): 1.0, (1, 2): 1.6}
    k = Kriging({p: Variogram((Structure("nug", 0.0, 1.0, s),)) for p, s in nugget.items()}, search=Search(4), nvar=2, unbiased=False, means=(10.0, 3.0))
    t = customer_targets(spark, sf_dir)
    obs = _two_variables(spark, sf_dir).withColumn("value", F.when(F.col("var_id") == 1, 10.0).otherwise(3.0))
    return _rounded(simulation.simulate(obs, t, k, 1, path=_path(t), samples=_draws(t, 1, 3)))


def simulation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal scores that are drawn independently, and their values in the distribution of the parts' prices."""
    k = Kriging(Variogram((Structure("nug", 0.0, 1.0, 1.0),)), search=Search(2), unbiased=False, means=(0.0,))
    t = customer_targets(spark, sf_dir)
    tails = normal.Tails(500.0, 4000.0, "power", "hyperbolic", 2.0, 3.0)
    return _rounded(simulation.score_simulation(part_obs(spark, sf_dir), t, k, tails, 1, path=_path(t), samples=_draws(t, 7)), 5)


def simulation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories drawn from the shares 0.2, 0.3 and 0.5 by given numbers."""
    own, none = Variogram((Structure("nug", 0.0, 1.0, 0.25),)), Variogram((Structure("nug", 0.0, 1.0, 0.0),))
    k = Kriging({(i, j): own if i == j else none for i in (1, 2, 3) for j in range(i, 4)}, search=Search(3), nvar=3, unbiased=False, means=(0.2, 0.3, 0.5))
    t = customer_targets(spark, sf_dir)
    u = t.select("block_id", F.array(*((F.pmod(F.col("block_id") * m, F.lit(97)) / 97.0) for m in (5, 11))).alias("eps"))
    return simulation.indicator_simulation(part_obs(spark, sf_dir), t, k, [1, 2, 3], 2, path=_path(t), samples=u)


def _path(t: DataFrame) -> DataFrame:
    """Along the blocks' numbers."""
    return simulation.ordered_path(t, ["block_id"])


# ---- SQL


def _exp(h: str, sill: float, zero: float | None = None) -> str:
    c = f"{sill} * exp(-3 * {h} / 900.0)"
    return c if zero is None else f"case when {h} = 0 then {zero} else {c} end"


def _sph(h: str, sill: float = 4.0) -> str:
    return f"{sill} * (1 - 1.5 * least({h} / 3000.0, 1) + 0.5 * pow(least({h} / 3000.0, 1), 3))"


def _system(n: int, cov, zero: float, drift: list = (), unbiased: bool = True) -> tuple[list, list]:
    """Left and right side: ``cov`` of a distance's SQL, ``drift`` of a datum's number (None: the target)."""
    rules = [*drift, *([lambda i: "1"] if unbiased else [])]
    m = n + len(rules)
    a = [["0"] * m for _ in range(m)]
    for i in range(n):
        for j in range(i, n):
            a[i][j] = str(zero) if i == j else cov(distance(i, j))
        for q, f in enumerate(rules):
            a[i][n + q] = f(i)
    return a, [cov(distance(i, None)) for i in range(n)] + [f(None) for f in rules]


def _kriged(t: str, o: str, n: int, cov, zero: float, drift: list = (), where: str = "true", value: str | None = None, prior: float | None = None, unbiased: bool = True, right=None) -> str:
    rows = side_by_side(_ranked(t, o, where=where), n, ["x", "y", "v"], ["tx", "ty"])
    a, b = _system(n, cov, zero, drift, unbiased)
    if right:
        b = [right(i) for i in range(n)] + b[n:]
    sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(n))])
    return f"select block_id, round({value or weighted(n)}, 3) estimate, round(greatest({prior or zero} - ({explained(len(b))}), 0), 4) variance from ({sql})"


AGAIN = PARTS.replace("obs_id", "block_id").replace(" x,", " tx,").replace(" y,", " ty,").replace(" v,", " tv,").replace(" cat", " tcat")
PLACES = [lambda i: "tx / 10007" if i is None else f"x{i} / 10007", lambda i: "ty / 9973" if i is None else f"y{i} / 9973"]


def _cross_sql(drift: bool) -> str:
    """Three neighbours of each variable, both right sides."""
    near = " union all ".join(f"select block_id, r + {3 * k} r, x, y, v, tx, ty from ({_ranked(CUSTOMERS, o)}) where r <= 3" for k, o in enumerate((PARTS, SECOND)))
    rows = side_by_side(near, 6, ["x", "y", "v"], ["tx", "ty"])
    var = [1, 1, 1, 2, 2, 2]
    sills = {(1, 1): (4.0, 4.5), (2, 2): (2.0, 2.25), (1, 2): (1.5, 1.6)}
    cov = lambda i, j, h: _exp(h, *sills[min(i, j), max(i, j)])
    rules = [*(PLACES[:1] if drift else []), lambda i: "1" if i is not None and var[i] == 1 else "0", lambda i: "1" if i is not None and var[i] == 2 else "0"]
    m = 6 + len(rules)
    a = [["0"] * m for _ in range(m)]
    for i in range(6):
        for j in range(i, 6):
            a[i][j] = str(sills[var[i], var[i]][1]) if i == j else cov(var[i], var[j], distance(i, j))
        for q, f in enumerate(rules):
            a[i][6 + q] = f(i)
    parts = []
    for target in (1, 2):
        b = [cov(var[i], target, distance(i, None)) for i in range(6)] + ([PLACES[0](None)] if drift else []) + [str(int(target == 1)), str(int(target == 2))]
        sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(6))])
        parts.append(f"select block_id, {target}::int var_id, round({weighted(6)}, 3) estimate, round({sills[target, target][1]} - ({explained(m)}), 4) variance from ({sql})")
    return " union all ".join(parts)


def _clipped_sql() -> str:
    rows = side_by_side(_ranked(CUSTOMERS, PARTS), 8, ["x", "y", "cat"], ["tx", "ty"])
    a, b = _system(8, lambda h: _sph(h, 1.0), 1.02)
    sql = algebra.solved(rows, a, b, ["block_id", *(f"cat{i}" for i in range(8))])
    share = lambda c: "greatest(0, least(1, " + " + ".join(f"s{i} * (cat{i} = {c})::int" for i in range(8)) + f")) p{c}"
    shares = f"select block_id, {', '.join(share(c) for c in (1, 2, 3))} from ({sql})"
    return f"select block_id, c::int var_id, round(case c when 1 then p1 when 2 then p2 else p3 end / (p1 + p2 + p3), 5) estimate from ({shares}), (select unnest([1, 2, 3]) c)"


def _covariate_sql() -> str:
    """Variables in turn: two data of each; the second category has none but its own."""
    two = PARTS.replace("(p_size % 3 + 1)::int cat", "((p_size % 3 + 1) % 2)::int cat")
    third = f"select obs_id, x, y, v / 1000 v from ({PARTS}) where obs_id % 2 = 0"
    parts = [(two, "(cat = 0)::int::double"), (two, "(cat = 1)::int::double"), (third, "v")]
    near = " union all ".join(f"select block_id, r + {2 * k} r, x, y, {v} v, tx, ty from ({_ranked(CUSTOMERS, o)}) where r <= 2" for k, (o, v) in enumerate(parts))
    rows = side_by_side(near, 6, ["x", "y", "v"], ["tx", "ty"])
    var = [1, 1, 2, 2, 3, 3]
    sills = {(1, 1): (0.25, 0.3), (2, 2): (0.25, 0.3), (3, 3): (1.0, 1.2), (1, 3): (0.2, 0.2)}
    cov = lambda i, j, h: _exp(h, *sills[min(i, j), max(i, j)]) if (min(i, j), max(i, j)) in sills else "0"
    a = [["0"] * 9 for _ in range(9)]
    for i in range(6):
        for j in range(i, 6):
            a[i][j] = str(sills[var[i], var[i]][1]) if i == j else cov(var[i], var[j], distance(i, j))
        a[i][5 + var[i]] = "1"
    out = {}
    for target in (1, 2, 3):
        b = [cov(var[i], target, distance(i, None)) for i in range(6)] + [str(int(target == q)) for q in (1, 2, 3)]
        out[target] = f"select block_id, {weighted(6)} e{target} from ({algebra.solved(rows, a, b, ['block_id', *(f'v{i}' for i in range(6))])})"
    clip = "greatest(0, least(1, {0}))"
    both = f"select block_id, {clip.format('e1')} p1, {clip.format('e2')} p2, e3 from ({out[1]}) join ({out[2]}) using (block_id) join ({out[3]}) using (block_id)"
    return f"select block_id, c::int var_id, round(case c when 3 then e3 when 1 then p1 / case when p1 + p2 > 0 then p1 + p2 else 1 end else p2 / case when p1 + p2 > 0 then p1 + p2 else 1 end end, 5) estimate from ({both}), (select unnest([1, 2, 3]) c)"


def _spacetime_sql(n: int, moments: tuple[float, ...]) -> str:
    d2 = "(tx - x) * (tx - x) + (ty - y) * (ty - y) + (tt * 4 - t * 4) * (tt * 4 - t * 4)"
    rows = side_by_side(_ranked(TARGETS, OBS, d2), n, ["x", "y", "t", "v"], ["tx", "ty", "tt"])
    cs = lambda h: f"(case when {h} = 0 then 2.5 else 2 * exp(-3 * {h} / 300.0) end)"
    ct = lambda h: f"(case when {h} = 0 then 1.25 else exp(-3 * {h} / 20.0) end)"
    both = lambda h, dt: f"(0.5 * {cs(h)} * {ct(dt)} + {cs(h)} + {ct(dt)})"
    zero = 0.5 * 2.5 * 1.25 + 2.5 + 1.25
    a = [["0"] * (n + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(i, n):
            a[i][j] = str(zero) if i == j else both(distance(i, j), f"abs(t{i} - t{j})")
        a[i][n] = "1"
    b = [" + ".join(f"{both(distance(i, None), f'abs(tt + {o} - t{i})')} / {len(moments)}" for o in moments) for i in range(n)] + ["1"]
    prior = " + ".join(f"{both('0', str(abs(p - q)))} / {len(moments) ** 2}.0" for p in moments for q in moments)
    sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(n))])
    return f"select block_id, round({weighted(n)}, 3) estimate, round({prior} - ({explained(n + 1)}), 4) variance from ({sql})"


def _nodes_cov(i: int) -> str:
    return " + ".join(_exp(f"sqrt(pow(x{i} - tx + {a}, 2) + pow(y{i} - ty + {b}, 2))", 4.0) + " / 4" for a in (-6, 6) for b in (-6, 6))


def _polynomial(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({x} * {out} + {c!r})"
    return out


def _cdf_sql(y: str) -> str:
    """Good where the absolute value is below 7."""
    top, bottom = (_polynomial(c, f"abs({y})") for c in normal.BELOW)
    return f"(case when {y} > 0 then 1 - exp(-{y} * {y} / 2.0) * {top} / {bottom} else exp(-{y} * {y} / 2.0) * {top} / {bottom} end)"


def _inverse_sql(p: str) -> str:
    ratio = lambda pair, x: f"{_polynomial(pair[0], x)} / {_polynomial(pair[1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"(case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {ratio(normal.MIDDLE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} else sign({p} - 0.5) * (case when {r} <= 5 then {ratio(normal.NEAR_TAIL, f'({r} - 1.6)')} else {ratio(normal.FAR_TAIL, f'({r} - 5)')} end) end)"


KNOTS = "select z, p, lead(z) over (order by z) z1, lead(p) over (order by z) p1 from (select z, (sum(n) over (order by z) - n / 2.0) / sum(n) over () p from (select p_retailprice::double z, count(*)::double n from part group by 1))"
ENDS = "select min(z) za, max(z) zb, min(p) pa, max(p) pb from knots"


def _forward_sql() -> str:
    p = "case when k.z is null then pa when k.z1 is null then k.p else k.p + (v - k.z) / (k.z1 - k.z) * (k.p1 - k.p) end"
    return f"with knots as ({KNOTS}), ends as ({ENDS}), o as (select o_orderkey::bigint id, o_totalprice::double / 100 v from orders), placed as (select id, {p} p from o asof left join knots k on v >= k.z, ends) select id, round({_inverse_sql('p')}, 7) score from placed"


def _back_sql(scored: str, keep: str, name: str = "value") -> str:
    inside = "k.z + (q - k.p) / (k.p1 - k.p) * (k.z1 - k.z)"
    below = "500.0 + pow(greatest(q / pa, 0), 2) * (za - 500.0)"
    above = "pow((1 - pb) * pow(zb, 3) / greatest(1 - q, 1e-12), 1 / 3.0::double)"
    return f"with knots as ({KNOTS}), ends as ({ENDS}), o as (select *, {_cdf_sql('y')} q from ({scored})), placed as (select o.*, case when q <= pa then {below} when q >= pb then {above} else {inside} end v from o asof left join knots k on q >= k.p, ends) select {keep}, round(least(greatest(v, 500), 4000), 5) {name} from placed"


def _gradient_sql() -> str:
    rows = side_by_side(_ranked(CUSTOMERS, PARTS), 3, ["x", "y", "v"], ["tx", "ty"])
    ends = [((k * 1500 + 500, k * 1200 + 700), (k * 1500 + 800, k * 1200 + 700)) for k in range(5)]
    c = lambda x, y, p: f"(case when {x} = {p[0]} and {y} = {p[1]} then 4.5 else {_exp(f'sqrt(pow({x} - {p[0]}, 2) + pow({y} - {p[1]}, 2))', 4.0)} end)"
    a = [["0"] * 9 for _ in range(9)]
    for i in range(3):
        for j in range(i, 3):
            a[i][j] = "4.5" if i == j else _exp(distance(i, j), 4.0)
        for g, (p, q) in enumerate(ends):
            a[i][3 + g] = f"{c(f'x{i}', f'y{i}', p)} - {c(f'x{i}', f'y{i}', q)}"
        a[i][8] = "1"
    for g, (p, q) in enumerate(ends):
        for h in range(g, 5):
            u, w = ends[h]
            a[3 + g][3 + h] = f"{c(*p, u)} - {c(*p, w)} - {c(*q, u)} + {c(*q, w)} + {0.1 if g == h else 0}"
    b = [_exp(distance(i, None), 4.0) for i in range(3)] + [f"{c('tx', 'ty', p)} - {c('tx', 'ty', q)}" for p, q in ends] + ["1"]
    sql = algebra.solved(rows, a, b, ["block_id", "v0", "v1", "v2"])
    value = f"{weighted(3)} + " + " + ".join(f"s{3 + g} * {g * 10 - 20}" for g in range(5))
    return f"select block_id, round({value}, 3) estimate, round(4.5 - ({explained(9)}), 4) variance from ({sql})"


def _varying_sql() -> str:
    rows = side_by_side(_ranked(CUSTOMERS, PARTS), 4, ["x", "y", "v"], ["tx", "ty"])
    cov = lambda h: f"(block_id % 3 + 2) * exp(-3 * {h} / (block_id % 7 * 100 + 600.0))"
    a, b = _system(4, cov, "(block_id % 3 + 2.5)")
    sql = algebra.solved(rows, a, b, ["block_id", *(f"v{i}" for i in range(4))])
    return f"select block_id, round({weighted(4)}, 3) estimate, round(block_id % 3 + 2.5 - ({explained(5)}), 4) variance from ({sql})"


PAIRS = f"select distinct min(obs_id) a, max(obs_id) b, {_exp('sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2))', 4.0)} c from ({_ranked(TARGETS, OBS)}) where r <= 2 group by block_id"

LEVELS = f"with recursive o as ({OBS}), t as ({CUSTOMERS}), near as (select block_id, best.kind, best.src from (select block_id, min({{'d2': d2, 'kind': kind, 'src': src}}) best from (select t.block_id, 0 kind, o.obs_id src, (tx - x) * (tx - x) + (ty - y) * (ty - y) d2 from t, o union all select t.block_id, 1, p.block_id, (t.tx - p.tx) * (t.tx - p.tx) + (t.ty - p.ty) * (t.ty - p.ty) from t, t p where p.block_id < t.block_id) group by 1)), chain as (select block_id, kind, src from near union all select c.block_id, n.kind, n.src from chain c join near n on c.kind = 1 and c.src = n.block_id) select block_id, 1::int var_id, 1::int sim_id, round(v, 6) as value from chain join o on kind = 0 and src = obs_id"

QUERIES = {f.__name__: f for f in (ordinary_kriging, ordinary_spherical, leave_one_out, simple_kriging, universal_kriging, cokriging_cross, universal_cokriging, block_four, indicator_clipped, indicator_covariate, spacetime_four, spacetime_block, gradient_kriging, varying_ranges, factor_reuse, factor_entries, range_search, range_count, scores_forward, scores_back, simulation_levels, simulation_joint, simulation_scores, simulation_categories)}

ORACLE_SQL = {
    "ordinary_kriging": _kriged(TARGETS, OBS, 8, lambda h: _exp(h, 4.0), 4.5),
    "ordinary_spherical": _kriged(CUSTOMERS, PARTS, 8, _sph, 4.5),
    "leave_one_out": _kriged(AGAIN, PARTS, 8, _sph, 4.5, where="obs_id <> block_id"),
    "simple_kriging": _kriged(CUSTOMERS, PARTS, 6, lambda h: _exp(h, 4.0), 4.5, unbiased=False, value=f"{weighted(6)} + 1000 * (1 - ({' + '.join(f's{i}' for i in range(6))}))"),
    "universal_kriging": _kriged(CUSTOMERS, PARTS, 10, _sph, 4.5, PLACES),
    "cokriging_cross": _cross_sql(False),
    "universal_cokriging": _cross_sql(True),
    "block_four": _kriged(CUSTOMERS, PARTS, 4, lambda h: _exp(h, 4.0), 4.0, prior=f"(4 + 2 * {_exp('12', 4.0)} + {_exp('sqrt(288)', 4.0)}) / 4", right=_nodes_cov),
    "indicator_clipped": _clipped_sql(),
    "indicator_covariate": _covariate_sql(),
    "spacetime_four": _spacetime_sql(4, (0.0,)),
    "spacetime_block": _spacetime_sql(2, (-1.0, 1.0)),
    "gradient_kriging": _gradient_sql(),
    "varying_ranges": _varying_sql(),
    "factor_reuse": f"select 'ok' status, count(*) n, count(distinct ids) factors from (select block_id, list(obs_id order by obs_id) ids from ({_ranked(CUSTOMERS, OBS)}) where r <= 3 group by 1)",
    "factor_entries": f"select a, b, round(sqrt(4.5::double), 8) l11, round(c / sqrt(4.5::double), 8) l21, round(sqrt(4.5::double - c * c / 4.5), 8) l22, round(1 / (4.5 + c), 8) f1, round(2 / (4.5 + c), 8) schur from ({PAIRS})",
    "range_search": f"select block_id, obs_id, d2 from (select *, (tx - x) * (tx - x) + (ty - y) * (ty - y) d2 from ({CUSTOMERS}) cross join ({PARTS})) where d2 <= 90000",
    "range_count": f"select block_id, count(*) filter (where (tx - x) * (tx - x) + (ty - y) * (ty - y) <= pow(block_id % 5 * 4000.0, 2)) n from ({FAR}) cross join ({LINES}) group by 1",
    "scores_forward": _forward_sql(),
    "scores_back": _back_sql("select o_orderkey::bigint id, ((o_orderkey * 37) % 601 - 300) / 100.0::double y from orders", "id"),
    "simulation_levels": LEVELS,
    "simulation_joint": "select c_custkey::bigint block_id, v::int var_id, 1::int sim_id, round(case when v = 1 then 10 + 2 * a else 3 + 0.8 * a + 0.6 * b end, 6) as value from (select c_custkey, (c_custkey % 11 - 5) / 5.0::double a, (c_custkey * 3 % 11 - 5) / 5.0::double b from customer), (select unnest([1, 2]) v)",
    "simulation_scores": _back_sql("select c_custkey::bigint block_id, 1::int var_id, 1::int sim_id, (c_custkey * 7 % 11 - 5) / 5.0::double y from customer", "block_id, var_id, sim_id"),
    "simulation_categories": "select c_custkey::bigint block_id, s::int sim_id, case when u <= 0.2 then 1 when u <= 0.5 then 2 else 3 end::int category from (select c_custkey, s, (c_custkey * case when s = 1 then 5 else 11 end % 97) / 97.0::double u from customer, (select unnest([1, 2]) s))",
}
