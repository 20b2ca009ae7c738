"""Kriging: neighbours by joins, small dense systems solved in Arrow batches, weights applied by aggregates.

Weights depend on places, models and search only, never on values, so a weight table can be stored and applied to other
values of the same observations.

Observations: obs_id, coordinates, value, and where used var_id (from 1), err_var (null: 0), drift (array). Rows without a
value are left out before the search. Targets: block_id, coordinates, and where used rangescale, localnugget, drift (an
array, or one array for each target variable). A target without neighbours has a null estimate.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variogram import Variogram
from . import systems
from .neighbours import Search, neighbours
from .staging import stage
from .systems import Gradients, Model
from .targets import duplicate_places, weighted_nodes

SIDES = ("kind", "var_id", "src_id")
#: Pairs of places with a known difference that every system may hold.
PAIRS = 2_000


@dataclass(frozen=True)
class Kriging:
    """What is estimated, and how. ``vgm``: a model, or models by pair of variables. ``search``: one for all, or by variable."""

    vgm: object
    dims: tuple[str, ...] = ("x", "y")
    search: object = Search()
    nvar: int = 1
    unbiased: bool = True
    standard: bool = False
    ndrift: int = 0
    means: tuple[float, ...] = ()
    bounds: tuple[float | None, float | None] = (None, None)
    positive_weights: bool = False
    neglect_errors: bool = True
    cross_validation: bool = False
    check_places: bool = False
    gradients: DataFrame | None = field(default=None, compare=False)
    varying: DataFrame | None = field(default=None, compare=False)

    def model(self) -> Model:
        vgm = self.vgm if isinstance(self.vgm, dict) else {(1, 1): self.vgm}
        return Model(vgm, len(self.dims), self.nvar, self.unbiased, self.standard, self.ndrift, tuple(self.means), self.positive_weights, self.bounds, self.neglect_errors, self.varying is not None, self._gradients())

    def search_of(self, var: int) -> Search:
        return self.search[var] if isinstance(self.search, dict) else self.search

    def _gradients(self) -> Gradients | None:
        """Pairs are part of every block's system, so they are few by design: they are collected, PAIRS at most."""
        if self.gradients is None:
            return None
        d = len(self.dims)
        g = self.gradients
        drift = F.col("drift_diff") if "drift_diff" in g.columns else F.array(*(F.lit(0.0) for _ in range(self.ndrift)))
        rows = g.select("var_id", "grad_id", *(f"{c}{e}" for e in (1, 2) for c in self.dims), F.coalesce("variance", F.lit(0.0)).alias("variance"), drift.alias("drift")).orderBy("var_id", "grad_id").limit(PAIRS + 1).collect()
        if len(rows) > PAIRS:
            raise ValueError(f"more than {PAIRS} pairs of places with a known difference")
        if not rows:
            return None
        ends = np.array([list(r)[2 : 2 + 2 * d] for r in rows], float)
        return Gradients(np.array([r.var_id for r in rows]), np.array([r.grad_id for r in rows], np.int64), ends[:, :d], ends[:, d:], np.array([r.variance for r in rows], float), np.array([r.drift or [] for r in rows], float).reshape(len(rows), self.ndrift))

    def describe(self) -> str:
        vgm = self.vgm if isinstance(self.vgm, dict) else {(1, 1): self.vgm}
        kind = "ordinary" if self.unbiased else "simple"
        lines = [f"{kind} kriging of {self.nvar} variable(s) over {', '.join(self.dims)}, drift {self.ndrift}, bounds {self.bounds}, search {self.search}"]
        return "\n".join(lines + [f"variogram {pair}:\n{v.describe()}" for pair, v in vgm.items()])


def points_of(obs: DataFrame, k: Kriging) -> DataFrame:
    """Observations as data: kind 0, var_id, src_id, coordinates, err, drift, value."""
    if k.check_places and not duplicate_places(obs, list(k.dims)).isEmpty():
        raise ValueError("two observations of one variable at one place")
    var = F.col("var_id").cast("int") if "var_id" in obs.columns else F.lit(1)
    err = F.coalesce(F.col("err_var").cast("double"), F.lit(0.0)) if "err_var" in obs.columns else F.lit(0.0)
    drift = F.col("drift").cast("array<double>") if k.ndrift else F.array().cast("array<double>")
    value = F.col("value").cast("double") if "value" in obs.columns else F.lit(0.0)
    out = obs.select(F.lit(0).alias("kind"), var.alias("var_id"), F.col("obs_id").cast("long").alias("src_id"), *(F.col(d).cast("double").alias(d) for d in k.dims), err.alias("err"), drift.alias("drift"), value.alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _drift_of(targets: DataFrame, k: Kriging) -> Column:
    """Drift of each target variable, one after another."""
    if not k.ndrift:
        return F.array().cast("array<double>")
    if "array<array" in targets.schema["drift"].dataType.simpleString():
        return F.flatten(F.col("drift").cast("array<array<double>>"))
    return F.flatten(F.array(*(F.col("drift").cast("array<double>") for _ in range(k.nvar))))


def _alike(data: DataFrame, k: Kriging, order: str | None) -> list[list[int]]:
    """Variables whose data are the same rows but for their values, and are sought in the same way: one search finds them for all."""
    if k.nvar == 1 or k.cross_validation:
        return [[var] for var in range(1, k.nvar + 1)]
    row = ["kind", "src_id", *k.dims, "err", "drift", *([order] if order else [])]
    marks = [F.xxhash64(*row), F.xxhash64(F.lit(1), *row)]
    sums = data.groupBy("var_id").agg(F.count("*").alias("n"), *(F.sum(m.cast("decimal(20,0)")) for m in marks), *(F.bit_xor(m) for m in marks)).collect()
    of, groups = {r.var_id: tuple(r)[1:] for r in sums}, {}
    for var in range(1, k.nvar + 1):
        groups.setdefault((of.get(var), k.search_of(var)), []).append(var)
    return list(groups.values())


def assembled(data: DataFrame, targets: DataFrame, k: Kriging, nodes: DataFrame | None = None, order: str | None = None, values: bool = False) -> DataFrame:
    """One row a block with neighbours: near, nodes, rangescale, localnugget, tdrift[, vgm], ready to be solved; with ``values`` near has
    the data's values too."""
    dims, near, more = list(k.dims), None, ["err", "drift", *(["value"] if values else [])]
    for same in _alike(data, k, order):
        first = data.where(F.col("var_id") == same[0])
        if len(same) > 1 and values:
            # the values of all variables go with the place; rows that are alike but for the value are copies, and stay apart
            key = ["kind", "src_id", *dims, "err", "drift", *([order] if order else [])]
            first = data.where(F.col("var_id").isin(same)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("var_id", "value"))).alias("all"))
            copies = (F.size("all") / len(same)).cast("int")
            first = first.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
            first = first.select(*key, F.lit(same[0]).alias("var_id"), F.array(*(F.get("all", copies * i + F.col("copy")) for i in range(len(same)))).alias("each"))
        carried = [*dims, "err", "drift", *(["each" if len(same) > 1 else "value"] if values else [])]
        found = neighbours(targets, first, dims, k.search_of(same[0]), k.cross_validation and same[0] == 1, SIDES, order, carry=tuple(carried)).select("block_id", *SIDES, *carried)
        if k.cross_validation and same[0] > 1:
            found = found.where(F.col("src_id") != F.col("block_id"))
        if len(same) > 1:
            each = F.explode("each") if values else F.explode(F.array(*(F.struct(F.lit(v).cast("int").alias("var_id")) for v in same)))
            found = found.drop("var_id").withColumn("__v", each).select("block_id", "kind", "__v.var_id", "src_id", *dims, "err", "drift", *(["__v.value"] if values else []))
        near = found if near is None else near.unionByName(found)
    joined = near
    if order is not None:
        joined = _without_colocated(joined, dims)
    entry = F.struct("kind", "var_id", "src_id", F.array(*dims).alias("x"), *more)
    rows = joined.groupBy("block_id").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    one = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in targets.columns else F.lit(default)
    about = targets.select("block_id", F.array(*(F.col(d).cast("double") for d in dims)).alias("x0"), one("rangescale", 1.0).alias("rangescale"), one("localnugget", 0.0).alias("localnugget"), _drift_of(targets, k).alias("tdrift"))
    out = rows.join(about, "block_id")
    if nodes is None:
        out = out.withColumn("nodes", F.array(F.struct(F.col("x0").alias("x"), F.lit(1.0).alias("w"))))
    else:
        entry = F.struct(F.array(*(F.col(d).cast("double") for d in dims)).alias("x"), F.col("weight").cast("double").alias("w"))
        out = out.join(weighted_nodes(nodes).groupBy("block_id").agg(F.sort_array(F.collect_list(entry)).alias("nodes")), "block_id")
    if k.varying is not None:
        angle = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        entry = F.struct("ivar", "jvar", "struct_idx", "vtype", "nugget", "sill", "a_major", "a_minor1", "a_minor2", angle("azimuth"), angle("dip"), angle("plunge"), "is_product")
        out = out.join(k.varying.groupBy("block_id").agg(F.collect_list(entry).alias("vgm")), "block_id")
    return out.select("block_id", "near", "nodes", "rangescale", "localnugget", "tdrift", *(["vgm"] if k.varying is not None else []))


def _without_colocated(joined: DataFrame, dims: list[str]) -> DataFrame:
    """Without simulated nodes that lie on an observation of the same neighbourhood and variable."""
    obs = joined.where("kind = 0").select("block_id", "var_id", *(F.col(d).alias(f"o_{d}") for d in dims))
    sim = joined.where("kind = 1").alias("s")
    on = (F.col("s.block_id") == F.col("o.block_id")) & (F.col("s.var_id") == F.col("o.var_id"))
    for d in dims:
        on = on & (F.abs(F.col(f"s.{d}") - F.col(f"o.o_{d}")) <= 1e-6 * (1 + F.abs(F.col(f"o.o_{d}"))))
    return joined.where("kind = 0").unionByName(sim.join(obs.alias("o"), on, "left_anti"))


def solve(obs: DataFrame, targets: DataFrame, k: Kriging, nodes: DataFrame | None = None) -> DataFrame:
    """The weight table: (block_id, status, reused, weights, cov). Blocks without neighbours have no row."""
    return systems.solved(assembled(points_of(obs, k), targets, k, nodes), k.model())


def weight_rows(table: DataFrame) -> DataFrame:
    """(block_id, target_var, kind, var_id, src_id, w): one row a weight."""
    return table.select("block_id", F.explode("weights").alias("e")).select("block_id", "e.*")


def cov_rows(table: DataFrame) -> DataFrame:
    """(block_id, ivar, jvar, cov, status)."""
    return table.select("block_id", "status", F.explode("cov").alias("e")).select("block_id", "e.ivar", "e.jvar", "e.cov", "status")


def apply(table: DataFrame, obs: DataFrame, k: Kriging, targets: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(block_id, var_id, estimate, variance) from stored weights and any values of the same observations. ``rows``: the weights by
    source, where they are stored in that form too.

    With ``targets`` each of them has its rows, null where it had no neighbour. Failed systems have null estimates.
    """
    data = points_of(obs, replace(k, check_places=False)).select("kind", "var_id", "src_id", "value")
    if k.gradients is not None:
        g = k.gradients.select(F.lit(2).alias("kind"), F.col("var_id").cast("int").alias("var_id"), F.col("grad_id").cast("long").alias("src_id"), F.col("value").cast("double").alias("value"))
        data = data.unionByName(g)
    weighted = (weight_rows(table) if rows is None else rows).join(data, list(SIDES))
    # per source variable first: the sum-to-one form of several variables shifts each by the difference of local means
    by_var = weighted.groupBy("block_id", "target_var", "var_id").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.when(F.col("kind") < 2, F.col("w")).otherwise(0.0)).alias("sw"), F.avg(F.when(F.col("kind") < 2, F.col("value"))).alias("m"))
    other = F.col("var_id") != F.col("target_var")
    sums = by_var.groupBy("block_id", "target_var").agg(F.sum("s").alias("s"), F.sum("sw").alias("sw"), F.sum(F.when(other, F.col("sw")).otherwise(0.0)).alias("so"), F.sum(F.when(other, F.coalesce("m", F.lit(0.0)) * F.col("sw")).otherwise(0.0)).alias("mo"), F.coalesce(F.max(F.when(~other, F.col("m"))), F.lit(0.0)).alias("own"))
    value = F.col("s")
    if k.unbiased and not k.standard and k.nvar > 1:
        value = value + F.col("own") * F.col("so") - F.col("mo")
    if not k.unbiased and k.means:
        mean = F.array(*(F.lit(float(m)) for m in k.means))
        value = value + (1 - F.col("sw")) * F.element_at(mean, F.col("target_var"))
    value = clipped(F.when(~F.isnan(value), value), k.bounds)
    own_var = cov_rows(table).where("ivar = jvar").select("block_id", F.col("ivar").alias("target_var"), F.when(~F.isnan("cov"), F.col("cov")).alias("variance"))
    out = sums.select("block_id", "target_var", value.alias("estimate")).join(own_var, ["block_id", "target_var"])
    out = out.select("block_id", F.col("target_var").alias("var_id"), "estimate", "variance")
    if targets is None:
        return out
    every = targets.select("block_id", F.explode(F.sequence(F.lit(1), F.lit(k.nvar))).alias("var_id"))
    return every.join(out, ["block_id", "var_id"], "left")


def clipped(value: Column, bounds: tuple[float | None, float | None]) -> Column:
    low, high = bounds
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    return value if high is None else F.when(value > high, F.lit(float(high))).otherwise(value)


def estimate(obs: DataFrame, targets: DataFrame, k: Kriging, nodes: DataFrame | None = None) -> DataFrame:
    """(block_id, var_id, estimate, variance) of every target."""
    if k.gradients is not None:
        return apply(stage(solve(obs, targets, k, nodes)), obs, k, targets)
    # values come along with the data, so no weight is sent to its value
    out = systems.estimated(assembled(points_of(obs, k), targets, k, nodes, values=True), k.model())
    every = targets.select("block_id", F.explode(F.sequence(F.lit(1), F.lit(k.nvar))).alias("var_id"))
    return every.join(out, ["block_id", "var_id"], "left")


def _single(out: DataFrame) -> DataFrame:
    return out.select("block_id", "estimate", "variance")


def ordinary_kriging(obs: DataFrame, targets: DataFrame, vgm: Variogram, nmax: int = 16, dims: list[str] | None = None, maxdist: float | None = None, search: Search | None = None) -> DataFrame:
    return _single(estimate(obs, targets, Kriging(vgm, tuple(dims or ("x", "y")), search or Search(nmax, maxdist))))


def simple_kriging(obs: DataFrame, targets: DataFrame, vgm: Variogram, mean: float, nmax: int = 16, dims: list[str] | None = None) -> DataFrame:
    return _single(estimate(obs, targets, Kriging(vgm, tuple(dims or ("x", "y")), Search(nmax), unbiased=False, means=(mean,))))


def universal_kriging(obs: DataFrame, targets: DataFrame, vgm: Variogram, ndrift: int, nmax: int = 16, dims: list[str] | None = None) -> DataFrame:
    return _single(estimate(obs, targets, Kriging(vgm, tuple(dims or ("x", "y")), Search(nmax), ndrift=ndrift)))


def block_kriging(obs: DataFrame, nodes: DataFrame, vgm: Variogram, nmax: int = 16, dims: list[str] | None = None) -> DataFrame:
    """Means of blocks, from their integration nodes (block_id, coordinates[, weight]); blocks are sought by centroid."""
    from .targets import centroids

    dims = list(dims or ("x", "y"))
    return _single(estimate(obs, centroids(nodes, dims), Kriging(vgm, tuple(dims), Search(nmax)), nodes))


def cokriging(obs: DataFrame, targets: DataFrame, vgm: dict, nvar: int, nmax: int = 16, dims: list[str] | None = None, standard: bool = False) -> DataFrame:
    """(block_id, var_id, estimate, variance) of all variables together; ``standard``: weights of other variables sum to 0."""
    return estimate(obs, targets, Kriging(vgm, tuple(dims or ("x", "y")), Search(nmax), nvar=nvar, standard=standard))


def leave_one_out(obs: DataFrame, vgm: Variogram, nmax: int = 16, dims: list[str] | None = None) -> DataFrame:
    """(block_id, estimate, variance) at each observation from the others."""
    targets = obs.where(F.col("value").isNotNull()).withColumnRenamed("obs_id", "block_id")
    return _single(estimate(obs, targets.drop("value"), Kriging(vgm, tuple(dims or ("x", "y")), Search(nmax), cross_validation=True)))


def diagnostics(validated: DataFrame, obs: DataFrame) -> DataFrame:
    """(n, rmse, r, mssr): errors of a leave-one-out, their correlation, and mean squared standardised residual."""
    both = validated.join(obs.select(F.col("obs_id").alias("block_id"), F.col("value").cast("double").alias("z")), "block_id").where("estimate is not null and z is not null")
    e = F.col("estimate") - F.col("z")
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("estimate", "z").alias("r"), F.avg(F.when(F.col("variance") > 0, e * e / F.col("variance"))).alias("mssr"))


def wide(estimates: DataFrame, targets: DataFrame, k: Kriging) -> DataFrame:
    """One row a target: coordinates, estimate and variance, or est_v1.. and var_v1.. for several variables."""
    at = targets.select("block_id", *k.dims)
    if k.nvar == 1:
        return at.join(estimates.select("block_id", "estimate", "variance"), "block_id", "left")
    of = lambda c, v: F.max(F.when(F.col("var_id") == v, F.col(c)))
    columns = [of("estimate", v).alias(f"est_v{v}") for v in range(1, k.nvar + 1)] + [of("variance", v).alias(f"var_v{v}") for v in range(1, k.nvar + 1)]
    return at.join(estimates.groupBy("block_id").agg(*columns), "block_id", "left")
