"""Sequential simulation, Gaussian and indicator.

Blocks are visited in the order of a path; each is kriged from the observations and the blocks before it. Neighbours and
weights need no values, so all systems are solved side by side. What is left is a substitution: it goes by the steps of
``levels``, whose blocks are independent of each other or a short stretch of the path. When a step is done, its values go
along the edges to the blocks that read them, summed by block, and wait there; each edge is used once, for all realisations.

A draw is a function of (seed, realisation, variable, block) alone, so draws depend neither on partitions nor on the path,
and any of them can be made again (``draws``).
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Tails, back, inverse, score_table, scores, with_inverse
from . import systems
from .kriging import SIDES, Kriging, assembled, clipped, points_of
from .levels import STRETCH, steps
from .staging import Shelf, prefix_sums, stage

#: Realisations that one row of a substitution holds.
TOGETHER = 16


def ordered_path(targets: DataFrame, by: list[str]) -> DataFrame:
    """(block_id, pos from 1) in the order of columns, which have to tell all blocks apart."""
    keyed = targets.select("block_id", *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.lit(1).alias("__one"))
    placed = prefix_sums(keyed, [f"__k{i}" for i in range(len(by))], "__one")
    return placed.select("block_id", (F.col("before") + 1).cast("long").alias("pos"))


def random_path(targets: DataFrame, seed: int) -> DataFrame:
    """(block_id, pos from 1): a permutation that depends on the seed and the ids alone."""
    return ordered_path(targets.withColumn("__h", F.xxhash64(F.lit(seed), "block_id")), ["__h", "block_id"])


def checked_path(path: DataFrame, targets: DataFrame) -> DataFrame:
    """``path`` if it visits every target once, at positions 1 to n; else ValueError."""
    n = targets.count()
    p = path.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    if n and ((p.n, p.d, p.lo, p.hi) != (n, n, 1, n) or path.join(targets, "block_id", "left_semi").select("block_id").distinct().count() != n):
        raise ValueError("a path has to be a permutation of the targets")
    return path


def uniform(seed: int, sim: Column, var: Column, block: Column) -> Column:
    """A number between 0 and 1, never either."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), sim.cast("int"), var.cast("int"), block.cast("long")), 11) + 0.5) / float(1 << 53)


def draws(blocks: DataFrame, nsim: int, nvar: int, seed: int, categories: bool = False) -> DataFrame:
    """(block_id, sim_id, var_id, eps): the draws of a simulation with ``seed``, standard normal, or uniform for categories."""
    each = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    rows = blocks.select("block_id").withColumn("sim_id", each(nsim)).withColumn("var_id", each(1 if categories else nvar))
    rows = rows.withColumn("eps", uniform(seed, F.col("sim_id"), F.col("var_id"), F.col("block_id")))
    return rows if categories else with_inverse(rows, "eps", "eps")


def _weights(obs: DataFrame, targets: DataFrame, k: Kriging, path: DataFrame) -> DataFrame:
    """The weight table of all blocks, with their place in the path; a block that nothing precedes has no weights."""
    data = points_of(obs, k).withColumn("pos", F.lit(0).cast("long"))
    placed = targets.join(path, "block_id")
    every = F.explode(F.sequence(F.lit(1), F.lit(k.nvar)))
    drift = F.col("drift").cast("array<double>") if k.ndrift else F.array().cast("array<double>")
    nodes = placed.withColumn("var_id", every).select(F.lit(1).alias("kind"), F.col("var_id").cast("int"), F.col("block_id").cast("long").alias("src_id"), *(F.col(d).cast("double").alias(d) for d in k.dims), F.lit(0.0).alias("err"), drift.alias("drift"), F.lit(0.0).alias("value"), "pos")
    data = data.unionByName(nodes)
    return systems.solved(assembled(data, placed, k, order="pos"), k.model()).join(path, "block_id", "right")


def _roots(cov: np.ndarray) -> np.ndarray:
    """Cholesky factors (blocks, nvar, nvar); independent draws where the covariance has none."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        pass
    if len(cov) == 1:
        return np.sqrt(np.maximum(cov, 0.0)) * np.eye(cov.shape[1])
    half = len(cov) // 2
    return np.concatenate([_roots(cov[:half]), _roots(cov[half:])])


def one_hot(prob: np.ndarray, u: np.ndarray) -> np.ndarray:
    """(sims, categories): a category drawn by each u from clipped, normalised probabilities."""
    p = np.clip(prob, 0.0, 1.0)
    total = p.sum(1, keepdims=True)
    p = np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / p.shape[1])
    drawn = np.minimum((u[:, None] > np.cumsum(p, 1)).sum(1), p.shape[1] - 1)
    out = np.zeros_like(p)
    out[np.arange(len(u)), drawn] = 1.0
    return out


def _levels_inside(target: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """Levels of n rows in the order of the path; edges from earlier rows, in the order of their targets."""
    level = np.zeros(n, np.int64)
    for t, s in zip(target.tolist(), source.tolist()):
        if level[t] <= level[s]:
            level[t] = level[s] + 1
    return level


def _drawer(nvar: int, bounds, ncat: int, means: tuple[float, ...], unbiased: bool, prior: np.ndarray, given: bool):
    """For mapInPandas or applyInPandas over the blocks of one step: (block_id, var_id, g, v), arrays over realisations. Draws that
    are not ``given`` are uniform numbers."""
    low, high = (-np.inf if bounds[0] is None else bounds[0]), (np.inf if bounds[1] is None else bounds[1])
    mean = np.asarray(means, float) if len(means) else np.zeros(nvar)

    def draw(val: np.ndarray, cov: np.ndarray, eps: np.ndarray) -> np.ndarray:
        """``val`` (blocks, nvar, sims) with its draws (blocks, sims, draws) put in."""
        if ncat:
            b, _, w = val.shape
            drawn = one_hot(val[:, :ncat].transpose(0, 2, 1).reshape(b * w, ncat), eps[:, :, 0].ravel())
            val = np.concatenate([drawn.reshape(b, w, ncat).transpose(0, 2, 1), val[:, ncat:]], 1)
        else:
            val = val + np.einsum("bij,bsj->bis", _roots(cov), eps)
        return np.clip(val, low, high)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos", kind="stable", ignore_index=True)
        n = len(f)
        eps = np.array([np.stack(e) for e in f.eps], float).reshape(n, -1, nvar if not ncat else 1)
        if not given and not ncat:
            eps = inverse(eps)
        known = f.base.notna().to_numpy()
        base, cov = np.repeat(mean[None], n, 0), np.repeat(prior[None], n, 0)
        if known.any():
            base[known] = np.stack(f.base[known].to_numpy())
            cov[known] = np.stack(f.cov_at[known].to_numpy()).reshape(-1, nvar, nvar)
            if not unbiased:
                base[known] += (1 - np.stack(f.total[known].to_numpy())) * mean
        val = np.repeat(base[:, :, None], eps.shape[1], 2)
        some = f.outside.notna().to_numpy()
        if some.any():
            val[some] += np.stack(f.outside[some].to_numpy()).reshape(-1, nvar, eps.shape[1])
        edges = [(i, *e) for i, inner in enumerate(f.inner) if inner is not None for e in ((x["target_var"], x["var_id"], x["src_id"], x["w"]) for x in inner)]
        if not edges:
            val = draw(val, cov, eps)
        else:
            t, tv, sv, src, w = (np.array(c) for c in zip(*edges))
            place = {b: i for i, b in enumerate(f.block_id.tolist())}
            s = np.array([place[b] for b in src.tolist()])
            level = _levels_inside(t, s, n)
            at = level[t]
            for k in range(level.max() + 1):
                e, rows = np.flatnonzero(at == k), np.flatnonzero(level == k)
                np.add.at(val, (t[e], tv[e] - 1), w[e, None] * val[s[e], sv[e] - 1])
                val[rows] = draw(val[rows], cov[rows], eps[rows])
        out = {"block_id": np.repeat(f.block_id.to_numpy(), nvar), "var_id": np.tile(np.arange(1, nvar + 1, dtype=np.int32), n), "g": np.repeat(f.g.to_numpy(), nvar).astype(np.int32), "v": list(val.reshape(n * nvar, -1))}
        return pd.DataFrame(out)

    return run


def simulate(obs: DataFrame, targets: DataFrame, k: Kriging, nsim: int = 1, seed: int | None = 1, path: DataFrame | None = None, samples: DataFrame | None = None, back_to: dict | None = None, ncat: int = 0, weights: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """(block_id, var_id, sim_id, value): ``nsim`` realisations.

    ``path``: (block_id, pos); ``samples``: (block_id, eps), an array of nsim draws (for several variables, of nsim arrays),
    standard normal, or uniform in [0, 1] for categories. ``seed`` None or 0: another one each time. ``back_to``: a score
    table and tails by variable, for values that are normal scores; ``ncat``: variables that are indicators of categories,
    drawn as one of them. ``weights``: a table of an earlier run with the same path (``simulation_weights``), which is replayed.
    """
    if nsim < 1:
        raise ValueError("at least one realisation")
    spark, seed = targets.sparkSession, seed or secrets.randbits(62)
    path = stage(random_path(targets, seed) if path is None else checked_path(path, targets).select("block_id", "pos"))
    table = weights if weights is not None else simulation_weights(obs, targets, k, path)
    if samples is not None and ncat:
        outside = samples.where(F.exists("eps", lambda e: (e < 0) | (e > 1)))
        if not outside.isEmpty():
            raise ValueError("draws for categories have to lie in [0, 1]")
    data = points_of(obs, k).select(*SIDES, "value")
    rows = table.select("block_id", F.explode("weights").alias("e")).select("block_id", "e.*")
    known = rows.where("kind <> 1").join(data, list(SIDES), "left").groupBy("block_id", "target_var").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("s"))
    total = rows.where("kind < 2").groupBy("block_id", "target_var").agg(F.sum("w").alias("sw"))
    sums = total.join(known, ["block_id", "target_var"], "left").groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("target_var", F.coalesce("s", F.lit(0.0)).alias("s"), "sw"))).alias("t"))
    edges = stage(rows.where("kind = 1").select("block_id", "target_var", "var_id", "src_id", "w"))
    step_of, narrow = steps(path, edges, stretch)
    lean = table.select("block_id", F.transform("cov", lambda c: c["cov"]).alias("cov_at")).join(sums, "block_id", "left")
    lean = path.join(step_of, "block_id").join(lean, "block_id", "left").select("block_id", "pos", "step", "cov_at", F.col("t.s").alias("base"), F.col("t.sw").alias("total"))
    width = min(nsim, TOGETHER)
    if samples is not None:
        one = lambda e: e if samples.schema["eps"].dataType.elementType.simpleString().startswith("array") else F.array(e)
        lean = lean.join(samples.select("block_id", F.transform("eps", one).alias("eps")), "block_id")
    lean = _shelved(spark, "blocks", lean, ["step"])
    sources = step_of.select(F.col("block_id").alias("src_id"), F.col("step").alias("from"))
    placed = edges.join(step_of, "block_id").join(sources, "src_id")
    across = _shelved(spark, "edges", placed.where(F.col("from") < F.col("step")), ["from"])
    inside = placed.where(F.col("from") == F.col("step")).groupBy("block_id", "step").agg(F.collect_list(F.struct("target_var", "var_id", "src_id", "w")).alias("inner"))
    inside = _shelved(spark, "inside", inside, ["step"])
    waiting = Shelf(spark, "waiting", "block_id long, target_var int, g int, s array<double>, step int", ["step"])
    drawn = Shelf(spark, "drawn", "block_id long, var_id int, g int, v array<double>, at int", ["at"])
    model = k.model()
    prior = np.array([[model.between(i, j).at_zero() for j in range(1, k.nvar + 1)] for i in range(1, k.nvar + 1)])
    run = _drawer(k.nvar, k.bounds, ncat, tuple(k.means), k.unbiased, prior, samples is not None)
    groups = -(-nsim // width)
    sims = F.sequence(F.col("g") * width + 1, F.least((F.col("g") + 1) * width, F.lit(nsim)))
    made = F.transform(sims, lambda s: F.array(*(uniform(seed, s, F.lit(v), F.col("block_id")) for v in range(1, 2 if ncat else k.nvar + 1))))
    given = F.slice("eps", F.col("g") * width + 1, F.lit(width))
    plus = lambda i: F.sum(F.col("w") * F.get("v", F.lit(i)))
    for step, alone in enumerate(narrow):
        frame = lean.where(F.col("step") == step).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        frame = frame.withColumn("eps", given if samples is not None else made)
        sent = waiting.table().where(F.col("step") == step).groupBy("block_id", "g", "target_var").agg(*(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)))
        sent = sent.groupBy("block_id", "g").agg(F.collect_list(F.struct("target_var", F.array(*(f"s{i}" for i in range(width))).alias("s"))).alias("all"))
        frame = frame.join(sent, ["block_id", "g"], "left").join(inside.where(F.col("step") == step).select("block_id", "inner"), "block_id", "left")
        # a block's sums: variables one after another, each over the realisations of the group
        every = F.transform(F.sequence(F.lit(1), F.lit(k.nvar)), lambda v: F.slice(F.coalesce(F.get(F.transform(F.filter("all", lambda x: x["target_var"] == v), lambda x: x["s"]), F.lit(0)), F.array_repeat(F.lit(0.0), width)), F.lit(1), F.size("eps")))
        frame = frame.select("block_id", "pos", "g", "base", "total", "cov_at", "eps", F.when(F.col("all").isNotNull(), F.flatten(every)).alias("outside"), "inner")
        schema = "block_id long, var_id int, g int, v array<double>"
        done = frame.groupBy("g").applyInPandas(run, schema) if alone else frame.mapInPandas(lambda frames: (run(part) for f in frames for _, part in f.groupby("g")), schema)
        drawn.add(done.withColumn("at", F.lit(step)))
        if step < len(narrow) - 1:
            values = drawn.table().where(F.col("at") == step).withColumnRenamed("block_id", "src_id")
            moved = across.where(F.col("from") == step).join(values, ["src_id", "var_id"]).groupBy("block_id", "step", "target_var", "g")
            waiting.add(moved.agg(*(plus(i).alias(f"s{i}") for i in range(width))).select("block_id", "target_var", "g", F.array(*(f"s{i}" for i in range(width))).alias("s"), "step"))
    out = drawn.table().select("block_id", "var_id", (F.col("g") * width).alias("first"), F.posexplode("v").alias("i", "value"))
    out = out.select("block_id", "var_id", (F.col("first") + F.col("i") + 1).cast("int").alias("sim_id"), "value")
    for var, (scored, tails) in (back_to or {}).items():
        mine = back(out.where(F.col("var_id") == var).withColumnRenamed("value", "score"), scored, tails).drop("score")
        out = out.where(F.col("var_id") != var).unionByName(mine.select(*out.columns))
    return out


def _shelved(spark, name: str, df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` written once, so that each step reads its own part."""
    rest = [f for f in df.schema if f.name not in by]
    shelf = Shelf(spark, name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rest, *(df.schema[c] for c in by)]), by)
    shelf.add(df)
    return shelf.table()


def simulation_weights(obs: DataFrame, targets: DataFrame, k: Kriging, path: DataFrame) -> DataFrame:
    """The weight table of a simulation along ``path``, to be stored and replayed."""
    return stage(_weights(obs, targets, k, path))


def summaries(simulated: DataFrame) -> DataFrame:
    """(block_id, var_id, mean, sd, p10, p50, p90) over the realisations, exact percentiles."""
    at = lambda p: F.percentile("value", F.lit(p))
    return simulated.groupBy("block_id", "var_id").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def wide(simulated: DataFrame, targets: DataFrame, k: Kriging, nsim: int) -> DataFrame:
    """One row a target: coordinates and sim_1.., or v1_s1.. for several variables."""
    name = lambda v, s: f"sim_{s}" if k.nvar == 1 else f"v{v}_s{s}"
    each = [F.max(F.when((F.col("var_id") == v) & (F.col("sim_id") == s), F.col("value"))).alias(name(v, s)) for v in range(1, k.nvar + 1) for s in range(1, nsim + 1)]
    return targets.select("block_id", *k.dims).join(simulated.groupBy("block_id").agg(*each), "block_id", "left")


def score_simulation(obs: DataFrame, targets: DataFrame, k: Kriging, tails: Tails, nsim: int = 1, seed: int | None = 1, weight: str | None = None, **kwargs) -> DataFrame:
    """Simulation of one variable in normal scores: forward by the observations' own distribution, and back with tails."""
    table = stage(score_table(obs, "value", weight))
    scored = scores(obs, table).withColumn("value", F.col("score")).drop("score")
    return simulate(scored, targets, k, nsim, seed, back_to={1: (table, tails)}, **kwargs)


def indicator_simulation(obs: DataFrame, targets: DataFrame, k: Kriging, labels: list, nsim: int = 1, seed: int | None = 1, column: str = "category", **kwargs) -> DataFrame:
    """(block_id, sim_id, category): sequential indicator simulation."""
    from .indicator import indicators

    out = simulate(indicators(obs, labels, column), targets, k, nsim, seed, ncat=len(labels), **kwargs)
    of = F.element_at(F.array(*(F.lit(v) for v in labels)), F.col("var_id"))
    return out.where((F.col("value") == 1.0) & (F.col("var_id") <= len(labels))).select("block_id", "sim_id", of.alias(column))


def bounded(values: DataFrame, bounds: tuple[float | None, float | None]) -> DataFrame:
    return values.withColumn("value", clipped(F.col("value"), bounds))
