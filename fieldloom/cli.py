"""Command line: a configuration file (JSON, or a namelist of groups) and options that replace its entries."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normal import Tails
from .functions.variogram import Structure, Variogram
from .operators import kriging, simulation, targets
from .operators.neighbours import Search
from .operators.staging import prefix_sums
from .sources import tables

#: Options that take a value, with their type, and switches.
VALUES = {"obs": str, "grid": str, "output": str, "dims": str, "columns": str, "nmax": int, "maxdist": float, "ratio1": float, "ratio2": float, "azimuth": float, "dip": float, "plunge": float, "vgm": str, "mean": float, "ndrift": int, "nsim": int, "seed": int, "zmin": float, "zmax": float, "ltail": str, "utail": str, "ltpar": float, "utpar": float, "low": float, "high": float, "block": str, "weights_out": str, "weights_in": str, "obs2": str, "vgm2": str, "vgmc": str, "nmax2": int, "maxdist2": float, "mean2": float, "path": str, "samples": str, "nodes": str, "rangescale": str, "localnugget": str}
SWITCHES = ("simple", "cross_validation", "sectors", "positive_weights", "neglect_error", "nscore", "values_only", "node_weights", "obserror", "standard")
#: Entries of a namelist's six groups (fixed values), and the options that they stand for; None: sizes, which are read from the
#: files, and settings of a program's own run.
GROUPS = {
    "input_output": {"obsfile1": "obs", "obsfile2": "obs2", "gridfile": "nodes", "facfile": "weights_out", "blockfile": "grid", "randpath": "path", "samfile": "samples", "rsfile": "rangescale", "lnfile": "localnugget", "fomt": None, "outfile": "output"},
    "dims": {"ndim": "dims", "ndrift": "ndrift", "nobs1": None, "nobs2": None, "ngrid": None, "nblock": None, "nsim": "nsim"},
    "krige_opt": {"nmax1": "nmax", "nmax2": "nmax2", "unbias": "simple", "maxdist1": "maxdist", "maxdist2": "maxdist2", "sk_mean": "mean", "vmin": "low", "vmax": "high", "block_type": None, "blocksize": "block", "seed": "seed", "nthread": None},
    "variograms": {"vgm_spec1": "vgm", "vgm_spec2": "vgm2", "vgm_specc": "vgmc"},
    "anisotropy": {"ang1": "azimuth", "ang2": "dip", "ang3": "plunge", "anis1": "ratio1", "anis2": "ratio2"},
    "flags": {"correct_weight": "positive_weights", "writexy": "values_only", "neglect_error": "neglect_error", "writemat": None, "showargs": None, "loocv": "cross_validation", "anisotropic_search": None, "verbose": None, "blockpntweight": "node_weights", "obserror": "obserror"},
}
ENTRIES = {entry: option for group in GROUPS.values() for entry, option in group.items()}
#: Bounds and distances of this size or more are none, and so are empty names.
LARGE = 1e30


def read_namelist(text: str) -> dict:
    """Entries of all groups ``&name key = value, ... /``: numbers, logicals, quoted strings; lists where several follow."""
    out: dict = {}
    text = re.sub(r"!.*", "", text)
    for group in re.findall(r"&\w+(.*?)^\s*/", text, re.S | re.M):
        for key, value in re.findall(r"(\w+)\s*=\s*(.*?)(?=\s*\w+\s*=|\Z)", group, re.S):
            items = re.findall(r"'[^']*'|\"[^\"]*\"|[^\s,]+", value)
            parsed = [_scalar(i) for i in items]
            out[key.lower()] = parsed[0] if len(parsed) == 1 else parsed
    return out


def translated(given: dict) -> dict:
    """Entries under the groups' names as options; entries that are options already stay."""
    out: dict = {}
    for key, value in given.items():
        if key not in ENTRIES or key in VALUES and ENTRIES[key] in (None, key):
            out[key] = value
            continue
        option = ENTRIES[key]
        if option is None or value in ("", "~") or isinstance(value, float) and abs(value) >= LARGE or option in ("nmax", "nmax2") and not value:
            continue
        if option == "dims":
            value = ",".join("xyz"[: int(value)])
        elif option in ("vgm", "vgm2", "vgmc"):
            # model, range, sill, nugget: each structure a text of its own
            specs = [v.split() for v in (value if isinstance(value, list) else [value]) if v.strip()]
            value = ";".join(f"{m},{nugget},{sill},{reach}" for m, reach, sill, nugget in specs)
        elif option == "block":
            sizes = value if isinstance(value, list) else [value]
            if not any(sizes):
                continue
            value = ",".join(map(str, sizes))
        elif option in ("simple", "values_only"):
            value = not value
        out[option] = value
    return out


def _scalar(text: str):
    if text[0] in "'\"":
        return text[1:-1]
    if text.lower().strip(".") in ("true", "t", "false", "f"):
        return text.lower().strip(".") in ("true", "t")
    number = re.sub("[dD]", "e", text)
    try:
        return int(number)
    except ValueError:
        try:
            return float(number)
        except ValueError:
            return text


def structures(spec: str) -> Variogram:
    """``model,nugget,sill,major[,minor1,minor2,azimuth,dip,plunge]`` by semicolons; a leading ``*`` multiplies."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        f = [x.strip() for x in part.lstrip("*").split(",")]
        n = [float(x) for x in f[1:]]
        if len(n) < 3:
            raise ValueError(f"a structure needs a nugget, a sill and a range: {part!r}")
        minor1, minor2 = (n[3] if len(n) > 3 else None), (n[4] if len(n) > 4 else None)
        out.append(Structure(f[0], n[1], n[2], n[0], minor1, minor2, *(n[5:8] + [0.0] * (3 - len(n[5:8]))), part.startswith("*")))
    return Variogram(tuple(out))


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="fieldloom", description="Kriging and simulation of scattered data")
    p.add_argument("--config")
    for name, kind in VALUES.items():
        p.add_argument("--" + name.replace("_", "-"), type=kind)
    for name in SWITCHES:
        p.add_argument("--" + name.replace("_", "-"), action="store_true", default=None)
    args = p.parse_args(argv)
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            text = f.read()
        given = json.loads(text) if text.lstrip().startswith("{") else read_namelist(text)
        given = translated(given)
        unknown = set(given) - set(VALUES) - set(SWITCHES)
        if unknown:
            p.error(f"unknown entries in {args.config}: {', '.join(sorted(unknown))}")
        for k, v in given.items():
            if getattr(args, k) is None:
                setattr(args, k, VALUES[k](v) if k in VALUES and not isinstance(v, list) else v)
    for needed in ("obs", "vgm", "output"):
        if getattr(args, needed) is None:
            p.error(f"--{needed} is needed")
    if args.grid is None and not args.cross_validation:
        p.error("--grid is needed unless the data are cross-validated")
    return args


def configuration(a: argparse.Namespace) -> kriging.Kriging:
    dims = tuple((a.dims or "x,y").split(","))
    turned = (a.ratio1 or 1.0, a.ratio2 or 1.0, a.azimuth or 0.0, a.dip or 0.0, a.plunge or 0.0, bool(a.sectors))
    search, vgm, nvar, means = Search(a.nmax or 16, a.maxdist, *turned), structures(a.vgm), 1, (a.mean or 0.0,)
    if a.obs2:
        if not (a.vgm2 and a.vgmc):
            raise ValueError("a second variable needs --vgm2 and --vgmc")
        search = {1: search, 2: Search(a.nmax2 or a.nmax or 16, a.maxdist2, *turned)}
        vgm, nvar, means = {(1, 1): vgm, (2, 2): structures(a.vgm2), (1, 2): structures(a.vgmc)}, 2, (a.mean or 0.0, a.mean2 or 0.0)
    return kriging.Kriging(vgm, dims, search, nvar, unbiased=not a.simple, standard=bool(a.standard), means=means if a.simple else (), bounds=(a.low, a.high), positive_weights=bool(a.positive_weights), neglect_errors=bool(a.neglect_error), cross_validation=bool(a.cross_validation), ndrift=a.ndrift or 0, check_places=True)


def _observations(spark: SparkSession, a: argparse.Namespace, k: kriging.Kriging, extra: list[str]) -> DataFrame:
    """Both variables' files: id, coordinates, value[, error variance][, drifts]."""
    columns = a.columns.split(",") if a.columns else [*k.dims, "value", *(["err_var"] if a.obserror else []), *extra]
    first = tables.read_points(spark, a.obs, columns)
    if not a.obs2:
        return first
    second = tables.read_points(spark, a.obs2, [*k.dims, "value", *extra])
    return first.withColumn("var_id", F.lit(1)).unionByName(second.withColumn("var_id", F.lit(2)), allowMissingColumns=True)


def _ranked(df: DataFrame) -> DataFrame:
    """With ``place``, from 1 by block_id."""
    return df.join(simulation.ordered_path(df, ["block_id"]).withColumnRenamed("pos", "place"), "block_id")


def _blocks(spark: SparkSession, a: argparse.Namespace, k: kriging.Kriging, extra: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Blocks, and their nodes: from a file whose rows belong to the blocks in turn, as many as a block's last column says."""
    columns = [*k.dims, *extra, *(["points"] if a.nodes else [])]
    grid = tables.read_points(spark, a.grid, columns, "block_id")
    for name in ("rangescale", "localnugget"):
        if getattr(a, name):
            grid = _ranked(grid).join(tables.read_values(spark, getattr(a, name), name), "place", "left").drop("place")
    if a.block:
        return grid, targets.quadrature_nodes(grid, [float(s) for s in a.block.split(",")], list(k.dims))
    if not a.nodes:
        return grid, None
    rows = tables.read_points(spark, a.nodes, [*k.dims, *(["weight"] if a.node_weights else [])], "node_id")
    numbered = rows.join(simulation.ordered_path(rows.withColumnRenamed("node_id", "block_id"), ["block_id"]).toDF("node_id", "row"), "node_id")
    counted = prefix_sums(grid.select("block_id", F.col("points").cast("long").alias("points")), ["block_id"], "points")
    owned = counted.where("points > 0").select("block_id", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("points"))).alias("row"))
    return grid.drop("points"), owned.join(numbered, "row").drop("row")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result, also written to ``--output`` as comma-separated values."""
    k = configuration(a)
    extra = [f"drift{i}" for i in range(1, k.ndrift + 1)]
    obs, nodes = _observations(spark, a, k, extra), None
    if k.cross_validation:
        grid = (obs.where("var_id = 1") if a.obs2 else obs).withColumnRenamed("obs_id", "block_id").drop("value", "var_id")
    else:
        grid, nodes = _blocks(spark, a, k, extra)
    if k.ndrift:
        obs, grid = (d.withColumn("drift", F.array(*extra)) for d in (obs, grid))
    if a.nsim:
        tails = Tails(a.zmin, a.zmax, a.ltail or "linear", a.utail or "linear", a.ltpar or 1.0, a.utpar or 1.0)
        given: dict = {}
        if a.path:  # the blocks in the order of their visits
            given["path"] = _ranked(grid).join(tables.read_values(spark, a.path, "at").select(F.col("place").alias("pos"), F.col("at").cast("long").alias("place")), "place").select("block_id", "pos")
        if a.samples:  # all realisations of a block, one block after another
            draws = tables.read_values(spark, a.samples, "eps").withColumn("block", F.floor((F.col("place") - 1) / a.nsim) + 1)
            each = draws.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "eps"))).alias("e")).select(F.col("block").alias("place"), F.col("e.eps").alias("eps"))
            given["samples"] = _ranked(grid).join(each, "place").select("block_id", "eps")
        seed = 1 if a.seed is None else a.seed
        long = simulation.score_simulation(obs, grid, k, tails, a.nsim, seed, **given) if a.nscore else simulation.simulate(obs, grid, k, a.nsim, seed, **given)
        out = simulation.wide(long, grid, k, a.nsim)
        names = out.columns[1 + len(k.dims) :]
    else:
        table = tables.read_weights(spark, a.weights_in, k, obs) if a.weights_in else kriging.solve(obs, grid, k, nodes)
        if a.weights_out:
            tables.write_weights(table, a.weights_out, k, obs)
            table = tables.read_weights(spark, a.weights_out, k)
        out = kriging.wide(kriging.apply(table, obs, k, grid), grid, k)
        names = out.columns[1 + len(k.dims) :]
        if k.cross_validation:
            first = obs.where("var_id = 1") if a.obs2 else obs
            out = out.join(first.select(F.col("obs_id").alias("block_id"), F.col("value").alias("observed")), "block_id")
            names = ["observed", *names]
    out = out.select(*(names if a.values_only else ["block_id", *k.dims, *names]))
    tables.write_points(out, a.output)
    return out


def main(argv: list[str] | None = None) -> None:
    args = options(sys.argv[1:] if argv is None else argv)
    run(SparkSession.builder.appName("fieldloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
