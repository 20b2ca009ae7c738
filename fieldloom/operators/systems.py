"""Kriging systems in Arrow batches: systems of equal shape are stacked and solved together.

Data of a block are observations, simulated nodes, and gradient pairs (a difference between two places). Rows are dealt
by ranges of a key of their neighbours, so that blocks with the same neighbours meet and share one factor, and a
neighbourhood that very many blocks have is still split. A factor is the Cholesky factor of the covariances between data,
and the Schur complement of the constraints; what has none is eliminated as a whole. Everything is double precision.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variogram import StackedVariogram, Structure, model_name

#: Kinds of data by number, and systems that are stacked together at most.
KINDS = ("obs", "sim", "grad")
STACK = 1024
SOLVED = "block_id long, factor long, status string, reused boolean, weights array<struct<target_var:int,kind:int,var_id:int,src_id:long,w:double>>, cov array<struct<ivar:int,jvar:int,cov:double>>"


@dataclass(frozen=True)
class Gradients:
    """Pairs of places with a known difference of one variable: Z(first) - Z(second)."""

    var: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    second: np.ndarray
    variance: np.ndarray
    drift: np.ndarray


@dataclass(frozen=True)
class Model:
    """What a system is built from. ``vgm``: models by pair of variables (i <= j), variables from 1."""

    vgm: dict
    ndim: int
    nvar: int = 1
    unbiased: bool = True
    standard: bool = False
    ndrift: int = 0
    means: tuple[float, ...] = ()
    positive_weights: bool = False
    bounds: tuple[float | None, float | None] = (None, None)
    neglect_errors: bool = True
    varying: bool = False
    gradients: Gradients | None = None
    checked: bool = field(default=False, compare=False)

    def __post_init__(self):
        for i in range(1, self.nvar + 1):
            for j in range(i, self.nvar + 1):
                if not self.varying and (i, j) not in self.vgm:
                    raise ValueError(f"no variogram for variables {i} and {j}")
        for v in self.vgm.values():
            if not isinstance(v, StackedVariogram):
                v.check(self.ndim)
        if self.means and len(self.means) != self.nvar:
            raise ValueError("one mean for each variable")
        low, high = self.bounds
        if low is not None and high is not None and low > high:
            raise ValueError("bounds must not cross")

    def between(self, i: int, j: int):
        return self.vgm[min(i, j), max(i, j)]

    def rows(self, which: np.ndarray) -> Model:
        """The model of some of a stack's systems, where each has its own."""
        if not any(isinstance(v, StackedVariogram) for v in self.vgm.values()):
            return self
        return replace(self, vgm={p: v.take(which) if isinstance(v, StackedVariogram) else v for p, v in self.vgm.items()})

    def constraints(self) -> int:
        """Rows of unbiasedness: one a variable, or one for all in the sum-to-one form."""
        if not self.unbiased:
            return 0
        return self.nvar if self.standard else 1

    def indicator(self, var: int) -> np.ndarray:
        one = np.zeros(self.constraints())
        if len(one):
            one[var - 1 if self.standard else 0] = 1.0
        return one


def _lags(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(blocks, rows of a, rows of b, ndim)"""
    return (a[:, :, None, :] - b[:, None, :, :]) / scale[:, None, None, None]


def _pairs(model: Model, va: np.ndarray, vb: np.ndarray, lags: np.ndarray) -> np.ndarray:
    out = np.empty(lags.shape[:3])
    for i in np.unique(va):
        for j in np.unique(vb):
            rows, cols = np.flatnonzero(va == i), np.flatnonzero(vb == j)
            out[:, rows[:, None], cols] = model.between(int(i), int(j)).covariance(lags[:, rows[:, None], cols])
    return out


def matrices(model: Model, kind, var, x, err, drift, scale, nugget) -> np.ndarray:
    """Left sides of blocks of one shape. kind, var: (n); x: (b, n, ndim); err: (b, n); drift: (b, n, ndrift)."""
    b, n = err.shape
    g = model.gradients
    ng = 0 if g is None else len(g.var)
    q = model.ndrift + model.constraints()
    a = np.zeros((b, n + ng + q, n + ng + q))
    a[:, :n, :n] = _pairs(model, var, var, _lags(x, x, scale))
    zero = np.stack([np.broadcast_to(model.between(int(v), int(v)).at_zero(), b) for v in var], 1)
    at = np.arange(n)
    a[:, at, at] = zero + np.where(kind == 1, 0.0, err) + nugget[:, None]
    if ng:
        p, s = (np.broadcast_to(w, (b, *w.shape)) for w in (g.first, g.second))
        cross = _pairs(model, var, g.var, _lags(x, p, scale)) - _pairs(model, var, g.var, _lags(x, s, scale))
        a[:, :n, n : n + ng] = cross
        a[:, n : n + ng, :n] = cross.transpose(0, 2, 1)
        own = sum(sign * _pairs(model, g.var, g.var, _lags(u, v, scale)) for sign, u, v in ((1, p, p), (-1, p, s), (-1, s, p), (1, s, s)))
        a[:, n : n + ng, n : n + ng] = np.where(g.var[:, None] == g.var, own, 0.0) + np.diag(g.variance)
    if q:
        f = np.concatenate([drift, np.broadcast_to([model.indicator(int(v)) for v in var], (b, n, model.constraints()))], 2)
        if ng:
            f = np.concatenate([f, np.broadcast_to(np.hstack([g.drift, np.zeros((ng, model.constraints()))]), (b, ng, q))], 1)
        a[:, : n + ng, n + ng :] = f
        a[:, n + ng :, : n + ng] = f.transpose(0, 2, 1)
    return a


def right_sides(model: Model, var, x, nodes, node_w, tdrift, scale) -> np.ndarray:
    """(b, rows, nvar). nodes: (b, p, ndim); tdrift: (b, nvar, ndrift)."""
    b, n = x.shape[:2]
    g, out = model.gradients, []
    for target in range(1, model.nvar + 1):
        t = np.full(nodes.shape[1], target)
        parts = [(_pairs(model, var, t, _lags(x, nodes, scale)) * node_w[:, None]).sum(2)]
        if g is not None:
            for_pair = [(_pairs(model, g.var, t, _lags(np.broadcast_to(w, (b, *w.shape)), nodes, scale)) * node_w[:, None]).sum(2) for w in (g.first, g.second)]
            parts.append(for_pair[0] - for_pair[1])
        parts += [tdrift[:, target - 1], np.broadcast_to(model.indicator(target), (b, model.constraints()))]
        out.append(np.concatenate(parts, 1))
    return np.stack(out, 2)


def prior(model: Model, nodes: np.ndarray, node_w: np.ndarray) -> np.ndarray:
    """(b, nvar, nvar): covariance of the targets with each other before any data."""
    b, p = node_w.shape
    out = np.empty((b, model.nvar, model.nvar))
    lags = _lags(nodes, nodes, np.ones(b)) if p > 1 else None
    for i in range(1, model.nvar + 1):
        for j in range(i, model.nvar + 1):
            v = model.between(i, j)
            if p == 1:
                c = np.broadcast_to(v.at_zero(), b)
            else:
                c = (v.covariance(lags) * node_w[:, :, None] * node_w[:, None, :]).sum((1, 2))
            out[:, i - 1, j - 1] = out[:, j - 1, i - 1] = c
    return out


def _solve_one(a: np.ndarray, rhs: np.ndarray, n: int) -> tuple[np.ndarray, str]:
    """A single system that the stacked solve refused: as it is, then with a jitter on the data's diagonal."""
    for status in ("ok", "jitter"):
        if status == "jitter":
            a = a.copy()
            at = np.arange(n)
            a[at, at] += 1e-6 * a[at, at].mean() if n else 0.0
        try:
            s = np.linalg.solve(a, rhs)
            if np.isfinite(s).all() and np.linalg.cond(a) < 1e14:
                return s, status
        except np.linalg.LinAlgError:
            continue
    return np.full(rhs.shape, np.nan), "fail"


def factored(a: np.ndarray, n: int, shared: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of left sides (b, m, m) whose first n rows are data: the inverse of the Cholesky factor L of their covariances,
    Y = L^-1 F of the constraints F, and their Schur complement F' K^-1 F. LinAlgError where one has no such factor.

    ``shared``: data at the beginning whose covariances are the same in all of the stack: their block is factored once, and of
    each system just its Schur complement."""
    k = a[:, :n, :n]
    if shared and n > shared:
        top = np.linalg.inv(np.linalg.cholesky(k[0, :shared, :shared]))
        t = top @ k[:, :shared, shared:]
        own = np.linalg.inv(np.linalg.cholesky(k[:, shared:, shared:] - t.transpose(0, 2, 1) @ t))
        inverse = np.zeros(k.shape)
        inverse[:, :shared, :shared], inverse[:, shared:, shared:] = top, own
        inverse[:, shared:, :shared] = -own @ t.transpose(0, 2, 1) @ top
    else:
        inverse = np.linalg.inv(np.linalg.cholesky(k))
    y = inverse @ a[:, :n, n:]
    return inverse, y, y.transpose(0, 2, 1) @ y


def by_factors(a: np.ndarray, which: np.ndarray, rhs: np.ndarray, n: int, pairs: int = 0) -> np.ndarray:
    """Solutions of ``a[which] x = rhs``, each left side factored once: per right side two products with its factor are left.
    ``pairs``: how many of the n data, the last ones, are the same pairs of places in all systems; they are put first."""
    if pairs and n > pairs and (a[:, n - pairs : n, n - pairs : n] == a[:1, n - pairs : n, n - pairs : n]).all():
        order = np.concatenate([np.arange(n - pairs, n), np.arange(n - pairs), np.arange(n, a.shape[1])])
        out = np.empty(rhs.shape)
        out[:, order] = _by_factors(a[:, order[:, None], order], which, rhs[:, order], n, pairs)
        return out
    return _by_factors(a, which, rhs, n, 0)


def _by_factors(a: np.ndarray, which: np.ndarray, rhs: np.ndarray, n: int, shared: int) -> np.ndarray:
    inverse, y, schur = factored(a, n, shared)
    v = inverse[which] @ rhs[:, :n]
    if a.shape[1] == n:
        return inverse.transpose(0, 2, 1)[which] @ v
    multipliers = np.linalg.solve(schur[which], y.transpose(0, 2, 1)[which] @ v - rhs[:, n:])
    return np.concatenate([inverse.transpose(0, 2, 1)[which] @ (v - y[which] @ multipliers), multipliers], 1)


def solve_stack(a: np.ndarray, which: np.ndarray, rhs: np.ndarray, n: int, pairs: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of ``a[which] x = rhs`` and their status. A stack that has no factors is halved until the one that has none is
    alone; that one is eliminated as it is."""
    status = np.full(len(which), "ok", object)
    try:
        x = by_factors(a, which, rhs, n, pairs)
    except np.linalg.LinAlgError:
        if len(a) > 1:
            x, half = np.empty(rhs.shape), len(a) // 2
            for rows, part, first in ((which < half, a[:half], 0), (which >= half, a[half:], half)):
                x[rows], status[rows] = solve_stack(part, which[rows] - first, rhs[rows], n, pairs)
            return x, status
        try:
            x = np.linalg.solve(np.repeat(a, len(which), 0), rhs)
        except np.linalg.LinAlgError:
            x = np.full(rhs.shape, np.nan)
    left = np.abs(a[which] @ x - rhs).max((1, 2)) if rhs.size else np.zeros(len(which))
    size = np.abs(rhs).max((1, 2)) if rhs.size else left
    for k in np.flatnonzero(~np.isfinite(x).all((1, 2)) | (left > 1e-6 * (1 + size))):
        x[k], status[k] = _solve_one(a[which[k]], rhs[k], n)
    return x, status


def conditional(model: Model, x: np.ndarray, rhs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Prior less explained covariance, whole vectors with multipliers; nothing below zero."""
    out = start - np.einsum("bmi,bmj->bij", x, rhs)
    upper = np.triu(np.ones(out.shape[1:], bool))
    out = np.where(upper, out, out.transpose(0, 2, 1))
    return np.where(np.isnan(out), out, np.maximum(out, 0.0))


def positive(w: np.ndarray) -> np.ndarray:
    """Weights below zero become zero, and the rest sum to one again."""
    w = np.maximum(w, 0.0)
    total = w.sum(-1, keepdims=True)
    return np.divide(w, total, out=w.copy(), where=total > 0)


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _offsets(array) -> np.ndarray:
    return np.asarray(array.offsets) - np.asarray(array.offsets)[0] if len(array) else np.zeros(1, np.int64)


def _matrix(array, width: int) -> np.ndarray:
    """A list column of fixed width as rows of doubles."""
    return np.asarray(array.flatten(), float).reshape(len(array), width) if width else np.zeros((len(array), 0))


def solver(model: Model, estimates: bool = False):
    """For mapInArrow over rows of ``assembled``; with ``estimates`` its data have values, which the weights are applied to at once."""

    def one_shape(m: Model, rows: np.ndarray, data: dict) -> pa.RecordBatch:
        first = data["near_at"][rows]
        n = int(data["near_n"][rows[0]])
        idx = first[:, None] + np.arange(n)
        kind, var = data["kind"][idx[0]], data["var"][idx[0]]
        x, err, drift = data["x"][idx], data["err"][idx], data["drift"][idx]
        p = int(data["node_n"][rows[0]])
        node = data["node_at"][rows][:, None] + np.arange(p)
        nodes, node_w = data["node_x"][node], data["node_w"][node]
        scale, nugget, ids = data["scale"][rows], data["nugget"][rows], data["src"][idx]
        # equal neighbours, scale and nugget: one left side
        factor = data["factor"][rows]
        key = np.concatenate([ids, scale.view(np.int64)[:, None], nugget.view(np.int64)[:, None], factor[:, None]], 1)
        _, some, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        a = matrices(m.rows(some), kind, var, x[some], err[some], drift[some], scale[some], nugget[some])
        rhs = right_sides(m, var, x, nodes, node_w, data["tdrift"][rows], scale)
        pairs = 0 if m.gradients is None else len(m.gradients.var)
        s, status = solve_stack(a, which, rhs, n + pairs, pairs)
        if not m.neglect_errors and (status == "fail").any():
            raise RuntimeError(f"singular system at block {data['block'][rows[np.flatnonzero(status == 'fail')[0]]]}")
        if m.positive_weights and m.nvar == 1:
            s[:, :n, 0] = positive(s[:, :n, 0])
        cov = conditional(m, s, rhs, prior(m, nodes, node_w))
        again = np.ones(len(rows), bool)
        again[np.unique(which, return_index=True)[1]] = False
        g, b, v = m.gradients, len(rows), m.nvar
        if estimates:
            made, variance = _applied(m, var, s[:, :n], data["value"][idx]).ravel(), np.einsum("bii->bi", cov).ravel()
            target = np.tile(np.arange(1, v + 1, dtype=np.int32), b)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(data["block"][rows].astype(np.int64), v)), pa.array(target), pa.array(made, mask=np.isnan(made)), pa.array(variance, mask=np.isnan(variance))], names=["block_id", "var_id", "estimate", "variance"])
        if g is not None:
            kind, var = np.append(kind, np.full(len(g.var), 2)), np.append(var, g.var)
            ids = np.hstack([ids, np.broadcast_to(g.ids, (b, len(g.ids)))])
        d = len(kind)
        many = lambda x: np.broadcast_to(x, (b, v, d)).ravel()  # noqa: E731  entries by block, target variable, datum
        target = np.arange(1, v + 1, dtype=np.int32)
        entries = [pa.array(many(target[None, :, None])), pa.array(many(kind.astype(np.int32))), pa.array(many(var.astype(np.int32))), pa.array(many(ids[:, None, :])), pa.array(s[:, :d].transpose(0, 2, 1).ravel())]
        weights = pa.ListArray.from_arrays(pa.array(np.arange(b + 1, dtype=np.int32) * v * d), pa.StructArray.from_arrays(entries, ["target_var", "kind", "var_id", "src_id", "w"]))
        i, j = np.broadcast_to(target[:, None], (b, v, v)).ravel(), np.broadcast_to(target, (b, v, v)).ravel()
        covs = pa.ListArray.from_arrays(pa.array(np.arange(b + 1, dtype=np.int32) * v * v), pa.StructArray.from_arrays([pa.array(i), pa.array(j), pa.array(cov.ravel())], ["ivar", "jvar", "cov"]))
        return pa.RecordBatch.from_arrays([pa.array(data["block"][rows].astype(np.int64)), pa.array(factor), pa.array(status.tolist(), pa.string()), pa.array(again), weights, covs], names=["block_id", "factor", "status", "reused", "weights", "cov"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near, nodes = _column(batch, "near"), _column(batch, "nodes")
            near_o, node_o = _offsets(near), _offsets(nodes)
            nv, pv = near.flatten(), nodes.flatten()
            data = {
                "block": np.asarray(_column(batch, "block_id")), "factor": np.asarray(_column(batch, "factor")), "near_at": near_o[:-1], "near_n": np.diff(near_o), "node_at": node_o[:-1], "node_n": np.diff(node_o),
                "kind": np.asarray(nv.field("kind")), "var": np.asarray(nv.field("var_id")), "src": np.asarray(nv.field("src_id")).astype(np.int64),
                "x": _matrix(nv.field("x"), model.ndim), "err": np.asarray(nv.field("err"), float), "drift": _matrix(nv.field("drift"), model.ndrift),
                "node_x": _matrix(pv.field("x"), model.ndim), "node_w": np.asarray(pv.field("w"), float),
                "scale": np.asarray(_column(batch, "rangescale"), float), "nugget": np.asarray(_column(batch, "localnugget"), float),
                "tdrift": _matrix(_column(batch, "tdrift"), model.nvar * model.ndrift).reshape(batch.num_rows, model.nvar, model.ndrift),
            }
            if estimates:
                data["value"] = np.asarray(nv.field("value"), float)
            own = _column(batch, "vgm").to_pylist() if model.varying else None
            shapes: dict = {}
            for r in range(batch.num_rows):
                a, b = near_o[r], near_o[r + 1]
                shape = (data["kind"][a:b].tobytes(), data["var"][a:b].tobytes(), int(data["node_n"][r]), _kinds(own[r]) if model.varying else None)
                shapes.setdefault(shape, []).append(r)
            for shape, rows in shapes.items():
                for at in range(0, len(rows), STACK):
                    some = rows[at : at + STACK]
                    yield one_shape(_replaced(model, [own[r] for r in some]) if model.varying else model, np.array(some), data)

    return run


def _ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (min(r["ivar"], r["jvar"]), max(r["ivar"], r["jvar"]), r["struct_idx"]))


def _kinds(rows: list[dict]) -> tuple:
    """What has to be equal for the models of two blocks to be stacked."""
    return tuple((min(r["ivar"], r["jvar"]), max(r["ivar"], r["jvar"]), model_name(r["vtype"]), r["is_product"]) for r in _ordered(rows))


def _replaced(model: Model, blocks: list[list[dict]]) -> Model:
    """The model with the blocks' own structures, which are of equal kinds: rows (ivar, jvar, struct_idx, vtype, nugget, sill, ranges,
    angles, is_product) of each block."""
    stacked: dict = {}
    for rows in blocks:
        own: dict = {}
        for r in _ordered(rows):
            s = Structure(r["vtype"], r["sill"], r["a_major"], r["nugget"], r["a_minor1"], r["a_minor2"], r["azimuth"], r["dip"], r["plunge"], r["is_product"])
            own.setdefault((min(r["ivar"], r["jvar"]), max(r["ivar"], r["jvar"])), []).append(s)
        for pair, structures in own.items():
            stacked.setdefault(pair, []).append(structures)
    return replace(model, vgm={**model.vgm, **{p: StackedVariogram.of(v, model.ndim) for p, v in stacked.items()}}, varying=False)


def dealt(assembled: DataFrame) -> DataFrame:
    """Rows with ``factor``, a key of what their left side is made from, by ranges of it."""
    near = F.transform("near", lambda e: F.struct(e["kind"], e["var_id"], e["src_id"]))
    own = ["vgm"] if "vgm" in assembled.columns else []
    rows = assembled.withColumn("factor", F.xxhash64(near, "rangescale", "localnugget", *own))
    return rows.repartitionByRange("factor", "block_id").sortWithinPartitions("factor", "block_id")


def solved(assembled: DataFrame, model: Model) -> DataFrame:
    """One row a block: the key of its factor, status, whether the row before it had made that factor, weights, and the conditional
    covariance."""
    return dealt(assembled).mapInArrow(solver(model), SOLVED)


def estimated(assembled: DataFrame, model: Model) -> DataFrame:
    """(block_id, var_id, estimate, variance) of blocks whose data come with their values: what ``kriging.apply`` makes of their weights.
    There are no pairs of places among them."""
    return dealt(assembled).mapInArrow(solver(model, True), "block_id long, var_id int, estimate double, variance double")


def _applied(model: Model, var: np.ndarray, w: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(blocks, nvar) of weights (blocks, data, nvar) and values (blocks, data)."""
    out = (w * values[:, :, None]).sum(1)
    if model.unbiased and not model.standard and model.nvar > 1:
        # the sum-to-one form shifts each other variable by the difference of local means
        mean = {j: values[:, var == j].mean(1) for j in np.unique(var).tolist()}
        for t in range(model.nvar):
            for j, m in mean.items():
                if j != t + 1:
                    out[:, t] += (mean.get(t + 1, 0.0) - m) * w[:, var == j, t].sum(1)
    if not model.unbiased and model.means:
        out += (1 - w.sum(1)) * np.asarray(model.means, float)
    low, high = model.bounds
    return np.clip(out, -np.inf if low is None else low, np.inf if high is None else high)


def factors(assembled: DataFrame, model: Model) -> DataFrame:
    """(factor, data, lower, solved_constraints, schur): one row for each distinct neighbourhood: ids of its data, the Cholesky factor
    of their covariances by rows, K^-1 F by rows, and F' K^-1 F by rows; null where there is no such factor."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                m, near, a, _ = _one(batch, r, model)
                n = len(near) + (0 if m.gradients is None else len(m.gradients.var))
                try:
                    lower, (inverse, y, schur) = np.linalg.cholesky(a[:n, :n]), factored(a[None], n)
                    parts = [lower, inverse[0].T @ y[0], schur[0]]
                except np.linalg.LinAlgError:
                    parts = [None] * 3
                yield pa.RecordBatch.from_arrays([pa.array([_column(batch, "factor")[r].as_py()], pa.int64()), pa.array([[p["src_id"] for p in near]], pa.list_(pa.int64())), *(pa.array([None if p is None else p.ravel()], pa.list_(pa.float64())) for p in parts)], names=["factor", "data", "lower", "solved_constraints", "schur"])

    # one block of each neighbourhood, by a partial aggregate, so that a common one is not gathered
    keyed = dealt(assembled)
    one = keyed.groupBy("factor").agg(F.min("block_id").alias("block_id"))
    return keyed.join(one, ["factor", "block_id"]).mapInArrow(run, "factor long, data array<long>, lower array<double>, solved_constraints array<double>, schur array<double>")


def _one(batch, r: int, model: Model):
    """(model, data, left side, right sides) of one row."""
    near, nodes = _column(batch, "near")[r].as_py(), _column(batch, "nodes")[r].as_py()
    m = _replaced(model, [_column(batch, "vgm")[r].as_py()]) if model.varying else model
    kind, var = (np.array([p[c] for p in near]) for c in ("kind", "var_id"))
    x = np.array([p["x"] for p in near], float)[None]
    drift = np.array([p["drift"] for p in near], float).reshape(1, len(near), m.ndrift)
    scale, nugget = (np.array([_column(batch, c)[r].as_py()], float) for c in ("rangescale", "localnugget"))
    a = matrices(m, kind, var, x, np.array([[p["err"] for p in near]], float), drift, scale, nugget)[0]
    tdrift = np.array(_column(batch, "tdrift")[r].as_py(), float).reshape(1, m.nvar, m.ndrift)
    b = right_sides(m, var, x, np.array([p["x"] for p in nodes], float)[None], np.array([[p["w"] for p in nodes]], float), tdrift, scale)[0]
    return m, near, a, b


def linear_systems(assembled: DataFrame, model: Model) -> DataFrame:
    """(block_id, part, row, col, value): left and right sides of each block, for inspection ('a' and 'b')."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                _, _, a, b = _one(batch, r, model)
                for part, w in (("a", a), ("b", b)):
                    i, j = np.indices(w.shape)
                    n = w.size
                    yield pa.RecordBatch.from_arrays([pa.array([_column(batch, "block_id")[r].as_py()] * n, pa.int64()), pa.array([part] * n), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(w.ravel(), pa.float64())], names=["block_id", "part", "row", "col", "value"])

    return assembled.mapInArrow(run, "block_id long, part string, row int, col int, value double")


def counters(table: DataFrame) -> DataFrame:
    """(status, n, factors): how blocks were solved, and by how many distinct factors."""
    return table.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("factor").alias("factors"))
