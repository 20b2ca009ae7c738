"""SQL of small linear systems, written out step by step, to hold kriging against."""

from __future__ import annotations


def solved(source: str, a: list[list[str]], b: list[str], keep: list[str]) -> str:
    """``keep``, the right side as k1.., and the solution as s1.., of symmetric systems whose entries are expressions over
    ``source``: elimination without exchanges, which the order of covariances before constraints allows."""
    m = len(b)
    fixed = ", ".join([*keep, *(f"k{i}" for i in range(m))])
    entries = [f"({a[i][j]})::double a{i}_{j}" for i in range(m) for j in range(i, m)]
    sql = f"select {', '.join(keep)}, {', '.join(f'({b[i]})::double k{i}' for i in range(m))}, {', '.join(entries)}, {', '.join(f'({b[i]})::double b{i}' for i in range(m))} from ({source})"
    for p in range(m):
        done = [f"a{i}_{j}" for i in range(p + 1) for j in range(i, m)] + [f"b{i}" for i in range(p + 1)]
        rest = [f"a{i}_{j} - a{p}_{i} / a{p}_{p} * a{p}_{j} a{i}_{j}" for i in range(p + 1, m) for j in range(i, m)]
        rest += [f"b{i} - a{p}_{i} / a{p}_{p} * b{p} b{i}" for i in range(p + 1, m)]
        sql = f"select {fixed}, {', '.join([*done, *rest])} from ({sql})"
    for p in reversed(range(m)):
        known = "".join(f" - a{p}_{j} * s{j}" for j in range(p + 1, m))
        sql = f"select *, (b{p}{known}) / a{p}_{p} s{p} from ({sql})"
    return sql


def side_by_side(ranked: str, n: int, columns: list[str], more: list[str]) -> str:
    """One row a block from rows of (block_id, r, columns): x0.., for each column; ``more``: columns of the block itself."""
    each = ", ".join(f"max(case when r = {i + 1} then {c} end) {c}{i}" for c in columns for i in range(n))
    same = "".join(f", any_value({c}) {c}" for c in more)
    return f"select block_id{same}, {each} from ({ranked}) where r <= {n} group by block_id"


def distance(i: int, j: int | None, axes: tuple[tuple[str, str], ...] = (("x", "tx"), ("y", "ty"))) -> str:
    """Between neighbours i and j, or neighbour i and the target."""
    return "sqrt(" + " + ".join(f"pow({s}{i} - {t if j is None else f'{s}{j}'}, 2)" for s, t in axes) + ")"


def weighted(n: int, value: str = "v", first: int = 0) -> str:
    return " + ".join(f"s{first + i} * {value}{i}" for i in range(n))


def explained(m: int) -> str:
    return " + ".join(f"s{i} * k{i}" for i in range(m))
