"""Grid hierarchies and transfers between them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import fem, mesh, search, tree

#: The coarsest grid is solved on the driver if it has no more unknowns: by a
#: dense inverse, or up to the second bound by iteration over its entries.
DIRECT, SMALL = 1000, 40_000


def hierarchy(leaves: DataFrame, levels: int, fewest: int = 500, dim: int = 3) -> list[DataFrame]:
    """Octrees from fine to coarse: coarsen, balance, until there are
    ``levels`` of them or fewer than ``fewest`` cells."""
    out = [tree.cut(leaves)]
    while len(out) < levels and out[-1].count() >= fewest:
        out.append(tree.cut(tree.balance(tree.coarsen(out[-1], dim), dim)))
    return out


def transfer(fine: DataFrame, coarse: DataFrame, depth: int) -> DataFrame:
    """(nx, ny, nz, mx, my, mz, weight): each fine node's value as a weighted
    sum of coarse nodes' values.  A fine node is looked up in the coarse leaf
    that contains it, hanging vertices resolved as in that leaf."""
    points = mesh.nodes(fine, depth).select(*mesh.AT)
    # the cell below and left of a node at the high end of the domain
    at = [F.least(F.col(n), F.lit(2**depth - 1)) for n in mesh.AT]
    points = points.withColumn("key", K.interleave(*at))
    leaves = coarse.select("level", "prefix").distinct()
    inside = search.contained(points, leaves, depth)
    size = F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))
    local = [(F.col(n) - p * size) / size for n, p in zip(mesh.AT, K.position("prefix"), strict=True)]
    each = inside.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("w", mesh.shape(local, F.col("v"))).filter("w <> 0")
    kinds = tree.cut(mesh.masks(coarse))
    rows = []
    for r in kinds.select("child", "mask").distinct().collect():
        q = fem.constraint(r["child"], r["mask"])
        rows += [(r["child"], r["mask"], v, j, float(q[v, j])) for v in range(8) for j in range(8) if q[v, j]]
    table = fine.sparkSession.createDataFrame(rows, "child int, mask int, v int, vertex int, q double")
    named = coarse.select("level", "prefix", "vertex", *(F.col(n).alias(n.replace("n", "m")) for n in mesh.AT))
    out = each.join(kinds, ["level", "prefix"]).join(F.broadcast(table), ["child", "mask", "v"]).join(named, ["level", "prefix", "vertex"])
    return out.groupBy(*mesh.AT, "mx", "my", "mz").agg(F.sum(F.col("w") * F.col("q")).alias("weight"))


def suppressed(table: DataFrame, fine_fixed: DataFrame, coarse_fixed: DataFrame) -> DataFrame:
    """A transfer without the couplings that touch a node (nx, ny, nz) whose
    value is given."""
    columns = coarse_fixed.select(*mesh.AT).toDF("mx", "my", "mz")
    return table.join(fine_fixed.select(*mesh.AT), mesh.AT, "left_anti").join(columns, columns.columns, "left_anti")


def _moved(table: DataFrame, values: DataFrame, by: list[str], to: list[Column]) -> DataFrame:
    more = [c for c in ("dof",) if c in values.columns]
    right = values.select(*(F.col(n).alias(b) for n, b in zip(mesh.AT, by, strict=True)), *more, F.col("value").alias("_x"))
    return table.join(right, by).groupBy(*to, *more).agg(F.sum(F.col("weight") * F.col("_x")).alias("value"))


def prolong(table: DataFrame, coarse_values: DataFrame) -> DataFrame:
    """Fine values (nx, ny, nz[, dof], value) of coarse ones."""
    return _moved(table, coarse_values, ["mx", "my", "mz"], [F.col(n) for n in mesh.AT])


def restrict(table: DataFrame, fine_values: DataFrame) -> DataFrame:
    """The transpose of ``prolong``."""
    return _moved(table, fine_values, mesh.AT, [F.col(m).alias(n) for n, m in zip(mesh.AT, ("mx", "my", "mz"), strict=True)])


def _relaxed(row: np.ndarray, column: np.ndarray, value: np.ndarray, right: np.ndarray, tolerance: float = 1e-11) -> np.ndarray:
    """Conjugate gradients, scaled by the diagonal, over a matrix's entries."""
    n = len(right)
    scale = np.bincount(row[row == column], value[row == column], n)
    x, r = np.zeros(n), right.copy()
    z = r / scale
    p, rz, first = z, r @ z, max(float(right @ right), 1e-300) ** 0.5
    for _ in range(20 * n):
        if (r @ r) ** 0.5 <= tolerance * first:
            break
        q = np.bincount(row, value * p[column], n)
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        z = r / scale
        old, rz = rz, r @ z
        p = z + rz / old * p
    return x


def direct_solver(operator: DataFrame, dense: int = DIRECT) -> Callable[[DataFrame], DataFrame]:
    """Solutions on the driver, for an operator of a counted, small number of
    unknowns; the least ones if it is singular."""
    keys = [k for k in fem.OTHER if k in operator.columns]
    table = operator.select(*keys, *(fem.OTHER[k] for k in keys), "value").toArrow()
    columns = [table.column(k).to_numpy().astype(np.int64) for k in range(2 * len(keys))]
    both = [np.stack(columns[: len(keys)], 1), np.stack(columns[len(keys) :], 1)]
    places, at = np.unique(np.concatenate(both), axis=0, return_inverse=True)
    row, column = np.split(at.reshape(-1), 2)
    value = table.column(2 * len(keys)).to_numpy()
    inverse = None
    if len(places) <= dense:
        matrix = np.zeros((len(places), len(places)))
        np.add.at(matrix, (row, column), value)
        inverse = np.linalg.pinv(matrix, rcond=1e-12, hermitian=True)
    number = {tuple(p): k for k, p in enumerate(places.tolist())}
    schema = ", ".join(f"{k} {operator.schema[k].dataType.simpleString()}" for k in keys) + ", value double"

    def apply(r: DataFrame) -> DataFrame:
        right = np.zeros(len(places))
        for *place, v in r.select(*keys, "value").collect():
            right[number[tuple(place)]] += v
        found = inverse @ right if inverse is not None else _relaxed(row, column, value, right)
        return operator.sparkSession.createDataFrame([(*p, float(v)) for p, v in zip(places.tolist(), found, strict=True)], schema)

    return apply


def v_cycle(operators: list[DataFrame], tables: list[DataFrame], damping: float = 0.6, coarse_rounds: int = 8, direct: int = SMALL) -> Callable[[DataFrame], DataFrame]:
    """A preconditioner: on every grid but the last a Jacobi step, a correction
    from the next grid, a Jacobi step; on the last a solution on the driver if it
    has at most ``direct`` unknowns, otherwise conjugate gradients.
    ``tables[k]`` is the transfer between the grids k and k + 1."""
    inverses = [tree.cut(fem.diagonal(m).withColumn("value", damping / F.col("value")).withColumnRenamed("value", "_d")) for m in operators[:-1]]

    exact = direct_solver(operators[-1]) if fem.diagonal(operators[-1]).limit(direct + 1).count() <= direct else None

    def smooth(grid: int, r: DataFrame) -> DataFrame:
        keys = [c for c in inverses[grid].columns if c != "_d"]
        return r.join(inverses[grid], keys).select(*keys, (F.col("value") * F.col("_d")).alias("value"))

    def corrected(grid: int, r: DataFrame) -> DataFrame:
        def apply(v: DataFrame) -> DataFrame:
            return fem.times(operators[grid], v)

        if grid == len(operators) - 1:
            if exact:
                return exact(r)
            return fem.conjugate_gradients(apply, r, coarse_rounds)[0]
        x = tree.cut(smooth(grid, r))
        rest = tree.cut(fem.axpy(-1.0, apply(x), r))
        low = corrected(grid + 1, tree.cut(restrict(tables[grid], rest)))
        x = tree.cut(fem.axpy(1.0, prolong(tables[grid], low), x))
        return fem.axpy(1.0, smooth(grid, fem.axpy(-1.0, apply(x), r)), x)

    return lambda r: corrected(0, r)
