"""Boundary value problems from an octree to a field: grids, operators,
transfers, and conjugate gradients with a V-cycle.

An operator is made for each grid by a function of (mesh, coefficients), the
coefficients being a table of elements (level, prefix, ...), whose columns other
than these are averaged from grid to grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fem, fields, mesh, tree
from . import multigrid

Operator = Callable[[DataFrame, DataFrame | None], DataFrame]


class Grids:
    """A hierarchy of meshes over a balanced octree, from fine to coarse."""

    def __init__(self, leaves: DataFrame, depth: int, levels: int = 10, fewest: int = 500):
        self.depth = depth
        self.trees = multigrid.hierarchy(leaves, levels, fewest)
        self.meshes = [tree.cut(mesh.elements(t, depth)) for t in self.trees]
        self.tables = [tree.cut(multigrid.transfer(f, c, depth)) for f, c in zip(self.meshes, self.meshes[1:], strict=False)]

    def nodes(self, grid: int = 0) -> DataFrame:
        return mesh.nodes(self.meshes[grid], self.depth)

    def report(self) -> DataFrame:
        """(grid, elements, hanging, coarsest, finest, nodes) of each grid."""
        out = None
        for k, elements in enumerate(self.meshes):
            sizes = elements.agg(F.expr("count(*) div 8").alias("elements"), F.count(F.when(F.col("hangs"), 1)).alias("hanging"), F.min("level").alias("coarsest"), F.max("level").alias("finest"), F.count_distinct(*mesh.AT).alias("nodes"))
            row = sizes.select(F.lit(k).alias("grid"), "*")
            out = row if out is None else out.unionByName(row)
        return out

    def coefficients(self, finest: DataFrame) -> list[DataFrame]:
        """The coefficients of every grid from those of the finest."""
        names, out = [c for c in finest.columns if c not in ("level", "prefix")], [finest]
        for cells in self.trees[1:]:
            each = [fields.to_coarser(out[-1].select("level", "prefix", F.col(n).alias("value")), cells).withColumnRenamed("value", n) for n in names]
            made = each[0]
            for more in each[1:]:
                made = made.join(more, ["level", "prefix"])
            out.append(tree.cut(made))
        return out

    def operators(self, make: Operator, coefficients: DataFrame | None = None) -> list[DataFrame]:
        given = self.coefficients(coefficients) if coefficients is not None else [None] * len(self.meshes)
        return [tree.cut(make(m, c)) for m, c in zip(self.meshes, given, strict=True)]


def solve(grids: Grids, operators: list[DataFrame], right: DataFrame, fixed: str | None = None, free_mean: bool = False, sequenced: bool = False, rounds: int = 10, tolerance: float = 1e-8, must: bool = False, small: int = 0) -> tuple[DataFrame, float]:
    """The solution (nx, ny, nz[, dof], value) and the norm of its residual.

    ``fixed``: a condition on nodes (nx, ny, nz, boundary), such as "boundary >
    0", where the solution is 0.  ``free_mean``: constants are solutions of the
    homogeneous problem, so the right-hand side is first made to sum to 0.
    ``sequenced``: the next coarser grid's solution is the first guess.
    ``must``: fail where the tolerance is not met after ``rounds``.  ``small``:
    a single grid of at most so many unknowns (counted) is solved on the driver.
    """
    tables = grids.tables
    if fixed:
        held = [tree.cut(grids.nodes(k).filter(fixed).select(*mesh.AT)) for k in range(len(grids.meshes))]
        operators = [tree.cut(fem.dirichlet(m, h)) for m, h in zip(operators, held, strict=True)]
        tables = [tree.cut(multigrid.suppressed(t, held[k], held[k + 1])) for k, t in enumerate(tables)]
        right = right.join(held[0], mesh.AT, "left_anti")
    if free_mean:
        mean = right.agg(F.avg("value")).first()[0] or 0.0
        right = right.withColumn("value", F.col("value") - mean)
    rights = [tree.cut(right)]
    if sequenced:
        for table in tables:
            rights.append(tree.cut(multigrid.restrict(table, rights[-1])))

    def on_grid(k: int, start: DataFrame | None) -> tuple[DataFrame, float]:
        rest = operators[k:]
        if len(rest) == 1 and fem.diagonal(rest[0]).limit(small + 1).count() <= small:
            found = tree.cut(multigrid.direct_solver(rest[0])(rights[k]))
            off = fem.axpy(-1.0, fem.times(rest[0], found), rights[k])
            return found, fem.dot(off, off) ** 0.5
        if len(rest) > 1:
            condition = multigrid.v_cycle(rest, tables[k:])
        else:
            inverse = tree.cut(fem.diagonal(rest[0]).withColumnRenamed("value", "_d"))
            keys = [c for c in inverse.columns if c != "_d"]

            def condition(r: DataFrame) -> DataFrame:
                return r.join(inverse, keys).select(*keys, (F.col("value") / F.col("_d")).alias("value"))

        return fem.conjugate_gradients(lambda v: fem.times(rest[0], v), rights[k], rounds, tolerance, condition, start)

    start = None
    for k in range(len(rights) - 1, 0, -1):
        start = tree.cut(multigrid.prolong(tables[k - 1], on_grid(k, start)[0]))
    found, residual = on_grid(0, start)
    if must and not residual <= tolerance * max(fem.dot(rights[0], rights[0]), 1e-300) ** 0.5:
        raise ArithmeticError(f"the residual is {residual:g} after {rounds} rounds")
    if fixed:
        found = found.join(held[0], mesh.AT, "left_anti")
        dofs = [c for c in ("dof",) if c in found.columns]
        zeros = held[0].withColumn("value", F.lit(0.0))
        if dofs:
            zeros = zeros.withColumn("dof", F.explode(F.array(*map(F.lit, range(3)))))
        found = found.unionByName(zeros)
    return found, residual


def scalar(depth: int, stiffness=1.0, mass=0.0) -> Operator:
    """Operators of -div(stiffness grad u) + mass u for ``Grids.operators``."""
    return lambda grid, given: fem.matrix(grid, depth, stiffness, mass, given)


def elastic(depth: int, mu=1.0, lam=1.0) -> Operator:
    """Operators of linear elasticity."""
    return lambda grid, given: fem.elastic_matrix(grid, depth, mu, lam, given)


def forces(grid: DataFrame, formulas: list[fields.Formula]) -> DataFrame:
    """The right-hand side with ``dof`` of a force with three components."""
    out = None
    for k, formula in enumerate(formulas):
        each = fields.load(grid, formula).withColumn("dof", F.lit(k))
        out = each if out is None else out.unionByName(each)
    return out
