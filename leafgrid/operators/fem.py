"""Trilinear finite elements on octree meshes.

Element matrices are derived at load time: the unit-cube matrices by Gauss
quadrature, and for each (child, hanging mask) the rows that express a hanging
vertex by the parent's vertices, Q, so that the table holds Q^T A Q.  It has a
fixed size and is broadcast to the elements, each of which carries its nodes, so
that an operator takes one sum by pair of nodes, a product one join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .mesh import AT
from .tree import cut

#: A column's name in a row of an operator, for its row and its column.
OTHER = {"nx": "mx", "ny": "my", "nz": "mz", "dof": "mdof"}
_BITS = np.array([[v >> a & 1 for a in range(3)] for v in range(8)])


def quadrature() -> list[tuple[tuple[float, float, float], float]]:
    """The 27 Gauss points of the unit cube and their weights."""
    at, weight = 0.5 + np.array([-1, 0, 1]) * np.sqrt(0.6) / 2, np.array([5, 8, 5]) / 18
    return [((float(at[i]), float(at[j]), float(at[k])), float(weight[i] * weight[j] * weight[k])) for i in range(3) for j in range(3) for k in range(3)]


def unit_matrices() -> tuple[np.ndarray, np.ndarray]:
    """Of the unit cube: the integrals of the shape functions' derivatives,
    [i, a, j, b] for function i by axis a times function j by axis b, and the
    mass."""
    slopes, mass = np.zeros((8, 3, 8, 3)), np.zeros((8, 8))
    for at, w in quadrature():
        parts = np.where(_BITS == 1, at, 1 - np.array(at))
        value = parts.prod(1)
        slope = np.stack([np.where(_BITS[:, a] == 1, 1.0, -1.0) * np.delete(parts, a, 1).prod(1) for a in range(3)], 1)
        slopes += w * np.einsum("ia,jb->iajb", slope, slope)
        mass += w * np.outer(value, value)
    return slopes, mass


def constraint(child: int, mask: int) -> np.ndarray:
    """Vertex values by node values: a hanging vertex lies amid the parent's
    vertices that differ from ``child`` in some of the same axes."""
    q = np.eye(8)
    for v in range(8):
        if mask >> v & 1:
            differ = child ^ v
            some = [m for m in range(8) if m & differ == m]
            q[v] = 0
            q[v, [child ^ m for m in some]] = 1 / len(some)
    return q


def gathered(mesh: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(level, prefix, child, mask, nodes[, nodal]): one row an element, its
    eight nodes in an array and, if ``values`` are given, the values there; a
    node without a value has 0."""
    bit = F.when(F.col("hangs"), F.expr("shiftleft(1, vertex)")).otherwise(0)
    fields = ["vertex", *AT]
    if values is not None:
        mesh = mesh.join(values.select(*AT, "value"), AT, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        fields.append("value")
    cells = mesh.groupBy("level", "prefix").agg(F.sum(bit).cast("int").alias("mask"), F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
    child = F.when(F.col("level") > 0, K.child_number("prefix")).otherwise(0)
    nodal = [F.transform("nodes", lambda n: n["value"]).alias("nodal")] if values is not None else []
    return cells.select("level", "prefix", child.alias("child"), "mask", "nodes", *nodal)


def classes(cells: DataFrame) -> list[tuple[int, int]]:
    """The (child, mask) that occur, 8 * 256 at most."""
    return [(r["child"], r["mask"]) for r in cells.select("child", "mask").distinct().collect()]


def constraints(cells: DataFrame) -> DataFrame:
    """(child, mask, q): ``constraint`` row by row; at most one row a class."""
    rows = [(c, m, constraint(c, m).reshape(-1).tolist()) for c, m in classes(cells)]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "child int, mask int, q array<double>"))


def stencils(cells: DataFrame) -> DataFrame:
    """(child, mask, i, j, stiff, mass, slopes) for the classes that occur;
    ``slopes`` has the nine products of derivatives."""
    slopes, mass = unit_matrices()
    rows = []
    for c, m in classes(cells):
        q = constraint(c, m)
        own, weight = np.einsum("ki,kalb,lj->ijab", q, slopes, q), q.T @ mass @ q
        rows += [(c, m, i, j, float(np.trace(own[i, j])), float(weight[i, j]), own[i, j].reshape(-1).tolist()) for i in range(8) for j in range(8)]
    return F.broadcast(cells.sparkSession.createDataFrame(rows, "child int, mask int, i int, j int, stiff double, mass double, slopes array<double>"))


def _coupled(mesh: DataFrame, coefficients: DataFrame | None) -> DataFrame:
    """Every element's pairs of nodes with their stencil entries.  The nodes
    travel with the element, so that the pairs need no join."""
    cells = cut(gathered(mesh))
    pairs = cells.join(stencils(cells), ["child", "mask"])
    if coefficients is not None:
        pairs = cut(cells.join(coefficients, ["level", "prefix"])).join(stencils(cells), ["child", "mask"])
    row, column = (F.element_at("nodes", F.col(k) + 1) for k in "ij")
    return pairs.withColumns({**{n: row[n] for n in AT}, **{OTHER[n]: column[n] for n in AT}})


def matrix(mesh: DataFrame, depth: int, stiffness: float | Column = 1.0, mass: float | Column = 0.0, coefficients: DataFrame | None = None) -> DataFrame:
    """The assembled operator as (nx, ny, nz, mx, my, mz, value).  The factors
    may vary by element: as expressions over (level, prefix) and the other
    columns of ``coefficients``, which has one row an element."""
    h = F.pow(F.lit(0.5), F.col("level"))
    value = F.col("stiff") * h * stiffness + F.col("mass") * h * h * h * mass
    return _coupled(mesh, coefficients).groupBy(*AT, "mx", "my", "mz").agg(F.sum(value).alias("value"))


def product(mesh: DataFrame, values: DataFrame, stiffness: float | Column = 1.0, mass: float | Column = 0.0, coefficients: DataFrame | None = None) -> DataFrame:
    """``matrix`` times nodal values (nx, ny, nz, value) without the matrix:
    each element multiplies in its own row and sends its eight parts, which are
    summed by node."""
    cells = gathered(mesh, values)
    if coefficients is not None:
        cells = cells.join(coefficients, ["level", "prefix"])
    cells = cut(cells)
    slopes, weight = unit_matrices()
    rows = []
    for c, m in classes(cells):  # 8 * 256 at most
        q = constraint(c, m)
        stiff = np.einsum("ki,kala,lj->ij", q, slopes, q)
        rows.append((c, m, stiff.reshape(-1).tolist(), (q.T @ weight @ q).reshape(-1).tolist()))
    table = F.broadcast(mesh.sparkSession.createDataFrame(rows, "child int, mask int, _k array<double>, _m array<double>"))
    h, eight = F.pow(F.lit(0.5), F.col("level")), F.sequence(F.lit(0), F.lit(7))
    each = cells.join(table, ["child", "mask"]).withColumns({"_a": F.lit(stiffness) * h, "_b": F.lit(mass) * h * h * h})

    def row(i: Column) -> Column:
        entry = lambda j: F.get("_k", i * 8 + j) * F.col("_a") + F.get("_m", i * 8 + j) * F.col("_b")
        return F.struct(F.get("nodes", i).alias("node"), F.aggregate(eight, F.lit(0.0), lambda s, j: s + entry(j) * F.get("nodal", j)).alias("part"))

    parts = each.select(F.explode(F.transform(eight, row)).alias("_p")).select("_p.node.*", "_p.part")
    return parts.groupBy(*AT).agg(F.sum("part").alias("value"))


def vector_mass(mesh: DataFrame, values: DataFrame, dofs: int = 3) -> DataFrame:
    """The mass operator times a field (nx, ny, nz, dof, value) with the same
    operator for each of its components."""
    out = None
    for k in range(dofs):
        each = product(mesh, values.filter(F.col("dof") == k), 0.0, 1.0).withColumn("dof", F.lit(k))
        out = each if out is None else out.unionByName(each)
    return out


def elastic_matrix(mesh: DataFrame, depth: int, mu: float | Column = 1.0, lam: float | Column = 1.0, coefficients: DataFrame | None = None) -> DataFrame:
    """The operator of linear elasticity, mu (grad u : grad v) + (mu + lam)
    (div u) (div v), as (nx, ny, nz, dof, mx, my, mz, mdof, value) with the
    three displacements as ``dof``; factors as in ``matrix``."""
    rows = _coupled(mesh, coefficients).withColumns({"_mu": F.lit(mu), "_lam": F.lit(lam)})
    each = rows.select("level", *AT, "mx", "my", "mz", "stiff", "_mu", "_lam", F.posexplode("slopes").alias("_at", "_g"))
    dof, other = F.floor(F.col("_at") / 3).cast("int"), (F.col("_at") % 3).cast("int")
    own = F.when(dof == other, F.col("stiff") * F.col("_mu")).otherwise(0.0)
    value = F.pow(F.lit(0.5), F.col("level")) * (own + (F.col("_mu") + F.col("_lam")) * F.col("_g"))
    return each.groupBy(*AT, dof.alias("dof"), "mx", "my", "mz", other.alias("mdof")).agg(F.sum(value).alias("value"))


def elastic_product(mesh: DataFrame, values: DataFrame, mu: float = 1.0, lam: float = 1.0) -> DataFrame:
    """``elastic_matrix`` with constant factors times a field (nx, ny, nz, dof,
    value) without the matrix, as in ``product``."""
    nodal = values.groupBy(*AT).agg(*(F.coalesce(F.sum(F.when(F.col("dof") == k, F.col("value"))), F.lit(0.0)).alias(f"_{k}") for k in range(3)))
    bit = F.when(F.col("hangs"), F.expr("shiftleft(1, vertex)")).otherwise(0)
    each = mesh.join(nodal, AT, "left").withColumn("_u", F.array(*(F.coalesce(f"_{k}", F.lit(0.0)) for k in range(3))))
    rows = each.groupBy("level", "prefix").agg(F.sum(bit).cast("int").alias("mask"), F.array_sort(F.collect_list(F.struct("vertex", *AT, "_u"))).alias("nodes"))
    child = F.when(F.col("level") > 0, K.child_number("prefix")).otherwise(0)
    cells = cut(rows.select("level", child.alias("child"), "mask", "nodes", F.flatten(F.transform("nodes", lambda n: n["_u"])).alias("nodal")))
    table = [(c, m, elastic_element(c, m, mu, lam).reshape(-1).tolist()) for c, m in classes(cells)]  # 8 * 256 at most
    cells = cells.join(F.broadcast(mesh.sparkSession.createDataFrame(table, "child int, mask int, _k array<double>")), ["child", "mask"])
    h, eight, all_ = F.pow(F.lit(0.5), F.col("level")), F.sequence(F.lit(0), F.lit(7)), F.sequence(F.lit(0), F.lit(23))

    def row(i: Column, k: int) -> Column:
        return F.aggregate(all_, F.lit(0.0), lambda s, j: s + F.get("_k", (i * 3 + k) * 24 + j) * F.get("nodal", j))

    parts = cells.select(h.alias("_h"), F.explode(F.transform(eight, lambda i: F.struct(F.get("nodes", i).alias("node"), F.array(*(row(i, k) for k in range(3))).alias("parts")))).alias("_p"))
    parts = parts.select("_h", *(F.col(f"_p.node.{n}") for n in AT), F.posexplode("_p.parts").alias("dof", "part"))
    return parts.groupBy(*AT, "dof").agg(F.sum(F.col("part") * F.col("_h")).alias("value"))


def elastic_element(child: int, mask: int, mu: float, lam: float) -> np.ndarray:
    """The 24 x 24 matrix of elasticity of a class of elements of side 1, rows
    and columns in the order (node, displacement)."""
    slopes, _ = unit_matrices()
    q = constraint(child, mask)
    own = np.einsum("ki,kalb,lj->iajb", q, slopes, q)
    stiff = np.einsum("iaja->ij", own)
    return (mu * np.einsum("ij,ab->iajb", stiff, np.eye(3)) + (mu + lam) * own).reshape(24, 24)


def _keys(operator: DataFrame) -> list[str]:
    return [k for k in OTHER if k in operator.columns]


def times(operator: DataFrame, vector: DataFrame) -> DataFrame:
    """Operator times a vector (nx, ny, nz[, dof], value)."""
    keys = _keys(operator)
    right = vector.select(*(F.col(k).alias(OTHER[k]) for k in keys), F.col("value").alias("_x"))
    return operator.join(right, [OTHER[k] for k in keys]).groupBy(*keys).agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def diagonal(operator: DataFrame) -> DataFrame:
    keys = _keys(operator)
    return operator.filter(" and ".join(f"{k} = {OTHER[k]}" for k in keys)).select(*keys, "value")


def dirichlet(operator: DataFrame, fixed: DataFrame) -> DataFrame:
    """The operator without all couplings that touch the ``fixed`` nodes
    (nx, ny, nz), and with 1 on their diagonal."""
    fixed = fixed.select(*AT).distinct()
    columns = fixed.toDF("mx", "my", "mz")
    free = operator.join(fixed, AT, "left_anti").join(columns, columns.columns, "left_anti")
    dofs = operator.filter("nx = mx and ny = my and nz = mz").join(fixed, AT, "left_semi").select(*_keys(operator)).distinct()
    ones = dofs.select(*dofs.columns, *(F.col(k).alias(OTHER[k]) for k in dofs.columns), F.lit(1.0).alias("value"))
    return free.unionByName(ones)


def block_inverse(operator: DataFrame) -> DataFrame:
    """The inverses of the 3 x 3 blocks on the diagonal of an operator with
    ``dof``, as an operator: the preconditioner by blocks."""
    own = operator.filter("nx = mx and ny = my and nz = mz").groupBy(*AT).agg(*(F.coalesce(F.sum(F.when((F.col("dof") == a) & (F.col("mdof") == b), F.col("value"))), F.lit(0.0)).alias(f"_{a}{b}") for a in range(3) for b in range(3)))

    def cofactor(a: int, b: int) -> Column:
        (r, s), (t, u) = ((a + 1) % 3, (a + 2) % 3), ((b + 1) % 3, (b + 2) % 3)
        return F.col(f"_{r}{t}") * F.col(f"_{s}{u}") - F.col(f"_{r}{u}") * F.col(f"_{s}{t}")

    whole = sum((F.col(f"_0{b}") * cofactor(0, b) for b in range(3)), F.lit(0.0))
    entries = F.array(*(F.struct(F.lit(a).alias("dof"), F.lit(b).alias("mdof"), (cofactor(b, a) / whole).alias("value")) for a in range(3) for b in range(3)))
    return own.select(*AT, F.explode(entries).alias("_e")).select(*AT, "_e.dof", *(F.col(n).alias(OTHER[n]) for n in AT), "_e.mdof", "_e.value")


def dot(one: DataFrame, two: DataFrame) -> float:
    keys = _keys(one)
    return one.join(two.select(*keys, F.col("value").alias("_y")), keys).agg(F.coalesce(F.sum(F.col("value") * F.col("_y")), F.lit(0.0))).first()[0]


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a x + y; a missing value is 0."""
    keys = _keys(y)
    both = x.select(*keys, (F.col("value") * a).alias("value")).unionByName(y.select(*keys, "value"))
    return both.groupBy(*keys).agg(F.sum("value").alias("value"))


def conjugate_gradients(apply: Callable[[DataFrame], DataFrame], right: DataFrame, rounds: int = 10, tolerance: float = 1e-8, condition: Callable[[DataFrame], DataFrame] | None = None, start: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Solution and residual norm; ``condition`` is the preconditioner, ``start``
    a first guess instead of 0.  Vectors may have several ``dof`` a node."""
    condition = condition or (lambda r: r)
    keys = _keys(right)
    first = max(dot(right, right), 1e-300) ** 0.5
    x = right.select(*keys, F.lit(0.0).alias("value")) if start is None else start.select(*keys, "value")
    r = cut(right.select(*keys, "value") if start is None else axpy(-1.0, apply(x), right))
    z = cut(condition(r))
    p, rz = z, dot(r, z)
    for _ in range(rounds):
        q = cut(apply(p))
        below = dot(p, q)
        if below <= 0:
            break
        step = rz / below
        x, r = cut(axpy(step, p, x)), cut(axpy(-step, q, r))
        if dot(r, r) ** 0.5 <= tolerance * first:
            break
        z = cut(condition(r))
        old, rz = rz, dot(r, z)
        p = cut(axpy(rz / old, p, z))
    return x, dot(r, r) ** 0.5
