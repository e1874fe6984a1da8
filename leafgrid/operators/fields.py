"""Fields on octree meshes: right-hand sides, values and gradients at points,
errors against a formula, and coefficients of elements.

Nodal values are tables (nx, ny, nz, value); a formula is a function of three
columns, the coordinates in the unit cube.  Integrals are sums over the Gauss
points of each element, worked out inside its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import fem, search
from .mesh import AT, shape
from .tree import cut

Formula = Callable[[Column, Column, Column], Column]


def _points() -> Column:
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(w).alias("w")) for (x, y, z), w in fem.quadrature()))


def centres(cells: DataFrame, dim: int = 3) -> DataFrame:
    """``cells`` with their centres in the unit cube as x, y, z."""
    h = F.pow(F.lit(0.5), F.col("level"))
    return cells.withColumns({a: (p + 0.5) * h for a, p in zip(K.AXES, K.position("prefix", dim), strict=False)})


def _placed(cells: DataFrame) -> DataFrame:
    """Elements with the size ``h`` and the low corner ``x0, y0, z0``."""
    h = F.pow(F.lit(0.5), F.col("level"))
    return cells.withColumns({"h": h, **{f"{a}0": p * h for a, p in zip(K.AXES, K.position("prefix"), strict=True)}})


def _integral(term: Callable[[Column, list[Column]], Column]) -> Column:
    """The integral over an element of ``term(point, place)``, ``point`` having
    the coordinates in the element."""

    def add(total: Column, p: Column) -> Column:
        return total + p["w"] * term(p, [F.col(f"{a}0") + F.col("h") * p[a] for a in K.AXES])

    return F.aggregate(_points(), F.lit(0.0), add) * F.col("h") * F.col("h") * F.col("h")


def corner_values(mesh: DataFrame, values: DataFrame) -> DataFrame:
    """(level, prefix, u): the field at each element's eight corners, those
    that hang taken from the nodes they depend on."""
    cells = cut(fem.gathered(mesh, values))
    eight = F.sequence(F.lit(0), F.lit(7))
    named = cells.join(fem.constraints(cells), ["child", "mask"])
    u = F.transform(eight, lambda v: F.aggregate(eight, F.lit(0.0), lambda s, j: s + F.get("q", v * 8 + j) * F.get("nodal", j)))
    return named.select("level", "prefix", u.alias("u"))


def load(mesh: DataFrame, formula: Formula) -> DataFrame:
    """The right-hand side: the integral of ``formula`` times each node's shape
    function, (nx, ny, nz, value)."""
    cells = cut(fem.gathered(mesh))
    each = _placed(cells).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7))))
    part = each.withColumn("part", _integral(lambda p, at: formula(*at) * shape([p[a] for a in K.AXES], F.col("v"))))
    named = part.join(fem.constraints(cells), ["child", "mask"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    weight = F.get("q", F.col("v") * 8 + F.col("j"))
    node = F.get("nodes", F.col("j"))
    return named.filter(weight != 0).groupBy(*(node[n].alias(n) for n in AT)).agg(F.sum(F.col("part") * weight).alias("value"))


def _interpolated(local: list[Column]) -> Column:
    return sum((F.get("u", F.lit(v)) * shape(local, F.lit(v)) for v in range(8)), F.lit(0.0))


def l2_error(mesh: DataFrame, values: DataFrame, formula: Formula) -> float:
    """The root of the integral of (field - formula) squared."""
    cells = _placed(corner_values(mesh, values))

    def square(p: Column, at: list[Column]) -> Column:
        gap = _interpolated([p[a] for a in K.AXES]) - formula(*at)
        return gap * gap

    return cells.agg(F.coalesce(F.sum(_integral(square)), F.lit(0.0))).first()[0] ** 0.5


def extremes(values: DataFrame, expected: Column) -> DataFrame:
    """(least, most, error): of a nodal field its extremes and the largest
    distance from what is ``expected`` (over nx, ny, nz)."""
    return values.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.max(F.abs(F.col("value") - expected)).alias("error"))


def at_points(points: DataFrame, mesh: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    """``points`` with coordinates x, y, z in [0, 1), with the field's ``value``
    there and its slopes ``dx``, ``dy``, ``dz``.  Points outside are left out."""
    inside = points.filter(" and ".join(f"{a} >= 0 and {a} < 1" for a in K.AXES))
    keyed = inside.withColumn("key", K.interleave(*(K.quantise(F.col(a), depth, 1.0) for a in K.AXES)))
    cells = _placed(corner_values(mesh, values))
    found = search.contained(keyed, cells, depth).join(cells, ["level", "prefix"])
    local = [(F.col(a) - F.col(f"{a}0")) / F.col("h") for a in K.AXES]
    # trilinear: along an axis the field is straight between the two faces
    slopes = [(_interpolated([*local[:a], F.lit(1.0), *local[a + 1 :]]) - _interpolated([*local[:a], F.lit(0.0), *local[a + 1 :]])) / F.col("h") for a in range(3)]
    return found.select(*(F.col(f"`{c}`") for c in points.columns), _interpolated(local).alias("value"), *(s.alias(f"d{a}") for a, s in zip(K.AXES, slopes, strict=True)))


def from_points(points: DataFrame, leaves: DataFrame, depth: int, otherwise: float = 0.0, key: str = "key") -> DataFrame:
    """(level, prefix, value): each leaf's mean of the points' ``value``."""
    means = search.contained(points, leaves, depth, key=key).groupBy("level", "prefix").agg(F.avg("value").alias("value"))
    return leaves.select("level", "prefix").join(means, ["level", "prefix"], "left").select("level", "prefix", F.coalesce("value", F.lit(otherwise)).alias("value"))


def to_coarser(values: DataFrame, coarse: DataFrame, dim: int = 3) -> DataFrame:
    """Elements' (level, prefix, value) on a mesh one coarsening away: a leaf
    that was kept keeps its value, one that was merged gets the children's sum
    over 2**dim."""
    up = values.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("prefix", dim).alias("prefix")).agg((F.sum("value") / 2**dim).alias("_mean"))
    rows = coarse.select("level", "prefix").join(values.select("level", "prefix", "value"), ["level", "prefix"], "left").join(up, ["level", "prefix"], "left")
    return rows.select("level", "prefix", F.coalesce("value", "_mean").alias("value"))


def to_finer(values: DataFrame, fine: DataFrame, dim: int = 3) -> DataFrame:
    """The other way: a leaf gets its own value or its parent's."""
    above = values.select((F.col("level") + 1).alias("level"), F.col("prefix").alias("_p"), F.col("value").alias("_above"))
    rows = fine.select("level", "prefix", F.shiftright("prefix", dim).alias("_p")).join(values.select("level", "prefix", "value"), ["level", "prefix"], "left").join(above, ["level", "_p"], "left")
    return rows.select("level", "prefix", F.coalesce("value", "_above").alias("value"))
